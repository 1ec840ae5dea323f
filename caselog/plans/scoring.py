"""Scoring of cases: validation, storage, and lookups by case id."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog import schemas
from caselog.functions import expressions as E
from caselog.functions import validation as check
from caselog.operators import features, ordered
from caselog.operators.model import RiskModel
from caselog.session import scratch_path
from caselog.sinks import snapshots
from caselog.sources.paths import delete

DUPLICATE = "Duplicate application ID in input batch"


def scoring_input(cases: DataFrame, extensions: DataFrame, limit: int | None = None) -> DataFrame:
    """Features of all cases, or of the first ``limit`` in id order."""
    if limit and limit > 0:
        cases = cases.orderBy("application_id").limit(limit)
    return features.case_features(cases, extensions)


def _reason(version: str) -> Column:
    """Why a prediction cannot be stored; NULL for a valid one."""
    got = lambda text, c: F.concat(F.lit(f"{text}, got "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))
    fails = lambda test: ~F.coalesce(test, F.lit(False))
    p, days = F.col("risk_probability"), F.col("predicted_processing_days")
    return (
        F.when(F.col("_nth") > 1, DUPLICATE)
        .when(fails(F.trim("application_id") != ""), got("Invalid application_id", "application_id"))
        .when(fails(F.col("risk_class").isin(0, 1)), got("risk_class must be 0 or 1", "risk_class"))
        .when(fails(p.between(0, 1)), got("risk_probability must be between 0.0 and 1.0", "risk_probability"))
        .when(fails((days >= 0) & ~F.isnan(days)),
              got("predicted_processing_days must be nonnegative", "predicted_processing_days"))
    )


def with_reasons(
    scored: DataFrame, model_version: str, model_type: str, order_by: list[str] | None = None,
    hot_rows: int | None = ordered.HOT_ROWS,
) -> DataFrame:
    """Rounded predictions with the reason to skip each, if any. Of a repeated id the first
    row in ``order_by`` counts, whether or not it is valid itself."""
    version = check.non_blank(model_version, "model_version")
    rounded = scored.withColumns({
        "application_id": F.trim("application_id"),
        "risk_probability": F.round(F.col("risk_probability").cast("double"), 4),
        "predicted_processing_days": F.round(F.col("predicted_processing_days").cast("double"), 2),
    })
    order = order_by or ["predicted_processing_days", "risk_probability", "risk_class"]
    placed = ordered.neighbours(rounded, ["application_id"], order, position="_nth", hot_rows=hot_rows)
    return placed.select(
        "application_id", F.lit(version).alias("model_version"), F.lit(model_type).alias("model_type"),
        "risk_class", "risk_probability", "predicted_processing_days", _reason(version).alias("reason"),
    )


def valid_rows(checked: DataFrame) -> DataFrame:
    kinds = {"risk_class": "smallint", "risk_probability": "decimal(6,4)", "predicted_processing_days": "decimal(10,2)"}
    return checked.where(F.col("reason").isNull()).drop("reason").withColumns(
        {c: F.col(c).cast(kind) for c, kind in kinds.items()}
    )


def skipped_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNotNull()).select("application_id", "reason")


class ScoringResult(NamedTuple):
    considered: int
    persisted: int
    skipped: int


def score_cases(
    cases: DataFrame, extensions: DataFrame, model: RiskModel | str, model_version: str,
    predictions_path: str, limit: int | None = None, dry_run: bool = False,
) -> ScoringResult:
    """Score cases and upsert the valid predictions of one model version.

    Predictions are computed once and stored in the shared folder; counting and the merge
    read that. Other versions are not touched, and a second run changes no row count."""
    version = check.non_blank(model_version, "model_version")
    model = RiskModel.load(model) if isinstance(model, str) else model
    spark = cases.sparkSession
    scored = model.predict(scoring_input(cases, extensions, limit))
    staged = scratch_path(spark, "scored")
    try:
        # Case ids are unique, so no group of equal ids is large.
        with_reasons(scored, version, model.model_type, hot_rows=None).write.parquet(staged)
        checked = spark.read.parquet(staged)
        total, bad = checked.agg(F.count(F.lit(1)), F.count("reason")).first()
        if not dry_run:
            now = F.current_timestamp()
            rows = valid_rows(checked).withColumns({"scored_at": now, "created_at": now, "updated_at": now})
            snapshots.upsert_part(
                rows, predictions_path, "model_version", version, ["application_id"], schemas.PREDICTIONS
            )
    finally:
        delete(spark, staged)
    return ScoringResult(total, 0 if dry_run else total - bad, bad)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.read_parts(spark, path, "model_version", schemas.PREDICTIONS)


# Fixed value: the answer for an unknown id, around the id.
NOT_FOUND = ("Application ID ", " not found in database.")


def _not_found(case_id: str) -> str:
    return repr(case_id).join(NOT_FOUND)


def features_of_case(cases: DataFrame, extensions: DataFrame, case_id: str) -> DataFrame:
    """One row of features; the id filter reaches both scans."""
    wanted = check.non_blank(case_id, "application_id")
    found = features.case_features(
        cases.where(F.col("application_id") == wanted),
        extensions.where(F.col("application_id") == wanted), known_only=True,
    )
    if found.isEmpty():
        raise ValueError(_not_found(case_id))
    return found.select(*features.columns("full"))


def _answer(scored: DataFrame) -> list[Column]:
    return [
        F.col("risk_class").alias("sla_risk_class"),
        E.risk_label(F.col("risk_class")).alias("sla_risk_label"),
        F.round("risk_probability", 4).alias("sla_breach_probability"),
        F.round("predicted_processing_days", 2).alias("predicted_processing_days"),
    ]


def predict_case(model: RiskModel, cases: DataFrame, extensions: DataFrame, case_id: str) -> DataFrame:
    """Class, label, probability and days of one case, as one row."""
    scored = model.predict(features_of_case(cases, extensions, case_id))
    return scored.select(
        F.lit(case_id).alias("application_id"), *_answer(scored), F.lit(model.model_type).alias("model_type")
    )


def predict_batch(
    model: RiskModel, cases: DataFrame, extensions: DataFrame, ids: Iterable[str] | DataFrame
) -> DataFrame:
    """One row per requested id, SUCCESS or ERROR, in request order (column ``position``).

    ``ids`` is a list, or for large requests a frame with position and application_id."""
    if ids is None:
        raise ValueError("application_ids cannot be None")
    spark = cases.sparkSession
    if not isinstance(ids, DataFrame):
        listed = [(i, x if isinstance(x, str) else None, repr(x)) for i, x in enumerate(ids)]
        ids = spark.createDataFrame(listed, "position bigint, application_id string, shown string")
    else:
        ids = ids.select("position", "application_id", F.col("application_id").alias("shown"))
        ids = ids.withColumn("shown", F.concat(F.lit("'"), F.coalesce("shown", F.lit("None")), F.lit("'")))
    asked = ids.withColumn("_key", F.trim("application_id"))
    known = features.case_features(cases, extensions, known_only=True)
    feature_columns = features.columns("full")
    matched = asked.where(F.col("_key") != "").join(
        known.select(F.col("application_id").alias("_key"), *feature_columns), "_key"
    )
    scored = model.predict(matched.select("position", "application_id", *feature_columns))
    good = scored.select(
        "position", "application_id", *_answer(scored), F.lit("SUCCESS").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )
    invalid = F.coalesce(F.col("_key"), F.lit("")) == ""
    lost = asked.join(known.select(F.col("application_id").alias("_key")), "_key", "left_anti").select(
        "position", "application_id", F.lit("ERROR").alias("status"),
        F.when(invalid, F.concat(F.lit("Invalid application_id: "), F.col("shown")))
        .otherwise(F.concat(F.lit(NOT_FOUND[0]), F.col("shown"), F.lit(NOT_FOUND[1])))
        .alias("error"),
    )
    return good.unionByName(lost, allowMissingColumns=True).orderBy("position")
