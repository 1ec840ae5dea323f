"""Prediction views and the reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselog.functions import expressions as E
from caselog.functions import validation as check
from caselog.operators import quantiles
from caselog.plans import views
from caselog.session import staged


def _with_cases(cases: DataFrame, events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cases, their metrics and predictions, all joined on the case id: the event counts,
    the cases and the predictions meet on one partitioning."""
    metrics = views.case_metrics(cases, events, carry=("status",))
    label = E.risk_label(F.col("risk_class"))
    error = E.processing_error(
        F.col("status"), F.col("complete_count"), F.col("processing_days"), F.col("predicted_processing_days")
    )
    return metrics.join(predictions, "application_id").select(
        "application_id", "application_type", "loan_goal", "requested_amount",
        "first_event_time", "last_event_time",
        F.col("status").alias("application_status"),
        F.col("processing_hours").alias("actual_processing_hours"),
        F.col("processing_days").alias("actual_processing_days"),
        "event_count", "model_version", "model_type",
        F.col("risk_class").alias("predicted_risk_class"),
        label.alias("predicted_risk_label"),
        F.col("risk_probability").alias("predicted_risk_probability"),
        "predicted_processing_days",
        error.alias("processing_days_error"),
        "scored_at",
    )


def sla_risk(cases: DataFrame, events: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per case and model version."""
    return _with_cases(cases, events, predictions)


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """The newest prediction of each case. The filter on the row number lets Spark drop
    all but the first row per case before the shuffle."""
    newest = Window.partitionBy("application_id").orderBy(
        F.col("scored_at").desc_nulls_first(), F.col("model_version").desc_nulls_first()
    )
    return (
        predictions.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")
    )


def sla_risk_latest(cases: DataFrame, events: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per predicted case, from its newest prediction."""
    return _with_cases(cases, events, latest_predictions(predictions))


def select_predictions(predictions: DataFrame, model_version: str | None) -> DataFrame:
    """Predictions of one version, or the latest of each case when no version is named."""
    version = check.model_version(model_version)
    if version is None:
        return latest_predictions(predictions)
    return predictions.where(F.col("model_version") == version)


def _scored(cases: DataFrame, predictions: DataFrame, model_version: str | None) -> DataFrame:
    """Selected predictions of known cases, for reports that use prediction columns only:
    the views join the cases 1:1, so a semi-join gives the same rows."""
    chosen = select_predictions(predictions, model_version)
    return chosen.join(cases.select("application_id"), "application_id", "left_semi")


def _version(model_version: str | None):
    return F.lit(check.model_version(model_version)).cast("string").alias("model_version")


def prediction_coverage(
    cases: DataFrame, predictions: DataFrame, model_version: str | None = None
) -> DataFrame:
    """One row: cases, scored cases (of any version when none is named), the rest, share."""
    version = check.model_version(model_version)
    if version is not None:
        predictions = predictions.where(F.col("model_version") == version)
    total = cases.agg(F.count(F.lit(1)).alias("n"))
    scored = predictions.agg(F.countDistinct("application_id").alias("s"))
    n, s = F.col("n"), F.col("s")
    return total.crossJoin(F.broadcast(scored)).select(
        n.alias("total_applications"),
        s.alias("applications_with_predictions"),
        F.greatest(n - s, F.lit(0)).alias("applications_without_predictions"),
        E.share(s, n).alias("coverage_percentage"),
        _version(version),
    )


def risk_distribution(
    cases: DataFrame, predictions: DataFrame, model_version: str | None = None
) -> DataFrame:
    counted = (
        _scored(cases, predictions, model_version)
        .groupBy(F.col("risk_class").cast("int").alias("predicted_risk_class"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return (
        views.with_sum(counted, "_all", "count")
        .select(
            "predicted_risk_class",
            E.risk_label(F.col("predicted_risk_class")).alias("predicted_risk_label"),
            "count",
            E.share(F.col("count"), F.col("_all")).alias("percentage"),
            _version(model_version),
        )
        .orderBy(F.col("predicted_risk_class").asc_nulls_last())
    )


def risk_probability_bands(
    cases: DataFrame, predictions: DataFrame, model_version: str | None = None
) -> DataFrame:
    """Always five rows: one aggregate per band over a single row, then unpivoted."""
    band = E.probability_band(F.col("risk_probability"))
    names = [name for _, _, name in E.PROBABILITY_BANDS]
    counts = _scored(cases, predictions, model_version).agg(
        *[F.count_if(band == name).alias(f"b{i}") for i, name in enumerate(names)]
    )
    rows = F.array(*[
        F.struct(F.lit(name).alias("probability_band"), F.col(f"b{i}").alias("count"))
        for i, name in enumerate(names)
    ])
    total = sum((F.col(f"b{i}") for i in range(1, len(names))), F.col("b0"))
    return (
        counts.select(total.alias("_all"), F.explode(rows).alias("r"))
        .select(
            "r.probability_band", "r.count",
            E.share(F.col("r.count"), F.col("_all")).alias("percentage"),
            _version(model_version),
        )
        .orderBy("probability_band")
    )


def predicted_processing_time_summary(
    cases: DataFrame, predictions: DataFrame, model_version: str | None = None
) -> DataFrame:
    """One row of statistics. Predictions have two decimals, so they are first reduced to
    one row per distinct value and stored; the exact median is selected from these."""
    days = F.col("predicted_processing_days")
    scored = _scored(cases, predictions, model_version)
    values = staged(scored.groupBy(days).agg(F.count(F.lit(1)).alias("n")), "predicted-days")
    median = quantiles.exact_quantiles(values, "predicted_processing_days", [0.5], weight="n")[0]
    n = F.col("n")
    zero = lambda c: F.bround(F.coalesce(c.cast("double"), F.lit(0.0)), 2)
    known = F.when(days.isNotNull(), n)
    return (
        values.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
            F.sum(days * known.cast("decimal(18,0)")).alias("total"),
            F.sum(known).alias("known"),
            F.min(days).alias("lo"),
            F.max(days).alias("hi"),
        )
        .select(
            "count",
            zero(E.mean(F.col("total"), F.col("known"))).alias("mean_days"),
            zero(F.lit(median)).alias("median_days"),
            zero(F.col("lo")).alias("min_days"),
            zero(F.col("hi")).alias("max_days"),
            _version(model_version),
        )
    )


def prediction_error_summary(
    cases: DataFrame, events: DataFrame, predictions: DataFrame, model_version: str | None = None
) -> DataFrame:
    """One row: size, MAE, RMSE and signed mean error of finished cases. Errors have two
    decimals and are summed exactly."""
    chosen = select_predictions(predictions, model_version)
    error = F.col("processing_days_error").cast("decimal(12,2)")
    measured = (
        sla_risk(cases, events, chosen)
        .where(F.col("actual_processing_days").isNotNull() & F.col("processing_days_error").isNotNull())
        .agg(
            F.count(error).alias("n"), F.sum(F.abs(error)).alias("abs"),
            F.sum(error * error).alias("sq"), F.sum(error).alias("sum"),
        )
    )
    n = F.col("n")
    zero = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 2)
    return measured.select(
        n.alias("evaluated_count"),
        zero(E.mean(F.col("abs"), n)).alias("mae_days"),
        zero(F.sqrt(E.mean(F.col("sq"), n))).alias("rmse_days"),
        zero(E.mean(F.col("sum"), n)).alias("mean_error_days"),
        _version(model_version),
    )


def high_risk_applications(
    cases: DataFrame,
    predictions: DataFrame,
    min_probability: float = 0.5,
    limit: int = 50,
    model_version: str | None = None,
) -> DataFrame:
    """The riskiest cases at or above the threshold. Rank comes before threshold: a case
    whose latest prediction is below it stays out."""
    p = check.probability(min_probability)
    limit = check.positive_int(limit)
    chosen = select_predictions(predictions, model_version).where(
        F.col("risk_probability").cast("double") >= F.lit(p)
    )
    return (
        chosen.join(
            cases.select("application_id", "application_type", "loan_goal", "requested_amount", "status"),
            "application_id",
        )
        .select(
            "application_id", "application_type", "loan_goal",
            E.zero_if_null(F.col("requested_amount")).alias("requested_amount"),
            F.col("status").alias("application_status"),
            F.col("risk_class").cast("int").alias("predicted_risk_class"),
            E.risk_label(F.col("risk_class")).alias("predicted_risk_label"),
            F.col("risk_probability").cast("double").alias("predicted_risk_probability"),
            F.col("predicted_processing_days").cast("double").alias("predicted_processing_days"),
            "model_version",
            F.date_format("scored_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("scored_at"),
        )
        .orderBy(F.col("predicted_risk_probability").desc(), F.col("application_id").asc())
        .limit(limit)
    )


def version_comparison(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Stored predictions per model version."""
    known = predictions.join(cases.select("application_id"), "application_id", "left_semi")
    return known.groupBy("model_version").agg(F.count(F.lit(1)).alias("predictions")).orderBy("model_version")
