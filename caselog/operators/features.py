"""Features known when a case is submitted, targets, and stratified splits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.functions import expressions as E
from caselog.functions import validation as check
from caselog.operators import ordered, quantiles
from caselog.plans import views
from caselog.session import staged

# Feature columns, by origin and kind.
REAL_NUMERIC = ("requested_amount", "submission_hour", "submission_day_of_week", "submission_month")
REAL_CATEGORICAL = ("application_type", "loan_goal")
SYNTHETIC_NUMERIC = ("page_count", "quality_score", "sla_target_hours")
SYNTHETIC_CATEGORICAL = ("document_type", "branch", "operator_team", "priority", "region", "channel")

# Columns only known after submission; a model must not see them.
LEAKAGE = (
    "event_count", "last_event_time", "processing_hours", "processing_days", "complete_count",
    "suspend_count", "withdraw_count", "workflow_activity_count", "offer_activity_count",
    "application_activity_count", "status", "error_flag", "rejection_flag",
)

# What scoring assumes of a case without extension attributes.
IMPUTED = {"page_count": 1, "quality_score": 85.0, "sla_target_hours": 48}

TARGETS = (
    "processing_days", "log_processing_days", "is_sla_breach_operational", "is_sla_breach_median",
    "is_sla_breach_strict",
)
SUBSETS = ("real", "full")
EXTENSION_COLUMNS = (
    "document_type", "page_count", "branch", "operator_team", "priority", "sla_target_hours", "region",
    "channel", "quality_score",
)


def numeric(subset: str = "full") -> tuple[str, ...]:
    check.one_of(subset, SUBSETS, "feature subset")
    return REAL_NUMERIC if subset == "real" else REAL_NUMERIC + SYNTHETIC_NUMERIC


def categorical(subset: str = "full") -> tuple[str, ...]:
    check.one_of(subset, SUBSETS, "feature subset")
    return REAL_CATEGORICAL if subset == "real" else REAL_CATEGORICAL + SYNTHETIC_CATEGORICAL


def columns(subset: str = "full") -> tuple[str, ...]:
    return numeric(subset) + categorical(subset)


def require(df_columns: Iterable[str], subset: str = "full") -> None:
    missing = [c for c in columns(subset) if c not in set(df_columns)]
    if missing:
        raise ValueError(f"missing required feature columns: {missing}")


def forbid_leakage(df_columns: Iterable[str]) -> None:
    leaking = [c for c in df_columns if c in LEAKAGE]
    if leaking:
        raise ValueError(f"columns not known at submission: {leaking}")


def submission_parts(first: Column) -> dict[str, Column]:
    """Calendar parts of the submission time; weekdays count from Monday = 0."""
    return {
        "submission_hour": F.hour(first),
        "submission_day_of_week": F.weekday(first),
        "submission_month": F.month(first),
        "is_weekend": (F.weekday(first) >= 5).cast("int"),
    }


def _typed(df: DataFrame) -> DataFrame:
    kinds = {"requested_amount": "double", "quality_score": "double", "page_count": "int", "sla_target_hours": "int"}
    return df.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def training_set(cases: DataFrame, extensions: DataFrame) -> DataFrame:
    """Cases with extension attributes and durations. Event counts are not needed, so the
    events are not read."""
    base = views.case_durations(cases).select(
        "application_id", "application_type", "loan_goal",
        F.coalesce("requested_amount", F.lit(0)).alias("requested_amount"),
        "first_event_time", "last_event_time", "processing_hours", "processing_days",
    )
    return base.join(
        extensions.select("application_id", *EXTENSION_COLUMNS, "error_flag", "rejection_flag"), "application_id"
    )


def case_features(cases: DataFrame, extensions: DataFrame, known_only: bool = False) -> DataFrame:
    """Features of cases for scoring: cases without extensions get the assumed values, or
    are left out with ``known_only``."""
    base = cases.select(
        "application_id", "application_type", "loan_goal",
        F.coalesce("requested_amount", F.lit(0)).alias("requested_amount"), "first_event_time",
    ).withColumns(submission_parts(F.col("first_event_time")))
    joined = base.join(
        extensions.select("application_id", *EXTENSION_COLUMNS), "application_id",
        "inner" if known_only else "left",
    )
    typed = _typed(joined)
    return typed if known_only else typed.fillna(IMPUTED)


def training_threshold(df: DataFrame, column: str = "processing_days", strategy: str = "median") -> float:
    """Median or mean of a training split."""
    check.one_of(strategy, ("median", "mean"), "threshold strategy")
    if strategy == "median":
        value = quantiles.exact_quantile(df, column)
    else:
        value = df.agg(F.avg(F.col(column).cast("double"))).first()[0]
    if value is None:
        raise ValueError(f"no values in {column}")
    return float(value)


def dataset_mean_days(df: DataFrame) -> float | None:
    micros = E.elapsed_micros(F.col("first_event_time"), F.col("last_event_time"))
    row = df.agg(E.mean(E.exact_sum(micros), F.count(micros)) / E.MICROS_PER_DAY).first()
    return row[0]


def _mean_days(spans: DataFrame) -> float | None:
    n = F.when(F.col("micros").isNotNull(), F.col("n"))
    total = F.sum(F.col("micros").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)"))
    return spans.agg(E.mean(total, F.sum(n)) / E.MICROS_PER_DAY).first()[0]


def prepare(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Id, features and targets of a training set. A comparison with a missing duration
    is not a breach; the threshold defaults to the mean of the dataset."""
    # one pass over the rows: distinct spans with their numbers, which are counted from then on
    spans = staged(
        df.groupBy("processing_days", E.elapsed_micros(F.col("first_event_time"), F.col("last_event_time")).alias("micros"))
        .agg(F.count(F.lit(1)).alias("n")), "durations")
    if threshold is None:
        threshold = _mean_days(spans)
    median = quantiles.exact_quantiles(spans, "processing_days", [0.5], weight="n")[0]
    days = F.col("processing_days")
    breach = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    typed = _typed(df.withColumns(submission_parts(F.col("first_event_time"))))
    result = typed.select(
        "application_id", *columns("full"),
        days,
        F.when(days.isNotNull(), F.log1p(F.greatest(days, F.lit(0.0)))).alias("log_processing_days"),
        breach(days > F.lit(threshold)).alias("is_sla_breach_operational"),
        breach(days > F.lit(median)).alias("is_sla_breach_median"),
        breach(F.col("processing_hours") > F.col("sla_target_hours")).alias("is_sla_breach_strict"),
    )
    forbid_leakage(c for c in result.columns if c not in TARGETS)
    return result


def _seeded_hash(key: str, seed: int) -> Column:
    """60 bits that order the rows of a label at random, the same for any partitioning."""
    return E.hash_slice(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), 1, 15)


def _shuffled_rank(df: DataFrame, label: str, key: str, seed: int, hot_rows: int | None) -> DataFrame:
    """Position of each row within its label in the order of a seeded hash. Labels are two
    groups holding everything, so positions come from the skew-aware operator."""
    hashed = df.withColumn("_h", _seeded_hash(key, seed))
    return ordered.neighbours(hashed, [label], ["_h", key], position="_nth", hot_rows=hot_rows).drop("_h")


def stratified_split(
    df: DataFrame, label: str, key: str = "application_id", test_share: float = 0.2, seed: int = 42,
    hot_rows: int | None = ordered.HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Train and test parts with the same label shares; the same seed gives the same parts
    for any partitioning.

    The test part of a label are the rows up to a threshold of their seeded hash, which a
    selection over label and hash finds, so that the rows themselves are filtered where they
    are. Only where rows tie at the threshold and not all of them belong to the test part are
    they ranked by key, in slices if there are more than ``hot_rows``."""
    hashes = staged(df.select(F.col(label).alias("_label"), _seeded_hash(key, seed).alias("key")), "split-hashes")
    wanted = hashes.groupBy("_label").agg(F.round(F.count(F.lit(1)) * test_share).cast("long").alias("rank"))
    limits = quantiles.select_per_group(hashes, "_label", wanted.where("rank > 0")).select(
        "_label", F.col("key").alias("_limit"), (F.col("rank") - F.col("below")).alias("_take"), (F.col("ties") > F.col("rank") - F.col("below")).alias("_split"))
    limits = staged(limits, "split-limits")
    hashed = df.withColumn("_h", _seeded_hash(key, seed))
    below = (F.col("_h") < F.col("_limit")) | (~F.col("_split") & (F.col("_h") == F.col("_limit")))
    met = hashed.join(limits, hashed[label].eqNullSafe(limits["_label"]), "left").withColumn(
        "_test", F.coalesce(below, F.lit(False)))  # a label without a limit has no test rows
    part = lambda test: met.where(test).select(*df.columns)
    if limits.where("_split").isEmpty():
        return part(~F.col("_test")), part(F.col("_test"))
    at_limit = F.coalesce(F.col("_split") & (F.col("_h") == F.col("_limit")), F.lit(False))
    ranked = ordered.neighbours(met.where(at_limit), [label], ["_h", key], position="_nth", hot_rows=hot_rows)
    chosen = lambda first: ranked.where(F.col("_nth") <= F.col("_take") if first else F.col("_nth") > F.col("_take")).select(*df.columns)
    return (part(~F.col("_test") & ~at_limit).unionByName(chosen(False)), part(F.col("_test")).unionByName(chosen(True)))


def with_folds(
    df: DataFrame, label: str, k: int = 5, key: str = "application_id", seed: int = 42,
    hot_rows: int | None = ordered.HOT_ROWS,
) -> DataFrame:
    """Add the fold (0 to k-1) of each row, labels spread evenly."""
    ranked = _shuffled_rank(df, label, key, seed, hot_rows)
    return ranked.select(*df.columns, ((F.col("_nth") - 1) % k).cast("int").alias("fold"))
