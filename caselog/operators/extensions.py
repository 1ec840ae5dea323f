"""Synthetic operational attributes of cases, derived from a hash of (seed, case id).

A row depends on nothing but the seed and its own id, so the result is the same for any
order, partitioning or retry, and the job is a map without a shuffle. One digest per
case is cut into ten slices of six hex digits, one per drawn attribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.functions import expressions as E

LINEAGE_TAG = "synthetic"

# Priorities with their weights in percent and SLA targets in hours.
PRIORITIES = (("low", 25, 72), ("normal", 50, 48), ("high", 20, 24), ("urgent", 5, 12))

# Attribute domains.
DOCUMENT_TYPES = (
    "Mortgage Application", "Personal Loan Request", "Proof of Income", "Identity Verification", "Tax Return",
)
BRANCHES = (
    "Branch North", "Branch South", "Branch East", "Branch West", "Branch Central",
    "Branch Metro", "Branch Regional", "Branch Harbour", "Branch Valley", "Branch Highland",
)
OPERATOR_TEAMS = ("Team Alpha", "Team Beta", "Team Gamma", "Team Delta", "FastTrack Ops")
REGIONS = ("North", "South", "East", "West", "Central")
CHANNELS = ("Online Portal", "Mobile App", "In-Person Branch", "Partner Referral", "Mail/Post")

# Ranges and rates.
PAGES = (1, 25)
QUALITY = (65.0, 100.0)
ERROR_PERCENT, REJECTION_PERCENT = 8, 5

SLICE_DIGITS = 6
SLICE_VALUES = 16 ** SLICE_DIGITS


def _pick(draw: Column, n: int) -> Column:
    """Uniform whole number below ``n`` from a draw below SLICE_VALUES."""
    return F.floor(draw * n / SLICE_VALUES).cast("int")


def _choice(draw: Column, domain: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in domain]), _pick(draw, len(domain)) + 1)


def _percent(draw: Column, percent: int) -> Column:
    """True with the given probability; whole-number arithmetic, so no rounding at the edge."""
    return draw * 100 < F.lit(percent * SLICE_VALUES)


def sla_hours(priority: Column) -> Column:
    hours = F
    for name, _, target in PRIORITIES:
        hours = hours.when(priority == name, target)
    return hours


def generate(cases: DataFrame, seed: int = 42) -> DataFrame:
    """One extension row per case. A blank or missing id raises when the row is computed."""
    trimmed = F.trim("application_id")
    case_id = F.when(F.length(trimmed) > 0, trimmed).otherwise(
        F.raise_error(F.lit("application_id must be a non-empty string"))
    )
    drawn = cases.select(case_id.alias("application_id")).withColumn(
        "_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("application_id")), 256)
    )
    draws = iter([E.hash_slice(F.col("_h"), 1 + SLICE_DIGITS * i, SLICE_DIGITS) for i in range(10)])
    weight = next(draws)
    priority, reached = F, 0
    for name, share, _ in PRIORITIES:
        reached += share
        priority = priority.when(_percent(weight, reached), name)
    row = drawn.withColumn("priority", priority)
    lowest, width = QUALITY[0], QUALITY[1] - QUALITY[0]
    return row.select(
        "application_id",
        _choice(next(draws), DOCUMENT_TYPES).alias("document_type"),
        (_pick(next(draws), PAGES[1] - PAGES[0] + 1) + PAGES[0]).alias("page_count"),
        _choice(next(draws), BRANCHES).alias("branch"),
        _choice(next(draws), OPERATOR_TEAMS).alias("operator_team"),
        "priority",
        sla_hours(F.col("priority")).alias("sla_target_hours"),
        _choice(next(draws), REGIONS).alias("region"),
        _choice(next(draws), CHANNELS).alias("channel"),
        F.round(F.lit(lowest) + next(draws) * F.lit(width) / SLICE_VALUES, 2)
        .cast("decimal(5,2)").alias("quality_score"),
        _percent(next(draws), ERROR_PERCENT).alias("error_flag"),
        _percent(next(draws), REJECTION_PERCENT).alias("rejection_flag"),
        F.lit(LINEAGE_TAG).alias("lineage_tag"),
    )


def with_broken_rules(extensions: DataFrame) -> DataFrame:
    """Add the names of the table rules each row breaks."""
    names = [name for name, _, _ in PRIORITIES]
    rules = {
        "blank application_id": F.coalesce(F.trim("application_id"), F.lit("")) == "",
        "unknown priority": ~F.coalesce(F.col("priority").isin(*names), F.lit(False)),
        "sla target mismatch": F.col("priority").isin(*names)
        & ~F.coalesce(F.col("sla_target_hours") == sla_hours(F.col("priority")), F.lit(False)),
        "quality_score out of bounds": ~F.coalesce(F.col("quality_score").between(*QUALITY), F.lit(False)),
        "page_count below 1": ~F.coalesce(F.col("page_count") >= 1, F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    return extensions.withColumn("broken_rules", broken)


def violations(extensions: DataFrame) -> DataFrame:
    return with_broken_rules(extensions).where(F.size("broken_rules") > 0)


def checked(extensions: DataFrame) -> DataFrame:
    """The same rows; computing one that breaks a rule raises an error."""
    broken = F.col("broken_rules")
    return with_broken_rules(extensions).withColumn(
        "application_id",
        F.when(F.size(broken) == 0, F.col("application_id")).otherwise(F.raise_error(F.concat(
            F.lit("invalid extension of "), F.coalesce("application_id", F.lit("?")), F.lit(": "),
            F.array_join(broken, ", "),
        ))),
    ).drop("broken_rules")
