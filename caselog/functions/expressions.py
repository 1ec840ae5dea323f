"""Column expressions shared by the plans. All are built-in functions, so they stay
inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3.6e9
MICROS_PER_DAY = 8.64e10

# Duration bucket names in report order.
DURATION_BUCKETS = ("< 1 hour", "1-24 hours", "1-7 days", "1-4 weeks", "> 4 weeks")

# Lower bounds and names of the probability bands; the last band is closed.
PROBABILITY_BANDS = (
    ("0.0", "0.2", "0.0 - 0.2"),
    ("0.2", "0.4", "0.2 - 0.4"),
    ("0.4", "0.6", "0.4 - 0.6"),
    ("0.6", "0.8", "0.6 - 0.8"),
    ("0.8", "1.0", "0.8 - 1.0"),
)

# Offer activity -> offer status.
OFFER_STATUS = {
    "O_Created": "Created",
    "O_Create Offer": "Created",
    "O_Sent (mail and online)": "Sent",
    "O_Sent (online only)": "Sent",
    "O_Accepted": "Accepted",
    "O_Returned": "Returned",
    "O_Refused": "Refused",
    "O_Cancelled": "Cancelled",
}

# Statuses that mark a case as finished.
FINISHED_STATUSES = ("complete", "COMPLETED", "COMPLETE")


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent; NULL when the whole is 0."""
    whole = whole.cast("double")
    return F.round(F.when(whole != 0, part.cast("double") * F.lit(100.0) / whole), digits)


def share(part: Column, whole: Column) -> Column:
    """Share in percent as the prediction reports state it: ties go to the even digit, and
    an empty whole gives 0."""
    whole = whole.cast("double")
    return F.coalesce(F.bround(F.when(whole != 0, part.cast("double") / whole * F.lit(100.0)), 2), F.lit(0.0))


def mean(total: Column, n: Column, digits: int | None = None) -> Column:
    """Quotient of an exact sum and a count, as double; NULL for an empty group."""
    value = F.when(n > 0, total.cast("double") / n.cast("double"))
    return value if digits is None else F.round(value, digits)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def elapsed_micros(start: Column, end: Column) -> Column:
    """Exact length of an interval in microseconds (bigint)."""
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


def exact_sum(value: Column) -> Column:
    """Sum of a bigint without overflow and without order-dependent float error."""
    return F.sum(value.cast("decimal(20,0)"))


def begins(name: Column, letter: str) -> Column:
    """The SQL pattern ``X_%``: the underscore stands for any one character, so this is
    the letter plus at least one more. Spelled as a prefix test because that is a byte
    comparison (and a Parquet filter) where LIKE with ``_`` runs a regex per row."""
    return name.startswith(letter) & (F.length(name) > 1)


def activity_type(activity: Column) -> Column:
    return (
        F.when(begins(activity, "W"), "Workflow")
        .when(begins(activity, "O"), "Offer")
        .when(begins(activity, "A"), "Application")
        .otherwise("Other")
    )


def duration_bucket(micros: Column) -> Column:
    """Bucket of a duration; an unknown duration falls into the last one."""
    hours, days = micros / F.lit(MICROS_PER_HOUR), micros / F.lit(MICROS_PER_DAY)
    b = DURATION_BUCKETS
    return (
        F.when(hours < 1, b[0]).when(hours < 24, b[1]).when(days < 7, b[2]).when(days < 30, b[3])
        .otherwise(b[4])
    )


def bucket_rank(bucket: Column) -> Column:
    rank = F.when(bucket == DURATION_BUCKETS[0], 1)
    for i, name in enumerate(DURATION_BUCKETS[1:4], start=2):
        rank = rank.when(bucket == name, i)
    return rank.otherwise(len(DURATION_BUCKETS))


def offer_status(activity: Column) -> Column:
    status = F
    for name, value in OFFER_STATUS.items():
        status = status.when(activity == name, value)
    return status.otherwise("Other")


def risk_label(risk_class: Column) -> Column:
    return F.when(risk_class == 1, "High Risk").otherwise("Low Risk")


def processing_error(status: Column, complete_count: Column, actual: Column, predicted: Column) -> Column:
    """Actual minus predicted days for finished cases. An unknown status leaves the test
    unknown, and a CASE without a true branch is NULL."""
    finished = status.isin(*FINISHED_STATUSES) | (complete_count > 0)
    return F.when(finished, F.round(actual - predicted.cast("double"), 2))


def probability_band(p: Column) -> Column:
    p = p.cast("decimal(12,6)")
    band = F
    for low, high, name in PROBABILITY_BANDS:
        below = p <= F.lit(high).cast("decimal(2,1)") if high == "1.0" else p < F.lit(high).cast("decimal(2,1)")
        band = band.when((p >= F.lit(low).cast("decimal(2,1)")) & below, name)
    return band


def hash_slice(digest: Column, start: int, length: int) -> Column:
    """Hex digits of a digest as a bigint (``start`` counts from 1)."""
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")
