"""From traces to the case and event tables.

A trace is one row, so its times are rolled up inside the row; only the first-wins and
last-wins choices between traces need a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.sources import xes

POSITION = ("source_file", "trace_pos")


class Loaded(NamedTuple):
    cases: DataFrame
    events: DataFrame
    rejected: DataFrame


def _named(traces: DataFrame) -> DataFrame:
    name = xes.strip(xes.attribute(F.col("attributes"), "concept:name"))
    return traces.withColumn("application_id", name).where(F.col("application_id") != "")


def _event_times() -> Column:
    """Readable times of the events that carry an id."""
    with_id = F.filter("events", lambda e: xes.attribute(e, "EventID") != "")
    times = F.transform(with_id, lambda e: xes.parse_time(xes.attribute(e, "time:timestamp")))
    return F.array_compact(times)


def load_cases(traces: DataFrame) -> DataFrame:
    """One row per named case. A repeated name keeps the attributes of its first trace and
    the times of the last trace that has any. Both picks are aggregates with map-side
    merging, so a name that fills the log still reduces before the shuffle."""
    a = F.col("attributes")
    amount = xes.strip(xes.attribute(a, "RequestedAmount"))
    times = F.col("_times")
    place = F.struct(*POSITION)
    rows = _named(traces).withColumn("_times", _event_times()).select(
        "application_id",
        place.alias("_at"),
        F.struct(
            xes.attribute(a, "ApplicationType").alias("application_type"),
            xes.attribute(a, "LoanGoal").alias("loan_goal"),
            F.when(amount == "", F.lit(0.0)).otherwise(amount.cast("double"))
            .cast("decimal(15,2)").alias("requested_amount"),
        ).alias("_attributes"),
        F.when(F.size(times) > 0, place).alias("_timed_at"),
        F.struct(
            F.array_min(times).alias("first_event_time"),
            F.array_max(times).alias("last_event_time"),
            F.size(times).alias("event_count"),
        ).alias("_span"),
    )
    picked = rows.groupBy("application_id").agg(
        F.min_by("_attributes", "_at").alias("c"), F.max_by("_span", "_timed_at").alias("s")
    )
    return picked.select(
        "application_id", "c.application_type", "c.loan_goal", "c.requested_amount",
        "s.first_event_time", "s.last_event_time",
        F.coalesce("s.event_count", F.lit(0)).alias("event_count"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("event_origin"),
    )


def _first_wins(events: DataFrame) -> DataFrame:
    """The filter on the row number makes Spark keep one row per id and task before the
    shuffle, so a heavily repeated id costs no more than a rare one."""
    w = Window.partitionBy("event_id").orderBy(*POSITION, "event_pos")
    return events.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == 1).drop("_nth")


def repeated_ids(events: DataFrame) -> DataFrame:
    """Hashes of event ids that occur more than once: 8 bytes of an event are sent."""
    counts = events.groupBy(F.xxhash64("event_id").alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > 1).select("_hash")


def first_of_each(events: DataFrame, repeated: DataFrame) -> DataFrame:
    """The first event of each id. An id whose hash occurs once occurs once, so that whole rows are
    sorted only for the ``repeated_ids``; ids that merely share a hash keep a row each."""
    hashed = events.withColumn("_hash", F.xxhash64("event_id"))
    of_repeated = lambda kind: hashed.join(repeated, "_hash", kind).drop("_hash")
    return of_repeated("left_anti").unionByName(_first_wins(of_repeated("left_semi")))


def timed_events(traces: DataFrame, fail_on_bad_time: bool = False, every: bool = False) -> DataFrame:
    """Events with an id, of named cases, the first of each id or ``every`` one; ``event_timestamp`` is
    NULL where the time cannot be read. With ``fail_on_bad_time`` such an event stops the load."""
    flat = xes.flatten_events(traces, keep="first").where(
        (F.col("document_id") != "") & (F.col("event_id") != "")
    )
    time = xes.parse_time(F.col("raw_time"))
    if fail_on_bad_time:
        time = F.coalesce(time, F.raise_error(
            F.concat(F.lit("unreadable time of event "), F.col("event_id"))).cast("timestamp"))
    timed = flat.withColumn("event_timestamp", time)
    return timed if every else _first_wins(timed)


def by_time(timed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``timed_events`` as events, and as those whose time cannot be read."""
    columns = ("event_id", F.col("document_id").alias("application_id"), "activity", "event_timestamp",
               "resource", "lifecycle_transition", "action", "event_origin")
    good = timed.where(F.col("event_timestamp").isNotNull()).select(*columns)
    bad = timed.where(F.col("event_timestamp").isNull()).select(
        "event_id", F.col("document_id").alias("application_id"), "raw_time", *POSITION, "event_pos"
    )
    return good, bad


def load_events(traces: DataFrame, fail_on_bad_time: bool = False) -> tuple[DataFrame, DataFrame]:
    """Events with an id, of named cases, the first of each id; and those whose time
    cannot be read. With ``fail_on_bad_time`` such an event stops the load instead."""
    return by_time(timed_events(traces, fail_on_bad_time))


def load(traces: DataFrame, fail_on_bad_time: bool = False) -> Loaded:
    events, rejected = load_events(traces, fail_on_bad_time)
    return Loaded(load_cases(traces), events, rejected)


def case_rollup(events: DataFrame) -> DataFrame:
    """Span and size of each case from an event table."""
    return events.groupBy("application_id").agg(
        F.min("event_timestamp").alias("first_event_time"),
        F.max("event_timestamp").alias("last_event_time"),
        F.count("event_timestamp").cast("int").alias("event_count"),
    )


def new_events(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """Incoming events whose id is not stored yet (a repeated load adds nothing). Of the
    stored ones only the keys are read; a bucket among them prunes what is read."""
    return incoming.join(existing.select(*keys), list(keys), "left_anti")


def merge_cases(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored cases keep their attributes; times are replaced where the new load has any."""
    known = F.col("o._stored").isNotNull()
    timed = F.col("n.event_count") > 0
    attributes = ("application_type", "loan_goal", "requested_amount", "status", "event_origin")
    spans = ("first_event_time", "last_event_time", "event_count")
    spans += ("updated_at",) if "updated_at" in existing.columns else ()
    first = ("created_at",) if "created_at" in existing.columns else ()
    joined = (
        existing.withColumn("_stored", F.lit(1)).alias("o")
        .join(incoming.alias("n"), "application_id", "full_outer")
    )
    return joined.select(
        "application_id",
        *[F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in attributes],
        *[F.when(timed | ~known, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in spans],
        *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in first],
    ).select(*existing.columns)
