"""The analytical views, one function each: base tables in, view out.

Each event is read once per view and reduced map-side before any shuffle. Denominators
are one-row aggregates, the only thing broadcast here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.functions import expressions as E
from caselog.operators import ordered

LIFECYCLE = ("complete", "suspend", "withdraw")


def _n() -> Column:
    return F.count(F.lit(1))


def _micros() -> Column:
    return E.elapsed_micros(F.col("first_event_time"), F.col("last_event_time"))


def with_count(grouped: DataFrame, total: str, source: DataFrame) -> DataFrame:
    """Attach the number of source rows, a one-row aggregate. On a stored table it needs no
    column and is answered from file metadata, so the groups are not computed twice and
    never gathered in one task."""
    whole = source.agg(_n().alias(total))
    return grouped.crossJoin(F.broadcast(whole))


def with_sum(grouped: DataFrame, total: str, part: str) -> DataFrame:
    """Attach the sum of ``part`` over all rows. Only for groups with a fixed, small number
    of values (buckets, classes, types): they meet in one task."""
    return grouped.withColumn(total, F.sum(part).over(Window.partitionBy(F.lit(0))))


def event_counts_by_case(events: DataFrame) -> DataFrame:
    """The six per-case event counts in one aggregation."""
    step, name = F.col("lifecycle_transition"), F.col("activity")
    return events.groupBy("application_id").agg(
        *[F.count_if(step == s).alias(f"{s}_count") for s in LIFECYCLE],
        F.count_if(E.begins(name, "W")).alias("workflow_activity_count"),
        F.count_if(E.begins(name, "O")).alias("offer_activity_count"),
        F.count_if(E.begins(name, "A")).alias("application_activity_count"),
    )


def case_metrics(cases: DataFrame, events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per case: attributes, duration, event counts, calendar parts.

    ``carry`` keeps further case columns, so that plans building on this view need no
    second join with the cases.
    """
    counts = event_counts_by_case(events)
    first = F.col("first_event_time")
    return cases.join(counts, "application_id", "left").select(
        "application_id", "application_type", "loan_goal", "requested_amount", "event_count",
        "first_event_time", "last_event_time",
        (_micros() / E.MICROS_PER_HOUR).alias("processing_hours"),
        (_micros() / E.MICROS_PER_DAY).alias("processing_days"),
        *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counts.columns[1:]],
        F.to_date(first).alias("first_date"),
        F.year(first).alias("first_year"),
        F.month(first).alias("first_month"),
        F.weekofyear(first).alias("first_week"),
        *carry,
    )


def case_durations(cases: DataFrame) -> DataFrame:
    """Durations alone, for plans that need no event counts (no join, no shuffle)."""
    return cases.select(
        "*",
        _micros().alias("processing_micros"),
        (_micros() / E.MICROS_PER_HOUR).alias("processing_hours"),
        (_micros() / E.MICROS_PER_DAY).alias("processing_days"),
    )


def daily_throughput(cases: DataFrame) -> DataFrame:
    return (
        cases.groupBy(F.to_date("first_event_time").alias("date"))
        .agg(_n().alias("applications_started"), F.sum("event_count").alias("total_events"))
        .orderBy(F.col("date").asc_nulls_last())
    )


#: Sketches of 2^14 registers: a standard error of 0.8 %, 16 KB at most for a group.
SKETCH_BITS = 14


def _distinct(column: str, approximate: bool) -> Column:
    """Distinct values, counted exactly or estimated by a mergeable HyperLogLog sketch, which
    moves a sketch a group and task in place of every pair of group and value."""
    if approximate:
        return F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(SKETCH_BITS)))
    return F.countDistinct(column)


def _activity_counts(events: DataFrame, lifecycle: bool, approximate: bool = False) -> DataFrame:
    step = F.col("lifecycle_transition")
    counted = events.groupBy("activity").agg(
        _n().alias("event_count"),
        _distinct("application_id", approximate).alias("unique_applications"),
        *([F.count_if(step == s).alias(f"_{s}") for s in LIFECYCLE] if lifecycle else []),
    )
    return with_count(counted, "_all", events)


def _by_count(df: DataFrame, key: str, n: str = "event_count") -> DataFrame:
    return df.orderBy(F.col(n).desc(), F.col(key).asc_nulls_last())


def activity_summary(events: DataFrame, approximate: bool = False) -> DataFrame:
    """``approximate`` estimates the distinct cases (here and in the views below)."""
    n = F.col("event_count")
    return _by_count(
        _activity_counts(events, True, approximate).select(
            "activity", "event_count", "unique_applications",
            E.pct(n, F.col("_all")).alias("percentage_of_total"),
            E.activity_type(F.col("activity")).alias("activity_type"),
            *[E.pct(F.col(f"_{s}"), n).alias(f"{s}_pct") for s in LIFECYCLE],
        ),
        "activity",
    )


def _resource_counts(events: DataFrame, times: bool, approximate: bool = False) -> DataFrame:
    """Two narrow aggregations instead of one with two distinct counts, which would triple
    every row. The (resource, activity) counts collapse map-side and serve the event
    counts, the distinct activities and (over the same shuffle) the total; the
    (resource, case) pairs are the one large shuffle."""
    known = events.where(F.col("resource").isNotNull())
    if approximate:
        sketched = known.groupBy("resource").agg(
            _n().alias("event_count"), _distinct("activity", True).alias("unique_activities"),
            _distinct("application_id", True).alias("applications_handled"),
            *([F.min("event_timestamp").alias("first_event"), F.max("event_timestamp").alias("last_event")] if times else []))
        return with_count(sketched, "_all", known)
    activities = known.groupBy("resource", "activity").agg(_n().alias("n"))
    counts = activities.groupBy("resource").agg(
        F.sum("n").alias("event_count"), F.count("activity").alias("unique_activities")
    )
    pairs = known.groupBy("resource", "application_id")
    pairs = pairs.agg(
        F.min("event_timestamp").alias("t0"), F.max("event_timestamp").alias("t1")
    ) if times else known.select("resource", "application_id").distinct()
    handled = pairs.groupBy("resource").agg(
        F.count("application_id").alias("applications_handled"),
        *([F.min("t0").alias("first_event"), F.max("t1").alias("last_event")] if times else []),
    )
    total = activities.agg(F.sum("n").alias("_all"))
    return counts.join(handled, "resource").crossJoin(F.broadcast(total))


def resource_workload(events: DataFrame, approximate: bool = False) -> DataFrame:
    return _by_count(
        _resource_counts(events, True, approximate).select(
            "resource", "event_count", "applications_handled",
            E.pct(F.col("event_count"), F.col("_all")).alias("workload_percentage"),
            "unique_activities", "first_event", "last_event",
        ),
        "resource",
    )


def _case_means(*extra: Column) -> list[Column]:
    return [
        _n().alias("application_count"),
        F.sum("event_count").alias("_events"),
        F.count("event_count").alias("_events_n"),
        E.exact_sum(_micros()).alias("_micros"),
        F.count(_micros()).alias("_micros_n"),
        F.sum("requested_amount").alias("_amount"),
        F.count("requested_amount").alias("_amount_n"),
        *extra,
    ]


def _avg_events(digits: int | None = 1) -> Column:
    return E.mean(F.col("_events"), F.col("_events_n"), digits)


def _avg_time(unit: float, digits: int | None = 2) -> Column:
    value = E.mean(F.col("_micros"), F.col("_micros_n")) / F.lit(unit)
    return value if digits is None else F.round(value, digits)


def _avg_amount() -> Column:
    return E.mean(F.col("_amount"), F.col("_amount_n"), 2)


def application_type_metrics(cases: DataFrame, approximate: bool = False) -> DataFrame:
    return _by_count(
        cases.where(F.col("application_type").isNotNull())
        .groupBy("application_type")
        .agg(*_case_means(
            F.min("first_event_time").alias("earliest_application"),
            F.max("last_event_time").alias("latest_application"),
            _distinct("loan_goal", approximate).alias("unique_loan_goals"),
        ))
        .select(
            "application_type", "application_count",
            _avg_events().alias("avg_events_per_application"),
            _avg_time(E.MICROS_PER_HOUR).alias("avg_processing_hours"),
            "earliest_application", "latest_application", "unique_loan_goals",
            _avg_amount().alias("avg_requested_amount"),
        ),
        "application_type", "application_count",
    )


def loan_goal_metrics(cases: DataFrame) -> DataFrame:
    return _by_count(
        cases.where(F.col("loan_goal").isNotNull())
        .groupBy("loan_goal")
        .agg(*_case_means(
            F.min("first_event_time").alias("first_date"), F.max("last_event_time").alias("last_date"),
        ))
        .select(
            "loan_goal", "application_count",
            _avg_events().alias("avg_events"),
            _avg_time(E.MICROS_PER_HOUR).alias("avg_processing_hours"),
            _avg_amount().alias("avg_requested_amount"),
            "first_date", "last_date",
        ),
        "loan_goal", "application_count",
    )


def lifecycle_transition_metrics(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Shares of all events, so the group without a transition is counted and then dropped."""
    name, n = F.col("activity"), F.col("event_count")
    counted = events.groupBy("lifecycle_transition").agg(
        _n().alias("event_count"),
        _distinct("application_id", approximate).alias("applications_affected"),
        F.count_if(E.begins(name, "W")).alias("_w"),
        F.count_if(E.begins(name, "O")).alias("_o"),
        F.count_if(E.begins(name, "A")).alias("_a"),
    )
    return _by_count(
        with_count(counted, "_all", events)
        .where(F.col("lifecycle_transition").isNotNull())
        .select(
            "lifecycle_transition", "event_count", "applications_affected",
            E.pct(n, F.col("_all")).alias("percentage"),
            E.pct(F.col("_w"), n).alias("workflow_pct"),
            E.pct(F.col("_o"), n).alias("offer_pct"),
            E.pct(F.col("_a"), n).alias("application_pct"),
        ),
        "lifecycle_transition",
    )


def event_origin_metrics(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Two scans: (origin, activity) counts serve the event counts, the distinct activities
    and the total over one shuffle; the distinct cases are the other. With sketches, one."""
    if approximate:
        sketched = events.groupBy("event_origin").agg(
            _n().alias("event_count"), _distinct("application_id", True).alias("applications_affected"),
            _distinct("activity", True).alias("unique_activities"))
        return _by_count(
            with_count(sketched, "_all", events).where(F.col("event_origin").isNotNull()).select(
                "event_origin", "event_count", "applications_affected", "unique_activities",
                E.pct(F.col("event_count"), F.col("_all")).alias("percentage")),
            "event_origin")
    activities = events.groupBy("event_origin", "activity").agg(_n().alias("n"))
    counted = activities.where(F.col("event_origin").isNotNull()).groupBy("event_origin").agg(
        F.sum("n").alias("event_count"), F.count("activity").alias("unique_activities")
    )
    handled = events.where(F.col("event_origin").isNotNull()).select("event_origin", "application_id").distinct()
    handled = handled.groupBy("event_origin").agg(F.count("application_id").alias("applications_affected"))
    total = activities.agg(F.sum("n").alias("_all"))
    return _by_count(
        counted.join(handled, "event_origin").crossJoin(F.broadcast(total)).select(
            "event_origin", "event_count", "applications_affected", "unique_activities",
            E.pct(F.col("event_count"), F.col("_all")).alias("percentage"),
        ),
        "event_origin",
    )


def monthly_summary(cases: DataFrame) -> DataFrame:
    """Types and goals are few, so cases are first reduced to (month, type, goal); the two
    distinct counts then run on those few rows."""
    month = F.date_trunc("month", "first_event_time").alias("_month")
    small = cases.groupBy(month, "application_type", "loan_goal").agg(*_case_means())
    return (
        small.groupBy("_month")
        .agg(
            F.sum("application_count").alias("applications"),
            *[F.sum(c).alias(c) for c in ("_events", "_events_n", "_micros", "_micros_n")],
            F.countDistinct("application_type").alias("application_types"),
            F.countDistinct("loan_goal").alias("loan_goals"),
        )
        .select(
            F.year("_month").alias("year"),
            F.month("_month").alias("month"),
            F.date_format("_month", "yyyy-MM").alias("year_month"),
            "applications",
            F.col("_events").alias("total_events"),
            _avg_events().alias("avg_events_per_app"),
            _avg_time(E.MICROS_PER_DAY).alias("avg_processing_days"),
            "application_types", "loan_goals",
        )
        .orderBy(F.col("year").asc_nulls_last(), F.col("month").asc_nulls_last())
    )


def weekly_summary(cases: DataFrame) -> DataFrame:
    """Calendar year with ISO week, so a week across New Year gives two rows. The case id
    is the primary key of the cases: counting rows counts distinct cases."""
    first = F.col("first_event_time")
    return (
        cases.groupBy(
            F.year(first).alias("year"),
            F.weekofyear(first).alias("week"),
            F.date_trunc("week", first).alias("week_start"),
        )
        .agg(F.count("application_id").alias("applications"), F.sum("event_count").alias("events"))
        .orderBy(F.col("week_start").asc_nulls_last(), F.col("year").asc_nulls_last())
    )


def event_sequence(
    events: DataFrame, hot_rows: int | None = ordered.HOT_ROWS, cases: DataFrame | None = None
) -> DataFrame:
    """Events of a case in time order with position and neighbours. ``cases``, the case table,
    saves counting the events of each case: its event_count is read instead."""
    base = events.select(
        "event_id", "application_id", "activity", "event_timestamp", "resource",
        "lifecycle_transition", "event_origin",
    )
    placed = ordered.neighbours(
        base, ["application_id"], ["event_timestamp", "event_id"],
        position="event_sequence",
        lags={"prev_activity": "activity"},
        leads={"next_activity": "activity", "_next_time": "event_timestamp"},
        hot_rows=hot_rows,
        sizes=cases.select("application_id", F.col("event_count").alias("_n")) if cases is not None else None,
    )
    return placed.select(
        *base.columns, "event_sequence", "next_activity", "prev_activity",
        (F.col("_next_time") - F.col("event_timestamp")).alias("time_to_next"),
        (E.elapsed_micros(F.col("event_timestamp"), F.col("_next_time")) / 1e6).alias("seconds_to_next"),
    )


def processing_time_buckets(cases: DataFrame) -> DataFrame:
    counted = cases.groupBy(E.duration_bucket(_micros()).alias("bucket")).agg(
        _n().alias("application_count"),
        F.sum("event_count").alias("_events"),
        F.count("event_count").alias("_events_n"),
    )
    return (
        with_sum(counted, "_all", "application_count")
        .select(
            "bucket", "application_count",
            E.pct(F.col("application_count"), F.col("_all")).alias("percentage"),
            _avg_events().alias("avg_events"),
        )
        .orderBy(E.bucket_rank(F.col("bucket")))
    )


def offer_analysis(events: DataFrame) -> DataFrame:
    return _by_count(
        events.where(E.begins(F.col("activity"), "O"))
        .groupBy(E.offer_status(F.col("activity")).alias("offer_status"))
        .agg(_n().alias("event_count"), F.countDistinct("application_id").alias("applications")),
        "offer_status",
    )


def event_partials(events: DataFrame) -> DataFrame:
    """What the event views need of one load: a row for each activity, resource and case. The
    partials of all loads together give the views exactly, distinct counts included."""
    return events.groupBy("activity", "resource", "application_id").agg(_n().alias("n"))


def mv_activity_of_partials(partials: DataFrame) -> DataFrame:
    """``mv_activity_summary`` of the events that the partials count."""
    pairs = partials.groupBy("activity", "application_id").agg(F.sum("n").alias("n"))
    counted = pairs.groupBy("activity").agg(F.sum("n").alias("event_count"), F.count("application_id").alias("unique_applications"))
    return _by_count(
        counted.crossJoin(F.broadcast(partials.agg(F.sum("n").alias("_all")))).select(
            "activity", "event_count", "unique_applications",
            E.pct(F.col("event_count"), F.col("_all")).alias("percentage_of_total"),
            E.activity_type(F.col("activity")).alias("activity_type"),
        ),
        "activity",
    )


def mv_resource_of_partials(partials: DataFrame) -> DataFrame:
    """``mv_resource_workload`` of the events that the partials count."""
    known = partials.where(F.col("resource").isNotNull())
    activities = known.groupBy("resource", "activity").agg(F.sum("n").alias("n"))
    counts = activities.groupBy("resource").agg(F.sum("n").alias("event_count"), F.count("activity").alias("unique_activities"))
    handled = known.select("resource", "application_id").distinct().groupBy("resource").agg(
        F.count("application_id").alias("applications_handled"))
    joined = counts.join(handled, "resource").crossJoin(F.broadcast(known.agg(F.sum("n").alias("_all"))))
    return _by_count(
        joined.select(
            "resource", "event_count", "applications_handled",
            E.pct(F.col("event_count"), F.col("_all")).alias("workload_percentage"), "unique_activities",
        ),
        "resource",
    )


def mv_activity_summary(events: DataFrame) -> DataFrame:
    return _by_count(
        _activity_counts(events, lifecycle=False).select(
            "activity", "event_count", "unique_applications",
            E.pct(F.col("event_count"), F.col("_all")).alias("percentage_of_total"),
            E.activity_type(F.col("activity")).alias("activity_type"),
        ),
        "activity",
    )


def mv_resource_workload(events: DataFrame) -> DataFrame:
    return _by_count(
        _resource_counts(events, times=False).select(
            "resource", "event_count", "applications_handled",
            E.pct(F.col("event_count"), F.col("_all")).alias("workload_percentage"),
            "unique_activities",
        ),
        "resource",
    )


def mv_monthly_summary(cases: DataFrame) -> DataFrame:
    return monthly_summary(cases).drop("application_types", "loan_goals")


def mv_application_type_summary(cases: DataFrame) -> DataFrame:
    return application_type_metrics(cases).drop(
        "earliest_application", "latest_application", "unique_loan_goals"
    )


# View name -> (builder, tables it reads), in the order they are listed and refreshed.
VIEWS = {
    "application_metrics": (case_metrics, ("cases", "events")),
    "daily_throughput": (daily_throughput, ("cases",)),
    "activity_summary": (activity_summary, ("events",)),
    "resource_workload": (resource_workload, ("events",)),
    "application_type_metrics": (application_type_metrics, ("cases",)),
    "loan_goal_metrics": (loan_goal_metrics, ("cases",)),
    "lifecycle_transition_metrics": (lifecycle_transition_metrics, ("events",)),
    "event_origin_metrics": (event_origin_metrics, ("events",)),
    "monthly_summary": (monthly_summary, ("cases",)),
    "weekly_summary": (weekly_summary, ("cases",)),
    "event_sequence": (event_sequence, ("events",)),
    "processing_time_buckets": (processing_time_buckets, ("cases",)),
    "offer_analysis": (offer_analysis, ("events",)),
}

MATERIALIZED = {
    "mv_activity_summary": (mv_activity_summary, ("events",)),
    "mv_resource_workload": (mv_resource_workload, ("events",)),
    "mv_monthly_summary": (mv_monthly_summary, ("cases",)),
    "mv_application_type_summary": (mv_application_type_summary, ("cases",)),
}


def build(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Build a view by name from a dict of base tables."""
    builder, needs = {**VIEWS, **MATERIALIZED}[name]
    return builder(*[tables[t] for t in needs])
