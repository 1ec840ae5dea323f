"""Operational report functions over the base tables.

Each returns a DataFrame: list reports one row per item, summary reports one row.
Missing and zero metrics read as 0.0, as report consumers expect numbers.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.functions import expressions as E
from caselog.functions import validation as check
from caselog.plans import views

# Most ids a limited report broadcasts; a larger limit joins by shuffle.
BROADCAST_ROWS = 100_000


def _metric(*names: str) -> dict[str, Column]:
    return {name: E.zero_if_null(F.col(name)) for name in names}


def total_applications(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias("total_applications"))


def total_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total_events"))


def application_volume_by_type(cases: DataFrame) -> DataFrame:
    return views.mv_application_type_summary(cases).withColumns(
        _metric("avg_events_per_application", "avg_processing_hours", "avg_requested_amount")
    )


def application_volume_over_time(
    cases: DataFrame, granularity: str = "monthly", start: date | None = None, end: date | None = None
) -> DataFrame:
    """Volumes per month or day; the bounds are inclusive, a month counts as a whole.

    The range is applied to the cases, before they are grouped, so that a scan can skip
    files and row groups outside it."""
    check.one_of(granularity, ("monthly", "daily"), "granularity")
    first = F.col("first_event_time")
    monthly = granularity == "monthly"
    if start:
        from_day = start.replace(day=1) if monthly else start
        cases = cases.where(first >= F.lit(from_day).cast("timestamp"))
    if end:
        last_day = F.last_day(F.lit(end)) if monthly else F.lit(end)
        cases = cases.where(first < F.date_add(last_day, 1).cast("timestamp"))
    if monthly:
        return (
            views.monthly_summary(cases)
            .select("year_month", "applications", "total_events", "avg_events_per_app")
            .withColumns(_metric("avg_events_per_app"))
        )
    return views.daily_throughput(cases)


def event_volume_over_time(cases: DataFrame, granularity: str = "monthly") -> DataFrame:
    check.one_of(granularity, ("monthly",), "granularity")
    return application_volume_over_time(cases).drop("applications")


def processing_time_distribution(cases: DataFrame) -> DataFrame:
    return views.processing_time_buckets(cases).withColumns(_metric("percentage", "avg_events"))


def median_bucket(distribution: DataFrame) -> DataFrame:
    """First bucket at which the running percentage reaches 50. The input has at most one
    row per bucket (five), so an unpartitioned window is fine."""
    w = Window.orderBy(E.bucket_rank(F.col("bucket"))).rowsBetween(Window.unboundedPreceding, 0)
    return (
        distribution.withColumn("_running", F.sum("percentage").over(w))
        .where(F.col("_running") >= 50.0)
        .agg(F.min_by("bucket", E.bucket_rank(F.col("bucket"))).alias("median_bucket"))
    )


def processing_duration_metrics(cases: DataFrame) -> DataFrame:
    """One row: mean hours and days, the bucket holding the median, the distribution."""
    micros = F.col("processing_micros")
    means = views.case_durations(cases).agg(
        E.exact_sum(micros).alias("_micros"), F.count(micros).alias("_n")
    )
    mean_micros = E.mean(F.col("_micros"), F.col("_n"))
    shares = processing_time_distribution(cases)
    listed = shares.agg(
        F.array_sort(F.collect_list(F.struct(
            E.bucket_rank(F.col("bucket")).alias("rank"), "bucket", "application_count", "percentage",
        ))).alias("_rows")
    )
    return (
        means.crossJoin(F.broadcast(median_bucket(shares))).crossJoin(F.broadcast(listed))
        .select(
            E.zero_if_null(mean_micros / E.MICROS_PER_HOUR).alias("avg_processing_hours"),
            E.zero_if_null(mean_micros / E.MICROS_PER_DAY).alias("avg_processing_days"),
            "median_bucket",
            F.transform("_rows", lambda r: F.struct(r.bucket, r.application_count, r.percentage))
            .alias("distribution"),
        )
    )


def activity_summary(events: DataFrame) -> DataFrame:
    return views.activity_summary(events).withColumns(
        _metric("percentage_of_total", "complete_pct", "suspend_pct", "withdraw_pct")
    )


def resource_workload(events: DataFrame, limit: int | None = None) -> DataFrame:
    limit = check.row_limit(limit)
    report = views.mv_resource_workload(events).withColumns(_metric("workload_percentage"))
    return report.limit(limit) if limit else report


def lifecycle_outcome_summary(events: DataFrame) -> DataFrame:
    return views.lifecycle_transition_metrics(events).withColumns(
        _metric("percentage", "workflow_pct", "offer_pct", "application_pct")
    )


def loan_goal_summary(cases: DataFrame) -> DataFrame:
    return views.loan_goal_metrics(cases).withColumns(
        _metric("avg_events", "avg_processing_hours", "avg_requested_amount")
    )


def application_processing_metrics(
    cases: DataFrame, events: DataFrame, limit: int | None = None
) -> DataFrame:
    """Cases from slowest to fastest. With a limit, the slowest are picked on the cases
    alone, and only their events are counted."""
    limit = check.row_limit(limit)
    slowest = [F.col("processing_hours").desc_nulls_last(), F.col("application_id").asc()]
    if limit:
        top = views.case_durations(cases).orderBy(*slowest).limit(limit)
        cases = top.select(*cases.columns)
        wanted = top.select("application_id")
        wanted = F.broadcast(wanted) if limit <= BROADCAST_ROWS else wanted
        events = events.join(wanted, "application_id", "left_semi")
    return (
        views.case_metrics(cases, events)
        .select(
            "application_id", "application_type", "loan_goal", "requested_amount", "event_count",
            "first_event_time", "last_event_time", "processing_hours", "processing_days",
            "complete_count", "suspend_count", "withdraw_count",
        )
        .withColumns(_metric("requested_amount", "processing_hours", "processing_days"))
        .orderBy(*slowest)
    )


def executive_summary(cases: DataFrame, events: DataFrame) -> DataFrame:
    """One row of totals. The cases are read once: one small group per type carries both
    the type counts and the parts of the overall means."""
    by_type = cases.groupBy("application_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("event_count").alias("e"),
        F.count("event_count").alias("en"),
        E.exact_sum(E.elapsed_micros(F.col("first_event_time"), F.col("last_event_time"))).alias("us"),
        F.count(E.elapsed_micros(F.col("first_event_time"), F.col("last_event_time"))).alias("usn"),
    )
    # Bounded: application types are a handful of product names.
    types = F.array_sort(F.collect_list(F.when(
        F.col("application_type").isNotNull(),
        F.struct((-F.col("n")).alias("k"), F.col("application_type").alias("type"), F.col("n").alias("count")),
    )))
    case_totals = by_type.agg(
        F.sum("n").alias("total_applications"),
        *[F.sum(c).alias(c) for c in ("e", "en", "us", "usn")],
        types.alias("types"),
    )
    # (activity, resource) groups are few next to the events, so both distinct counts run on them.
    pairs = events.groupBy("activity", "resource").agg(F.count(F.lit(1)).alias("n"))
    unnamed = F.coalesce(F.max(F.col("activity").isNull().cast("bigint")), F.lit(0))
    event_totals = pairs.agg(
        F.sum("n").alias("total_events"),
        (F.countDistinct("activity") + unnamed).alias("distinct_activities"),
        F.countDistinct("resource").alias("distinct_resources"),
    )
    return (
        case_totals.crossJoin(F.broadcast(event_totals))
        .select(
            F.coalesce("total_applications", F.lit(0)).alias("total_applications"),
            F.coalesce("total_events", F.lit(0)).alias("total_events"),
            E.zero_if_null(E.mean(F.col("e"), F.col("en"))).alias("avg_events_per_app"),
            E.zero_if_null(E.mean(F.col("us"), F.col("usn")) / E.MICROS_PER_DAY).alias("avg_processing_days"),
            "distinct_activities", "distinct_resources",
            F.transform("types", lambda t: F.struct(t["type"].alias("type"), t["count"].alias("count")))
            .alias("application_types"),
        )
    )


def synthetic_extension_metrics(extensions: DataFrame, branches: int = 5) -> DataFrame:
    """One row: records, mean quality, records per priority, the busiest branches. One
    scan, reduced to (priority, branch) groups."""
    small = extensions.groupBy("priority", "branch").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality_score").alias("q"), F.count("quality_score").alias("qn"),
    )
    totals = small.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.sum("q").alias("q"), F.sum("qn").alias("qn")
    )
    priorities = small.groupBy("priority").agg(F.sum("n").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("priority", "n")))).alias("priority_distribution")
    )
    top = (
        small.groupBy("branch").agg(F.sum("n").alias("count"))
        .orderBy(F.col("count").desc(), F.col("branch").asc_nulls_last()).limit(branches)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), "branch", "count"))).alias("b"))
    )
    return (
        totals.crossJoin(F.broadcast(priorities)).crossJoin(F.broadcast(top))
        .select(
            "total_records",
            E.zero_if_null(E.mean(F.col("q"), F.col("qn"))).alias("avg_quality_score"),
            "priority_distribution",
            F.transform("b", lambda r: F.struct(r["branch"].alias("branch"), r["count"].alias("count")))
            .alias("top_branches"),
        )
    )


def activity_kpis(events: DataFrame) -> DataFrame:
    """One row: share of the five busiest activities, workflow share, offer share."""
    counts = events.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))
    kind = E.activity_type(F.col("activity"))
    totals = counts.agg(
        F.sum("n").alias("all"),
        F.sum(F.when(kind == "Workflow", F.col("n")).otherwise(0)).alias("w"),
        F.sum(F.when(kind == "Offer", F.col("n")).otherwise(0)).alias("o"),
    )
    top = counts.orderBy(F.col("n").desc(), F.col("activity").asc_nulls_last()).limit(5).agg(F.sum("n").alias("t"))
    return totals.crossJoin(F.broadcast(top)).select(
        E.pct(F.col("t"), F.col("all")).alias("activity_concentration_pct"),
        E.pct(F.col("w"), F.col("all")).alias("workflow_activity_pct"),
        E.pct(F.col("o"), F.col("all")).alias("offer_activity_pct"),
    )


def resource_kpis(events: DataFrame) -> DataFrame:
    """One row: highest workload share, sample standard deviation of the workloads (in
    events), active resources, share of the five busiest among all events."""
    counts = events.groupBy("resource").agg(F.count(F.lit(1)).alias("n"))
    known = counts.where(F.col("resource").isNotNull())
    n = F.col("n").cast("decimal(20,0)")
    stats = known.agg(
        F.max("n").alias("max"), F.sum("n").alias("sum"), F.sum(n * n).alias("sq"),
        F.count(F.lit(1)).alias("active"),
    )
    everything = counts.agg(F.sum("n").alias("all"))
    top = known.orderBy(F.col("n").desc(), F.col("resource")).limit(5).agg(F.sum("n").alias("t"))
    k = F.col("active").cast("double")
    total = F.col("sum").cast("double")
    variance = (F.col("sq").cast("double") - total * total / k) / (k - 1)
    return stats.crossJoin(F.broadcast(everything)).crossJoin(F.broadcast(top)).select(
        E.pct(F.col("max"), F.col("sum")).alias("max_workload_pct"),
        F.round(F.when(F.col("active") > 1, F.sqrt(variance)), 4).alias("workload_stddev"),
        F.col("active").alias("active_resources"),
        E.pct(F.col("t"), F.col("all")).alias("top5_pct"),
    )


def outcome_kpis(cases: DataFrame, events: DataFrame) -> DataFrame:
    """One row: share of all cases that reached complete, suspend, withdraw."""
    step = F.col("lifecycle_transition")
    affected = (
        events.where(step.isin(*views.LIFECYCLE)).groupBy("lifecycle_transition")
        .agg(F.countDistinct("application_id").alias("n"))
        .agg(*[F.coalesce(F.sum(F.when(step == s, F.col("n"))), F.lit(0)).alias(s) for s in views.LIFECYCLE])
    )
    return total_applications(cases).crossJoin(F.broadcast(affected)).select(*[
        E.pct(F.col(s), F.col("total_applications")).alias(name)
        for s, name in zip(views.LIFECYCLE, ("completion_rate", "suspension_rate", "withdrawal_rate"))
    ])


def activity_type_rollup(events: DataFrame) -> DataFrame:
    """Activities, events and summed case counts per activity type."""
    grouped = (
        views.activity_summary(events).groupBy("activity_type")
        .agg(
            F.count("activity").alias("activities"),
            F.sum("event_count").alias("total_events"),
            F.sum("unique_applications").alias("total_apps"),
        )
    )
    return views.with_sum(grouped, "_all", "total_events").select(
        "activity_type", "activities", "total_events", "total_apps",
        E.pct(F.col("total_events"), F.col("_all")).alias("pct_events"),
    ).orderBy("activity_type")


def goal_duration_extremes(cases: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` goals with the longest and the ``n`` with the shortest mean duration."""
    goals = loan_goal_summary(cases).select("loan_goal", "avg_processing_hours", "application_count")
    hours = F.col("avg_processing_hours")
    longest = goals.orderBy(hours.desc(), F.col("loan_goal")).limit(n).withColumn("side", F.lit("longest"))
    shortest = goals.orderBy(hours.asc(), F.col("loan_goal")).limit(n).withColumn("side", F.lit("shortest"))
    return longest.unionByName(shortest)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every given table or view, in one job."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("name"), "row_count")
        for name, df in tables.items()
    ]
    result = counted[0]
    for df in counted[1:]:
        result = result.unionByName(df)
    return result


def representative_queries(cases: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """The overview bundle. The type query groups a view that already has one row per
    type, so its count is 1 by definition."""
    by_events = [F.col("event_count").desc()]
    return {
        "total_applications": total_applications(cases),
        "top_activities": views.activity_summary(events)
        .orderBy(*by_events, F.col("activity").asc_nulls_last()).limit(5)
        .select("activity", F.col("event_count").alias("count"), F.col("percentage_of_total").alias("percentage")),
        "total_events": total_events(events),
        "by_application_type": views.application_type_metrics(cases)
        .groupBy(F.col("application_type").alias("type"), F.col("avg_events_per_application").alias("avg_events"))
        .agg(F.count(F.lit(1)).alias("count")).select("type", "count", "avg_events"),
        "processing_time_buckets": views.processing_time_buckets(cases)
        .select("bucket", F.col("application_count").alias("count"), "percentage")
        .orderBy(F.col("count").desc(), "bucket"),
        "top_resources": views.mv_resource_workload(events)
        .orderBy(*by_events, "resource").limit(5)
        .select("resource", F.col("event_count").alias("events"), F.col("applications_handled").alias("applications")),
        "lifecycle_transitions": views.lifecycle_transition_metrics(events).select(
            F.col("lifecycle_transition").alias("transition"), F.col("event_count").alias("count"),
            F.col("applications_affected").alias("apps"),
        ),
        "monthly_summary": views.monthly_summary(cases).select(
            F.col("year_month").alias("month"), F.col("applications").alias("apps"),
            F.col("total_events").alias("events"), F.col("avg_events_per_app").alias("avg_events"),
        ),
    }


def chart_feeds(
    cases: DataFrame, events: DataFrame, top_activities: int = 10, top_resources: int = 20
) -> dict[str, DataFrame]:
    """The frames behind the nine standard charts; drawing is left to the consumer."""
    outcomes = lifecycle_outcome_summary(events)
    shares = views.with_sum(
        outcomes.select("lifecycle_transition", "event_count"), "_all", "event_count"
    ).select(
        "lifecycle_transition", "event_count", E.pct(F.col("event_count"), F.col("_all"), 1).alias("share"),
    )
    return {
        "executive_summary": executive_summary(cases, events),
        "application_volume_by_type": application_volume_by_type(cases),
        "application_volume_monthly": application_volume_over_time(cases, "monthly"),
        "application_volume_daily": application_volume_over_time(cases, "daily"),
        "activity_summary": activity_summary(events).limit(top_activities),
        "resource_workload": resource_workload(events, top_resources),
        "lifecycle_outcomes": shares,
        "loan_goal_summary": loan_goal_summary(cases),
        "processing_time_distribution": processing_time_distribution(cases),
    }
