from datetime import date

import pytest
from pyspark.sql import functions as F

from caselog.functions import expressions as E
from caselog.plans import kpis, views
from caselog.sources import retail

from helpers import at, cases, dicts, events


def each(spark, table, fn, kind="string"):
    """Results of a column function for the inputs of a (input, wanted) table."""
    df = spark.createDataFrame([(i, value) for i, (value, _) in enumerate(table)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def wanted(table):
    return [want for _, want in table]


def test_activity_type_reads_underscore_as_any_character(spark):
    table = [("W_x", "Workflow"), ("Wait", "Workflow"), ("W", "Other"), ("O_x", "Offer"), ("A_x", "Application"),
             ("a_x", "Other"), ("", "Other"), (None, "Other"), ("W\n", "Workflow")]
    like = F.expr("CASE WHEN x LIKE 'W_%' THEN 'Workflow' WHEN x LIKE 'O_%' THEN 'Offer' "
                  "WHEN x LIKE 'A_%' THEN 'Application' ELSE 'Other' END")
    assert each(spark, table, E.activity_type) == wanted(table) == each(spark, table, lambda _: like)


def test_offer_status(spark):
    table = [("O_Created", "Created"), ("O_Create Offer", "Created"), ("O_Sent (online only)", "Sent"),
             ("O_Sent (mail and online)", "Sent"), ("O_Accepted", "Accepted"), ("O_Returned", "Returned"),
             ("O_Refused", "Refused"), ("O_Cancelled", "Cancelled"), ("O_Else", "Other")]
    assert each(spark, table, E.offer_status) == wanted(table)


def test_duration_bucket(spark):
    table = [(0, "< 1 hour"), (0.999, "< 1 hour"), (1, "1-24 hours"), (24, "1-7 days"), (167.9, "1-7 days"),
             (168, "1-4 weeks"), (719.9, "1-4 weeks"), (720, "> 4 weeks"), (None, "> 4 weeks")]
    micros = [(None if hours is None else int(hours * 3.6e9), want) for hours, want in table]
    assert each(spark, micros, E.duration_bucket, "bigint") == wanted(table)


def test_probability_band(spark):
    table = [("0", 0), ("0.1999", 0), ("0.2", 1), ("0.4", 2), ("0.6", 3), ("0.8", 4), ("1.0", 4), ("1.01", None), ("-0.1", None)]
    got = each(spark, table, lambda x: E.probability_band(x.cast("decimal(6,4)")))
    assert got == [None if i is None else E.PROBABILITY_BANDS[i][2] for _, i in table]


def test_week_across_new_year_gives_two_rows(spark):
    log = cases(spark, ("a", "2015-12-31", "2016-01-02", 1), ("b", "2016-01-01", "2016-01-02", 2), ("c", None, None, 0))
    rows = dicts(views.weekly_summary(log))
    assert rows == [
        {"year": 2015, "week": 53, "week_start": at("2015-12-28"), "applications": 1, "events": 1},
        {"year": 2016, "week": 53, "week_start": at("2015-12-28"), "applications": 1, "events": 2},
        {"year": None, "week": None, "week_start": None, "applications": 1, "events": 0},
    ]


def test_case_without_events_counts_zero_and_sorts_last(spark):
    log = cases(spark, ("a", "2016-01-01", "2016-01-02T12:00", 2), ("b", None, None, 0))
    ev = events(spark, ("1", "a", "W_x", "2016-01-01", None, "complete"), ("2", "a", "O_y", "2016-01-02", None, "suspend"))
    m = {r.application_id: r for r in views.case_metrics(log, ev).collect()}
    assert len(views.case_metrics(log, ev).columns) == 19
    assert (m["a"].processing_hours, m["a"].processing_days, m["a"].complete_count) == (36.0, 1.5, 1)
    assert (m["a"].workflow_activity_count, m["a"].offer_activity_count) == (1, 1)
    assert (m["b"].complete_count, m["b"].processing_hours, m["b"].first_date) == (0, None, None)
    assert [r.date for r in views.daily_throughput(log).collect()] == [date(2016, 1, 1), None]
    assert [r.bucket for r in views.processing_time_buckets(log).collect()] == ["1-7 days", "> 4 weeks"]


def test_event_sequence(spark):
    ev = events(
        spark, ("2", "a", "B", "2016-01-01"), ("1", "a", "A", "2016-01-01"), ("3", "a", "C", "2016-01-02"),
        ("4", "b", "A", "2016-01-01"),
    )
    got = {r.event_id: r for r in views.event_sequence(ev).collect()}
    assert [got[i].event_sequence for i in "1234"] == [1, 2, 3, 1]
    assert (got["1"].next_activity, got["1"].prev_activity, got["1"].seconds_to_next) == ("B", None, 0.0)
    assert (got["2"].seconds_to_next, got["2"].time_to_next.days) == (86400.0, 1)
    assert (got["3"].next_activity, got["3"].time_to_next) == (None, None)


def test_shares_use_their_own_denominators(spark):
    ev = events(
        spark, ("1", "a", "W_x", "2016-01-01", "r1", "complete"), ("2", "a", "W_x", "2016-01-01", "r1", None),
        ("3", "b", "O_x", "2016-01-01", "r2", None), ("4", "b", "A_x", "2016-01-01", None, None),
    )
    assert views.lifecycle_transition_metrics(ev).first().percentage == 25.0
    assert [r.workload_percentage for r in views.resource_workload(ev).collect()] == [66.67, 33.33]
    assert sum(r.percentage_of_total for r in views.activity_summary(ev).collect()) == 100.0


def test_percentages_sum_to_hundred(spark, sf):
    ev, log = retail.order_events(spark, sf), retail.order_cases(spark, sf)
    for df, c in [
        (views.activity_summary(ev), "percentage_of_total"), (views.resource_workload(ev), "workload_percentage"),
        (views.event_origin_metrics(ev), "percentage"), (views.processing_time_buckets(log), "percentage"),
    ]:
        assert 99.8 <= df.agg(F.sum(c)).first()[0] <= 100.2


def test_results_do_not_depend_on_partitioning(spark, sf):
    def all_rows():
        ev, log = retail.order_events(spark, sf).repartition(5), retail.order_cases(spark, sf).repartition(3)
        frames = [kpis.executive_summary(log, ev), kpis.processing_duration_metrics(log), views.monthly_summary(log),
                  kpis.resource_kpis(ev), views.loan_goal_metrics(log)]
        return [sorted(map(str, f.collect())) for f in frames]

    want = all_rows()
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert all_rows() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_duration_report_and_median_bucket(spark):
    log = cases(spark, ("a", "2016-01-01", "2016-01-01T00:30", 1), ("b", "2016-01-01", "2016-01-01T02:00", 3),
                ("c", "2016-01-01", "2016-03-01", 5))
    r = kpis.processing_duration_metrics(log).first()
    assert r.median_bucket == "1-24 hours"
    assert [x.bucket for x in r.distribution] == ["< 1 hour", "1-24 hours", "> 4 weeks"]
    assert r.avg_processing_days == pytest.approx((0.5 / 24 + 2 / 24 + 60) / 3)
    nothing = kpis.processing_duration_metrics(log.where("false")).first()
    assert (nothing.avg_processing_hours, nothing.median_bucket, nothing.distribution) == (0.0, None, [])


def test_volume_over_time_bounds(spark):
    log = cases(spark, ("a", "2016-01-05", "2016-01-06", 1), ("b", "2016-02-10", "2016-02-11", 2), ("c", None, None, 0))
    months = lambda *a: [r.year_month for r in kpis.application_volume_over_time(log, "monthly", *a).collect()]
    days = lambda *a: [r.date for r in kpis.application_volume_over_time(log, "daily", *a).collect()]
    assert months() == ["2016-01", "2016-02", None]
    assert months(date(2016, 1, 20)) == ["2016-01", "2016-02"]
    assert months(None, date(2016, 2, 1)) == ["2016-01", "2016-02"]
    assert months(date(2016, 2, 28), date(2016, 2, 29)) == ["2016-02"]
    assert days(date(2016, 1, 6)) == [date(2016, 2, 10)]
    assert days(date(2016, 1, 5), date(2016, 1, 5)) == [date(2016, 1, 5)]


@pytest.mark.parametrize("call", [
    lambda c, e: kpis.application_volume_over_time(c, "weekly"),
    lambda c, e: kpis.event_volume_over_time(c, "daily"),
    lambda c, e: kpis.resource_workload(e, -1),
    lambda c, e: kpis.resource_workload(e, True),
    lambda c, e: kpis.application_processing_metrics(c, e, 2.5),
])
def test_bad_parameters(spark, call):
    with pytest.raises(ValueError):
        call(cases(spark, ("a", None, None, 0)), events(spark, ("1", "a", "A", "2016-01-01")))


def test_limits_zero_and_none_mean_all(spark):
    ev = events(spark, *[(str(i), "a", "A", "2016-01-01", f"r{i}") for i in range(4)])
    assert [kpis.resource_workload(ev, n).count() for n in (None, 0, 2)] == [4, 4, 2]


def test_limited_case_report_counts_events_of_the_slowest_only(spark, sf):
    ev, log = retail.order_events(spark, sf), retail.order_cases(spark, sf)
    every = kpis.application_processing_metrics(log, ev).collect()
    assert kpis.application_processing_metrics(log, ev, 25).collect() == every[:25]


def test_missing_and_zero_metrics_read_as_zero(spark):
    log = cases(spark, ("a", None, None, 0, "New credit", "Car"))
    r = kpis.application_volume_by_type(log).first()
    assert (r.avg_events_per_application, r.avg_processing_hours, r.avg_requested_amount) == (0.0, 0.0, 0.0)
    assert kpis.loan_goal_summary(log).first().avg_processing_hours == 0.0


def test_executive_summary(spark, sf):
    ev, log = retail.order_events(spark, sf), retail.order_cases(spark, sf)
    r = kpis.executive_summary(log, ev).first()
    assert (r.total_applications, r.total_events) == (log.count(), ev.count())
    assert sum(t["count"] for t in r.application_types) == r.total_applications
    counts = [t["count"] for t in r.application_types]
    assert counts == sorted(counts, reverse=True)
    empty = kpis.executive_summary(log.where("false"), ev.where("false")).first()
    assert (empty.total_applications, empty.total_events, empty.avg_processing_days, empty.application_types) == (0, 0, 0.0, [])


def test_bundle_and_feeds(spark, sf):
    ev, log = retail.order_events(spark, sf), retail.order_cases(spark, sf)
    bundle = kpis.representative_queries(log, ev)
    assert len(bundle) == 8
    assert {r["count"] for r in bundle["by_application_type"].collect()} == {1}
    feeds = kpis.chart_feeds(log, ev)
    assert len(feeds) == 9 and feeds["activity_summary"].count() == 10
    counts = {r.name: r.row_count for r in kpis.row_counts({n: views.build(n, {"cases": log, "events": ev}) for n in views.VIEWS}).collect()}
    assert counts["event_sequence"] == ev.count() and counts["application_metrics"] == log.count()
