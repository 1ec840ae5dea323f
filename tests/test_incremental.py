"""Views from the partials of loads, sketches, counts from footers, Bloom filters."""

import os

import pytest
from pyspark.sql import functions as F

from caselog.plans import jobs, views
from caselog.sources import retail, tables

import test_xes_and_quality as source


@pytest.fixture
def events(spark, sf):
    return retail.order_events(spark, sf)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_views_of_partials_equal_the_views(events):
    partials = views.event_partials(events.where("hash(event_id) % 3 = 0")).unionByName(
        views.event_partials(events.where("hash(event_id) % 3 <> 0")))
    assert rows_of(views.mv_activity_of_partials(partials)) == rows_of(views.mv_activity_summary(events))
    assert rows_of(views.mv_resource_of_partials(partials)) == rows_of(views.mv_resource_workload(events))


def test_a_second_load_leaves_the_first_partials_alone(spark, tmp_path):
    from caselog.sources import xes

    def load(name, *traces):
        folder = tmp_path / name
        folder.mkdir()
        jobs.load_log(xes.read_traces(spark, source.write(folder / "log.xes.gz", *traces)), root)

    root, kind = str(tmp_path / "tables"), source.attr("ApplicationType", "New credit")
    load("one", source.trace("A", source.event("e1"), source.event("e2", "W_y"), more=kind))
    first = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "tables" / "partials").rglob("*.parquet"))}
    load("two", source.trace("A", source.event("e1"), source.event("e3")), source.trace("B", source.event("e4", "W_y"), more=kind))
    later = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "tables" / "partials").rglob("*.parquet"))}
    assert first.items() < later.items()
    names = jobs.refresh_loaded_views(spark, root, str(tmp_path / "views"))
    stored = {name: tables.read_table(spark, root, name) for name in ("cases", "events")}
    assert set(names) == set(views.MATERIALIZED)
    for name in names:
        assert rows_of(jobs.read_materialized_view(spark, str(tmp_path / "views"), name)) == rows_of(views.build(name, stored))


@pytest.mark.parametrize("view", ["activity_summary", "resource_workload", "lifecycle_transition_metrics", "event_origin_metrics"])
def test_sketches_stay_near_the_exact_counts(spark, events, view):
    """Groups of thousands of cases, within four standard errors of 0.8 %; all else is equal."""
    build = views.VIEWS[view][0]
    exact, near = build(events), build(events, approximate=True)
    assert exact.columns == near.columns
    key = exact.columns[0]
    counts = {"unique_applications", "applications_handled", "applications_affected", "unique_activities"}
    want = {r[key]: r.asDict() for r in exact.collect()}
    got = {r[key]: r.asDict() for r in near.collect()}
    assert want.keys() == got.keys()
    for k, row in want.items():
        for name, value in row.items():
            if name in counts:
                assert abs(got[k][name] - value) <= max(1, 0.032 * value)
            else:
                assert got[k][name] == value


def test_counts_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).withColumn("x", F.col("id") % 7).repartition(3).write.parquet(path)
    df = tables.counted(spark, path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "id" not in plan.split("ReadSchema")[-1]
    assert tables.stored_rows(spark, path) == 5000
    assert "aggregatePushdown" not in str(spark.conf.getAll)


def scanned(df):
    """Rows that the scan of an executed plan put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_row_groups_without_an_id_are_skipped(spark, tmp_path):
    cases = spark.range(0, 20_000, 2).select(F.format_string("c%06d", "id").alias("application_id"), F.rand(1).alias("v"))
    jobs.store_bucketed(cases, "bloomed_cases", str(tmp_path / "t"), 2)
    plain = str(tmp_path / "plain")
    cases.repartition(2, "application_id").sortWithinPartitions("application_id").write.parquet(plain)
    try:
        stored = spark.read.parquet(str(tmp_path / "t"))
        unknown = [f"c{i:06d}" for i in (5001, 7777, 9999, 12_345, 15_001)]
        assert sum(scanned(stored.where(F.col("application_id") == i)) for i in unknown) == 0
        assert sum(scanned(spark.read.parquet(plain).where(F.col("application_id") == i)) for i in unknown) > 0
        assert stored.where(F.col("application_id") == "c005000").count() == 1
    finally:
        spark.sql("DROP TABLE bloomed_cases")
