from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from caselog import schemas, session
from caselog.operators import extensions as ext
from caselog.plans import jobs, views
from caselog.sinks import export, snapshots
from caselog.sources import retail, tables

from helpers import cases

ROWS = [{"name": "a", "value": 1, "pct": 0.5}, {"name": "b", "value": 2, "pct": 1.5}, {"name": "ü,\"x\"\ny", "value": 3, "pct": 2.0}]


@pytest.fixture
def log(spark, sf):
    return {"cases": retail.order_cases(spark, sf), "events": retail.order_events(spark, sf)}


def test_round_trip(spark, tmp_path):
    done = export.export(spark, ROWS, str(tmp_path), "rows", source="test")
    assert [(d["format"], d["rows"], d["source_function"]) for d in done] == [("parquet", 3, "test"), ("csv", 3, "test")]
    assert all(d["size_bytes"] > 0 for d in done)
    stored = spark.read.parquet(str(tmp_path / "rows.parquet"))
    assert sorted(r.name for r in stored.collect()) == sorted(r["name"] for r in ROWS)
    text = export.read_csv(spark, str(tmp_path / "rows.csv"))
    assert sorted(r.name for r in text.collect()) == sorted(r["name"] for r in ROWS)
    assert set(text.columns) == {"name", "value", "pct"}


def test_one_dict_is_one_row_and_csv_alone_works(spark, tmp_path):
    assert export.export(spark, ROWS[0], str(tmp_path), "one", ("csv",))[0]["rows"] == 1


@pytest.mark.parametrize("data", [None, [], "text", 5, [1, 2]])
def test_unusable_data(spark, tmp_path, data):
    with pytest.raises(ValueError):
        export.export(spark, data, str(tmp_path), "x")


def test_empty_frame_leaves_nothing_behind(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        export.export(spark, spark.range(0), str(tmp_path), "x")
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError):
        export.export(spark, ROWS, str(tmp_path), "x", ("xlsx",))


def test_nested_columns_become_json(spark, tmp_path, log):
    export.export_dataset(spark, log, str(tmp_path), "executive_summary")
    row = export.read_csv(spark, str(tmp_path / "executive_summary.csv")).first()
    assert row.application_types.startswith('[{"type":')
    assert export.export_dataset(spark, log, str(tmp_path), "resource_workload", ("csv",), limit=3)[0]["rows"] == 3


def test_export_all_goes_on_after_a_failure(spark, tmp_path, log):
    done = export.export_all(spark, {**log, "events": log["events"].where("false")}, str(tmp_path), ("parquet",))
    failed = {n for n, d in done["datasets"].items() if d[0]["error"]}
    assert failed == {"activity_summary", "resource_workload", "lifecycle_outcomes"}
    assert len(done["datasets"]) == 9 and done["total_files"] == 6
    manifest = spark.read.parquet(done["manifest"])
    assert manifest.count() == 9 and manifest.agg(F.sum("rows")).first()[0] == done["total_rows"]
    listed = {(r.dataset, r.format) for r in export.list_exports(spark, str(tmp_path)).collect()}
    assert ("executive_summary", "parquet") in listed and len(listed) == 6


def test_upsert_replaces_and_keeps(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, v int, created_at timestamp"
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    day = lambda n: datetime(2024, 1, n)
    struct = frame(("x", 1, day(1))).schema
    snapshots.upsert(frame(("a", 1, day(1)), ("b", 2, day(1))), path, ["k"], struct)
    snapshots.upsert(frame(("b", None, day(2)), ("c", 3, day(2))), path, ["k"], struct)
    rows = {r.k: (r.v, r.created_at) for r in snapshots.read(spark, path, struct).collect()}
    assert rows == {"a": (1, day(1)), "b": (None, day(1)), "c": (3, day(2))}


def test_unfinished_snapshot_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.write(spark.range(3), path)
    (tmp_path / "t" / "snapshot=00000002").mkdir()
    assert spark.read.parquet(snapshots.current(spark, path)).count() == 3
    for n in (4, 5, 6):
        snapshots.write(spark.range(n), path)
    assert spark.read.parquet(snapshots.current(spark, path)).count() == 6
    kept = [p.name for p in sorted((tmp_path / "t").iterdir()) if (p / "_SUCCESS").exists()]
    assert kept == ["snapshot=00000004", "snapshot=00000005"]


def test_populate_extensions(spark, tmp_path, log):
    path, audit = str(tmp_path / "ext"), str(tmp_path / "loads")
    n = log["cases"].count()
    assert jobs.populate_extensions(log["cases"], path, audit, dry_run=True) == (n, False)
    assert snapshots.current(spark, path) is None
    for _ in range(2):
        assert jobs.populate_extensions(log["cases"], path, audit) == (n, True)
    stored = snapshots.read(spark, path, schemas.EXTENSIONS)
    assert stored.count() == n == stored.select("application_id").distinct().count()
    assert stored.where("created_at >= updated_at").count() == 0
    loads = spark.read.parquet(audit).collect()
    assert len(loads) == 2 and {r.load_status for r in loads} == {"SUCCESS"} and {r.records_loaded for r in loads} == {n}
    with pytest.raises(ValueError, match="no cases"):
        jobs.populate_extensions(log["cases"].where("false"), path, audit)


def test_failed_population_leaves_the_table_as_it_was(spark, tmp_path):
    path, audit = str(tmp_path / "ext"), str(tmp_path / "loads")
    jobs.populate_extensions(cases(spark, ("a", None, None, 0)), path, audit)
    with pytest.raises(Exception, match="non-empty"):
        jobs.populate_extensions(cases(spark, ("b", None, None, 0), (" ", None, None, 0)), path, audit)
    assert [r.application_id for r in snapshots.read(spark, path, schemas.EXTENSIONS).collect()] == ["a"]


def test_refresh(spark, tmp_path, log):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        jobs.read_materialized_view(spark, root, "mv_monthly_summary")
    names = jobs.refresh_materialized_views(log, root)
    assert names == ["mv_activity_summary", "mv_resource_workload", "mv_monthly_summary", "mv_application_type_summary"]
    for name in names:
        assert jobs.read_materialized_view(spark, root, name).count() == views.build(name, log).count()


def test_tables_are_read_with_their_schema(spark, tmp_path, log):
    log["cases"].drop("status").write.parquet(str(tmp_path / "cases"))
    got = tables.read_table(spark, str(tmp_path), "cases")
    assert got.schema == schemas.CASES and got.where("status is not null").count() == 0
    assert tables.empty_table(spark, "offers").schema == schemas.OFFERS


def test_tables_kept_as_snapshots_are_read_once(spark, tmp_path, log):
    n = log["cases"].count()
    for seed in (1, 2):
        jobs.populate_extensions(log["cases"], str(tmp_path / "extensions"), str(tmp_path / "loads"), seed)
    assert tables.read_table(spark, str(tmp_path), "extensions").count() == n
    row = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "application_id string, risk_class int")
    for version in ("v1", "v2", "v1"):
        snapshots.upsert_part(
            row.withColumn("model_version", F.lit(version)), str(tmp_path / "predictions"), "model_version", version,
            ["application_id"], schemas.PREDICTIONS)
    got = tables.read_table(spark, str(tmp_path), "predictions").collect()
    assert sorted((r.application_id, r.model_version, r.risk_class) for r in got) == [
        ("a", "v1", 1), ("a", "v2", 1), ("b", "v1", 0), ("b", "v2", 0)]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == named
    assert session.scratch_path(spark, "x").startswith(named)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_bucketed_tables_need_no_shuffle_per_case(spark, tmp_path, log):
    names = {}
    for name, df in log.items():
        jobs.store_bucketed(df, f"bucketed_{name}", str(tmp_path / name), 4)
        names[name] = spark.table(f"bucketed_{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (views.event_sequence(names["events"], hot_rows=None), views.case_metrics(names["cases"], names["events"])):
            assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        want = sorted(map(str, views.case_metrics(log["cases"], log["events"]).collect()))
        assert sorted(map(str, views.case_metrics(names["cases"], names["events"]).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in log:
            spark.sql(f"DROP TABLE bucketed_{name}")
