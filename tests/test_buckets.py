"""Tables in buckets: what an upsert or a load touches, and what it leaves alone."""

import os

import pytest
from pyspark.sql import functions as F

from caselog.sinks import snapshots
from caselog.sources import tables

SCHEMA = "k string, v int, created_at timestamp"


def files(path):
    """Bucket folder to its files' names and times."""
    found = {}
    for name in sorted(os.listdir(path)):
        if name.startswith("bucket="):
            found[name] = {f: os.stat(path / name / f).st_mtime_ns for f in os.listdir(path / name) if f.endswith(".parquet")}
    return found


def rows(spark, ids, v):
    return spark.createDataFrame([(f"id{i}", v) for i in ids], "k string, v int").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = tmp_path / "t"
    schema = rows(spark, [], 0).schema
    snapshots.upsert(rows(spark, range(500), 1), str(path), ["k"], schema)
    before = files(path)
    assert len(before) == snapshots.LEAST_BUCKETS and all(len(f) == 1 for f in before.values())
    snapshots.upsert(rows(spark, [3, 900], 2), str(path), ["k"], schema)
    after = files(path)
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2
    got = {r.k: r.v for r in snapshots.read(spark, str(path), schema).collect()}
    assert got == {f"id{i}": 2 if i in (3, 900) else 1 for i in [*range(500), 900]}


def test_a_failing_upsert_leaves_the_old_state(spark, tmp_path):
    path = tmp_path / "t"
    schema = rows(spark, [], 0).schema
    snapshots.upsert(rows(spark, range(50), 1), str(path), ["k"], schema)
    before = files(path)
    bad = rows(spark, range(50), 2).withColumn("v", F.when(F.col("k") == "id7", F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        snapshots.upsert(bad, str(path), ["k"], schema)
    assert files(path) == before and snapshots.read(spark, str(path), schema).agg(F.sum("v")).first()[0] == 50
    snapshots.upsert(rows(spark, [], 0), str(path), ["k"], schema)
    assert files(path) == before


def test_touched_buckets_alone_are_scanned(spark, tmp_path):
    path = tmp_path / "t"
    schema = rows(spark, [], 0).schema
    snapshots.upsert(rows(spark, range(500), 1), str(path), ["k"], schema)
    few, touched = snapshots.in_buckets(rows(spark, [3], 1), str(path), ["k"])
    part = snapshots.read_buckets(spark, str(path), schema, touched)
    assert len(touched) == 1 and part.count() < 100
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert [r[0] for r in few.select(snapshots.BUCKET).collect()] == touched


def test_a_bucketed_model_table_is_read_with_its_schema(spark, tmp_path):
    from caselog import schemas

    one = spark.createDataFrame([("a", 1)], "application_id string, page_count int")
    snapshots.upsert(one, str(tmp_path / "extensions"), ["application_id"], schemas.EXTENSIONS)
    assert tables.read_table(spark, str(tmp_path), "extensions").schema == schemas.EXTENSIONS
