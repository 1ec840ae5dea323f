"""An upsert sorts whole rows only of keys that repeat, and populating reads the cases once."""

import pytest
from pyspark.sql import types as T

from caselog.plans import jobs
from caselog.sinks import snapshots

KEYED = "k string, p int, a int, b string"


@pytest.fixture
def batch(spark):
    rows = [("x", 1, 5, "l"), ("x", 1, 5, "m"), ("x", 2, 0, None), (None, 1, 1, "n"), (None, 1, None, "z"), ("y", None, 1, "q")]
    return spark.createDataFrame(rows, KEYED)


def test_greatest_row_of_each_key(spark, batch):
    got = snapshots.greatest(batch, ["k", "p"])
    assert got.columns == batch.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("x", 1, 5, "m"), ("x", 2, 0, None), (None, 1, 1, "n"), ("y", None, 1, "q")], key=str)


def test_rows_without_repeats_stay_where_they_are(spark, batch):
    once = batch.where("k = 'y'")
    assert snapshots.greatest(once, ["k", "p"]) is once


def test_first_and_later_upserts(spark, tmp_path):
    schema = T._parse_datatype_string("k string, v int, created_at int")
    rows = lambda *r: spark.createDataFrame(r, schema)
    path, stored = str(tmp_path / "t"), lambda: sorted(map(tuple, snapshots.read(spark, path, schema).collect()))
    snapshots.upsert(rows(("a", 1, 1), ("a", 3, 1), ("b", 2, 1)), path, ["k"], schema)
    assert stored() == [("a", 3, 1), ("b", 2, 1)]
    snapshots.upsert(rows(("a", 0, 2), ("c", 9, 2), ("c", 8, 2)), path, ["k"], schema)
    assert stored() == [("a", 0, 1), ("b", 2, 1), ("c", 9, 2)]


def test_cases_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    row = lambda i: (seen.add(1), (str(i),))[1]
    cases = spark.createDataFrame(spark.sparkContext.range(300, numSlices=2).map(row), "application_id string")
    assert jobs.populate_extensions(cases, str(tmp_path / "x"), str(tmp_path / "loads")).cases == 300
    assert seen.value == 300
    assert spark.read.parquet(str(tmp_path / "loads")).first().records_loaded == 300
    with pytest.raises(ValueError, match="no cases"):
        jobs.populate_extensions(cases.where("false"), str(tmp_path / "y"), str(tmp_path / "loads"))
