import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from caselog import session
from caselog.operators import quantiles

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
       float("inf"), float("-inf"), 1.0, math.nextafter(1, 0), math.nextafter(2, 0), 2.0, 4.0, math.nextafter(4, 0), 1e9, 1e-9, 0.1, -0.1,
       8.98846567431158e307, 1 / 3]


def test_keys_are_the_bits_of_doubles(spark):
    rng = random.Random(3)
    values = ODD + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)] + [2.0 ** k for k in range(-1074, 1024, 7)]
    values = [v for v in values if v == v]
    keyed = lambda xs: spark.createDataFrame([(v,) for v in xs], "x double").select("x", quantiles.order_key(F.col("x")).alias("k"))
    rows = keyed(values).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.k == (-bits if r.x < 0 else bits) and quantiles.of_key(r.k) == r.x
    assert [r.x for r in sorted(rows, key=lambda r: r.k)] == sorted(values)
    assert keyed([float("nan")]).first().k > max(r.k for r in rows)


@pytest.mark.parametrize("counters", [256, 1 << 16])
def test_several_ranks_and_weights(spark, counters):
    df = spark.range(3000).select(((F.hash("id") % 997) / 7.0).alias("x"), (F.col("id") % 4).alias("n"))
    whole = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int")))).where("i < n")
    qs = [0.0, 0.1, 0.5, 0.731, 1.0]
    want = whole.agg(F.percentile("x", F.array(*map(F.lit, qs)))).first()[0]
    assert quantiles.exact_quantiles(df, "x", qs, weight="n", counters=counters) == pytest.approx(want, abs=1e-12)
    assert quantiles.exact_quantiles(df.where("x > 1e9"), "x", qs) == [None] * 5


def test_no_more_than_four_passes(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id") / 1e12).otherwise(1e9 + F.col("id") / 1e6).alias("x"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    quantiles.exact_quantile(df, "x")
    # adaptive execution runs a job for each shuffle and one for its result
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 8


def test_scratch_is_deleted_at_the_end_of_the_block(spark):
    import os

    with session.scratch(spark):
        df = session.staged(spark.range(5).toDF("x"), "five")
        assert df.count() == 5
        path = df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
