"""Splits by a threshold of the hash, and repeat rules with a key that fills the log."""

import random

from pyspark.sql import functions as F

from caselog.operators import features, ordered, quality, quantiles


def ranked_split(df, label, share=0.2, seed=42):
    """The test ids by ranking every row."""
    rows = ordered.neighbours(df.withColumn("_h", features._seeded_hash("application_id", seed)), [label], ["_h", "application_id"],
                              position="_nth", hot_rows=None)
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    return sorted(r.application_id for r in rows.collect() if r._nth <= int(sizes[r[label]] * share + 0.5))


def test_split_equals_ranking(spark):
    df = spark.range(4000).select(
        F.col("id").cast("string").alias("application_id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3).alias("y"))
    df = df.unionByName(spark.createDataFrame([("lone", 99)], "application_id string, y long"))
    for share in (0.2, 0.5, 0.0, 1.0):
        train, test = features.stratified_split(df, "y", test_share=share)
        assert sorted(r.application_id for r in test.collect()) == ranked_split(df, "y", share)
        assert train.count() + test.count() == df.count()
        assert train.select("application_id").intersect(test.select("application_id")).isEmpty()


def test_split_of_repeated_ids(spark):
    df = spark.createDataFrame([("same", i % 2, i) for i in range(40)], "application_id string, y int, n int")
    train, test = features.stratified_split(df, "y", test_share=0.25)
    assert {r.y: r["count"] for r in test.groupBy("y").count().collect()} == {0: 5, 1: 5}
    assert sorted(r.n for r in train.union(test).collect()) == list(range(40))


def test_split_rows_are_not_shuffled(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("application_id"), (F.col("id") % 2).alias("y"))
    for part in features.stratified_split(df, "y"):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "hashpartitioning" not in plan


def test_selection_per_group(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4), rng.randrange(1 << 60) >> rng.choice((0, 30, 55))) for _ in range(800)]
    ranks = [(0, 1), (1, 100), (2, 57), (7, 3)]
    got = quantiles.select_per_group(spark.createDataFrame(rows, "g long, key long"), "g", spark.createDataFrame(ranks, "g long, rank long"))
    want = {}
    for g, k in ranks:
        keys = sorted(key for h, key in rows if h == g)
        if len(keys) >= k:
            want[g] = (keys[k - 1], sum(x < keys[k - 1] for x in keys), keys.count(keys[k - 1]))
    assert {r.g: (r.key, r.below, r.ties) for r in got.collect()} == want


EVENTS = "source_file string, trace_pos long, event_pos int, event_id string"
EVENT = ("source_file", "trace_pos", "event_pos")


def repeated_rows(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r[:3]):
        first.setdefault(r[3], r[:3])
    return sorted(r for r in rows if r[3] != "" and r[:3] > first[r[3]])


def test_heavy_keys_meet_their_first_position_by_salt(spark):
    rng = random.Random(2)
    rows = [(f"f{i % 3}", i // 10, i % 10, "hot" if rng.random() < 0.7 else rng.choice(("", "warm", f"e{rng.randrange(900)}"))) for i in range(6000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, EVENTS).repartition(8)
    for heavy in (10**6, 300, 1):
        got = quality._repeats(df, "event_id", EVENT, heavy)
        assert sorted(tuple(r[c] for c in (*EVENT, "event_id")) for r in got.collect()) == repeated_rows(rows)


def test_a_hot_key_spreads_over_the_tasks(spark):
    """A key on 70 % of the rows: no task of the join that shuffles it meets more than 1.5 times the mean."""
    n, parts = 40_000, 8
    df = spark.range(n).select(
        F.lit("f").alias("source_file"), F.col("id").alias("trace_pos"), F.lit(0).alias("event_pos"),
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 9000)).alias("event_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        limit = 50
        got = quality._repeats(df, "event_id", EVENT, limit)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "hashpartitioning(event_id" in plan and "_salt" in plan
    assert sum(sizes) == 28_000 - 1 + 12_000 - 2_700
    salted = [size for size in sizes if size > 2_000]  # the others share 9,300 rows
    assert len(salted) == parts and max(salted) <= 1.5 * 28_000 / parts
