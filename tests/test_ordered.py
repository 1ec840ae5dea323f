"""The sliced path must give what a plain window gives, whatever the skew."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from caselog.operators import features, metrics, ordered, quantiles
from caselog.plans import views
from caselog.sources import retail

RANK = dict(position="n", lags={"before": "v", "before_id": "id"}, leads={"after": "v"})


def skewed(spark, rows=4000):
    """A third of the rows on one key, many equal times, NULL values, one NULL key."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 997 == 0, None).otherwise((i % 50).cast("string"))
    return spark.range(rows).select(
        key.alias("k"), (F.hash("id") % 7).alias("t"), "id", F.when(i % 5 != 0, i * 2).alias("v")
    )


def rows_of(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_sliced_neighbours_equal_plain_window(spark):
    df = skewed(spark)
    plain = ordered.neighbours(df, ["k"], ["t", "id"], hot_rows=None, **RANK)
    sliced = ordered.neighbours(df, ["k"], ["t", "id"], hot_rows=100, **RANK)
    assert rows_of(plain) == rows_of(sliced)


def test_hot_group_is_split_over_slices(spark):
    df = skewed(spark).where(F.col("k") == "hot")
    sliced = ordered._slices(df, [F.col("k"), F.col("t"), F.col("id")], 8)
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * sum(sizes) / 8


def test_group_with_one_order_value_is_split_by_the_tie_break(spark):
    df = spark.range(3000).select(F.lit("a").alias("k"), F.lit(1).alias("t"), "id")
    got = ordered.neighbours(df, ["k"], ["t", "id"], position="n", lags={"p": "id"}, hot_rows=500)
    assert got.where((F.col("n") != F.col("id") + 1) | (F.col("p") != F.col("id") - 1)).count() == 0


def test_event_sequence_same_for_any_threshold_and_width(spark, sf):
    events = retail.order_events(spark, sf)
    want = rows_of(views.event_sequence(events, hot_rows=None))
    for width in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            assert rows_of(views.event_sequence(events, hot_rows=6)) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_running_totals(spark):
    df = skewed(spark).select("id", "t")
    order = [F.col("t"), F.col("id")]
    w = Window.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s", F.sum("id").over(w))
    assert rows_of(ordered.running_totals(df, order, {"s": "id"})) == rows_of(want)


@pytest.mark.parametrize("limit", [1, 5, 10**6])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 1.0])
def test_exact_quantile(spark, limit, q):
    df = spark.range(999).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 7).alias("x"))
    want = df.agg(F.percentile("x", F.lit(q))).first()[0]
    assert quantiles.exact_quantile(df, "x", q, exact_values=limit) == pytest.approx(want, abs=1e-12)


def test_counted_sizes_give_the_same_neighbours(spark):
    df = spark.range(3000).select((F.sqrt("id") / 8).cast("int").alias("k"), "id")
    sizes = df.groupBy("k").agg(F.count("*").alias("_n"))
    ask = dict(position="p", lags={"before": "id"}, leads={"after": "id"}, hot_rows=400)
    want = rows_of(ordered.neighbours(df, ["k"], ["id"], **ask))
    assert rows_of(ordered.neighbours(df, ["k"], ["id"], sizes=sizes, **ask)) == want


def test_exact_quantile_small(spark):
    one = spark.createDataFrame([(None,), (3.0,)], "x double")
    assert quantiles.exact_quantile(one, "x") == 3.0
    assert quantiles.exact_quantile(one.where("x > 5"), "x") is None
    two = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert quantiles.exact_quantile(two, "x") == 1.5


def test_exact_quantile_of_many_values_brackets(spark):
    df = spark.range(200_000).select((F.hash("id") % 1_000_003 / 3).alias("x"))
    want = df.agg(F.percentile("x", F.lit(0.5))).first()[0]
    assert quantiles.exact_quantile(df, "x", exact_values=1000) == pytest.approx(want, abs=1e-9)


def test_sliced_split_equals_plain_split(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("application_id"), (F.col("id") % 10 < 7).alias("y"))
    plain = features.stratified_split(df, "y", hot_rows=None)
    sliced = features.stratified_split(df, "y", hot_rows=300)
    assert [rows_of(p) for p in plain] == [rows_of(p) for p in sliced]
    shares = {r.y: r["count"] for r in plain[1].groupBy("y").count().collect()}
    assert shares == {True: 700, False: 300}


def test_folds_are_even(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("application_id"), (F.col("id") % 4 == 0).alias("y"))
    counts = features.with_folds(df, "y", 5).groupBy("y", "fold").count().collect()
    assert {(r.y, r["count"]) for r in counts} == {(True, 50), (False, 150)}


def test_ranking_metrics_match_brute_force(spark):
    rows = [(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.4), (1, 0.8), (0, 0.8), (1, 0.9), (0, 0.2)]
    pairs = [(p, n) for y, p in rows if y for z, n in rows if not z]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    ap, positives = 0.0, sum(y for y, _ in rows)
    for s in sorted({s for _, s in rows}, reverse=True):
        at_s = sum(y for y, t in rows if t == s)
        tp, said = sum(y for y, t in rows if t >= s), sum(1 for _, t in rows if t >= s)
        ap += at_s / positives * tp / said
    df = spark.createDataFrame(rows, "y int, s double")
    got = metrics.ranking_metrics(df, "y", "s").first()
    assert (got.roc_auc, got.pr_auc) == (round(auc, 4), round(ap, 4))


def test_all_metrics_come_from_one_pass(spark):
    rows = [(i % 3 == 0, (i * 7 % 11) / 11, i % 2, float(i), float(i % 5) if i % 4 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "y boolean, s double, p int, d double, f double").withColumn("y", F.col("y").cast("int"))
    got = metrics.evaluate(df, "y", "s", "p", "d", "f")
    parts = [metrics.ranking_metrics(df, "y", "s"), metrics.classification_metrics(df, "y", "p"), metrics.regression_metrics(df, "d", "f")]
    assert got.first().asDict() == {k: v for part in parts for k, v in part.first().asDict().items()}


def test_exact_quantile_between_two_clusters(spark):
    """The median lies between far clusters of values, which no bracket of ranks can cut."""
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.col("id") / 1e9).otherwise(1e9 + F.col("id") / 1e3).alias("x"))
    want = df.agg(F.percentile("x", F.lit(0.5))).first()[0]
    assert quantiles.exact_quantile(df, "x", exact_values=3) == pytest.approx(want, rel=1e-12)


def test_classification_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    assert metrics.classification_metrics(df, "y", "p").first() == (0.0, 0.0, 0.0)
