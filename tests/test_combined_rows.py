"""Boosting sees rows that share bins, categories and class once, with a weight."""

import pytest
from pyspark.sql import functions as F

from caselog.operators import model as ml


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(4000).select(
        n.cast("string").alias("application_id"), F.when(n % 2 == 0, "a").otherwise("b").alias("application_type"),
        F.when(n % 3 != 0, "Car").alias("loan_goal"), F.when(n % 11 != 0, (n % 5).cast("double")).alias("requested_amount"),
        F.lit(0).alias("submission_hour"), F.lit(1).alias("submission_day_of_week"), F.lit(None).cast("int").alias("submission_month"),
        (n % 5 > 2).cast("int").alias("breach"), (n % 5 + n % 2 + n % 7 / 10).cast("double").alias("log_days"),
    ).where("id % 5 != 4 or id < 90")


def test_combinations_keep_rows_and_means(spark, rows):
    same = rows.selectExpr("requested_amount as _b", "breach as _y_class", "log_days as _y_log")
    got = ml.combined(same, ["_b"])
    assert got.count() == same.select("_b", "_y_class").distinct().count() < 20
    total = same.agg(F.count("_y_log"), F.sum("_y_log")).first()
    assert got.agg(F.sum("_n"), F.sum(F.col("_n") * F.col("_y_log"))).first() == pytest.approx(tuple(total))
    apart = ml.combined(spark.range(500).selectExpr("id as _b", "id % 2 as _y_class", "id / 2 as _y_log"), ["_b"])
    assert apart.count() == 500 and {r[0] for r in apart.select("_n").distinct().collect()} == {1.0}


def test_combined_rows_train_the_same_model(rows, monkeypatch):
    seen, plain = [], lambda binned, columns: binned.withColumn("_n", F.lit(1.0))
    real = ml.combined
    monkeypatch.setattr(ml, "combined", lambda *a: seen.append(real(*a)) or seen[-1])
    fit = lambda: ml.RiskModel("real", rounds=4).fit(rows, "breach", "log_days")
    scored = lambda m: {r[0]: r[1:] for r in m.predict(rows).select("application_id", *ml.RESULTS).collect()}
    fast = scored(fit())
    assert seen[0].count() * 20 < rows.count()
    monkeypatch.setattr(ml, "combined", plain)
    slow = scored(fit())
    assert set(fast) == set(slow)
    assert all(fast[k] == pytest.approx(slow[k], abs=1e-9) for k in fast)


def test_leaves_hold_rows_and_not_combinations(rows):
    model = ml.RiskModel("real", rounds=1).fit(rows, "breach", "log_days")
    assert model._model.stages[-1].trees[0].depth > 0
    shape = model._model.stages[-1].toDebugString
    assert "feature 0 <=" in shape and not any(f"feature {i} in" in shape for i in range(4))
    few = ml.RiskModel("real", rounds=1).fit(rows.limit(39), "breach", "log_days")
    assert few._model.stages[-1].trees[0].depth == 0


def test_bins_of_few_many_and_missing_values(spark):
    df = spark.range(3000).selectExpr(
        "cast(id % 3 as double) as _s_requested_amount", "cast(id as double) as _s_submission_hour",
        "1.0D as _s_submission_day_of_week", "cast(null as double) as _s_submission_month")
    cuts = ml.fit_bins(df, "real").stages[1].getSplitsArray()
    assert cuts[0][1:-1] == [0.5, 1.5] and cuts[2][1:-1] == [0.0] and cuts[3][1:-1] == [0.0]
    assert 240 < len(cuts[1]) - 1 <= ml.BINS - 1
    sizes = [r["count"] for r in ml.fit_bins(df, "real").transform(df).groupBy("_b_submission_hour").count().collect()]
    assert max(sizes) < 30
