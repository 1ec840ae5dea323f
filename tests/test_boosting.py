"""Boosting both models in the same passes gives the trees of Spark's own trainers."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from caselog.operators import boosting, features
from caselog.operators import model as ml

RESULTS = ("_probability", "_log_days")


@pytest.fixture(scope="module")
def rows(spark):
    """Cases that hardly share a combination of features, with some missing values."""
    n, draw = F.col("id"), lambda i, k: F.pmod(F.xxhash64(n, F.lit(i)), F.lit(k))
    text = lambda i, k: F.concat(F.lit("c"), draw(i, k))
    df = spark.range(3000).select(
        n.cast("string").alias("application_id"),
        F.when(n % 17 != 0, draw(1, 5000) / 7).alias("requested_amount"),
        draw(2, 24).cast("int").alias("submission_hour"), draw(3, 7).cast("int").alias("submission_day_of_week"),
        draw(4, 12).cast("int").alias("submission_month"), F.when(n % 19 != 0, draw(5, 25)).cast("int").alias("page_count"),
        (draw(6, 3500) / 100).alias("quality_score"), F.lit(48).alias("sla_target_hours"),
        F.when(n % 5 != 0, text(7, 4)).alias("loan_goal"),
        *[text(20 + i, 3 + i).alias(c) for i, c in enumerate(features.categorical("full")) if c != "loan_goal"],
    )
    score = F.col("submission_hour") / 6 + F.col("page_count") / 9 + F.when(F.col("branch") == "c2", 2).otherwise(0) + F.col("quality_score") % 2
    return df.withColumn("log_days", F.coalesce(score, F.lit(1.0))).withColumn("breach", (F.col("log_days") > 4).cast("int"))


def _fit(rows, rounds):
    return ml.RiskModel("full", rounds=rounds).fit(rows, "breach", "log_days")


def _answers(model, rows):
    return {r[0]: [*r[1], r[2]] for r in model.transform(rows).select("application_id", *RESULTS).collect()}


def test_trees_are_those_of_sparks_trainers(rows):
    ours = _fit(rows, 5)
    binned = PipelineModel(stages=ours._model.stages[:-2]).transform(ml.inputs(rows, "full")).withColumns(
        {"_y_class": F.col("breach").cast("double"), "_y_log": F.col("log_days"), "_n": F.lit(1.0)}).coalesce(1).cache()
    theirs = [estimator.fit(binned) for estimator in ours._trees(3000.0)]
    got, wanted = _answers(PipelineModel(stages=ours._model.stages[-2:]), binned), _answers(PipelineModel(stages=theirs), binned)
    assert len(got) == 3000 and len({round(v[1], 9) for v in got.values()}) > 20
    assert all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)
    for mine, other in zip(ours._model.stages[-2:], theirs):
        assert [t.depth for t in mine.trees] == [t.depth for t in other.trees] == [5] * 5
        assert mine.treeWeights == other.treeWeights and mine.numFeatures == other.numFeatures


def test_both_models_take_a_pass_per_level(spark, rows):
    """Spark's two trainers took at least twice that."""
    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"fit-{rounds}", "")
        _fit(rows, rounds)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{rounds}"))

    try:
        assert jobs(12) - jobs(4) <= 8 * ml.DEPTH + 1  # and a checkpoint
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rows_in_many_blocks_and_tasks(rows, monkeypatch):
    whole = _answers(_fit(rows, 3)._model, ml.inputs(rows, "full"))
    monkeypatch.setattr(boosting, "DIRECT_TASKS", 2)
    monkeypatch.setattr(ml, "ROWS_PER_TASK", 500)
    parts = _answers(_fit(rows.repartition(7), 3)._model, ml.inputs(rows, "full"))
    assert all(parts[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)


def test_codes_hold_all_features():
    plan = boosting.layout([3000, 255, 25, 2, 6, 7], [False, False, False, False, True, True])
    assert max(plan.widths) == 3000 and len(plan.widths) < 6
    for f, size in enumerate(plan.sizes):
        assert sorted(set(plan.values(f).tolist())) == list(range(size))
    assert plan.columns == [0, 1, 2, 3, 4, 9, 15]


def test_other_classes_are_refused(rows):
    with pytest.raises(Exception, match="0 or 1"):
        ml.RiskModel("full", rounds=1).fit(rows.withColumn("breach", F.lit(2)), "breach", "log_days")


def test_one_models_tree_may_end_before_the_other():
    plan = boosting.layout([3, 4], [False, True])
    block = boosting.Block(np.array([[0, 5, 11]], np.uint16), None, np.array([1, -1, 1], np.int8), np.zeros(3), np.arange(3.0))
    tree = boosting._compiled([boosting.Node((3.0, 3.0, None))], plan)
    ended, going = boosting._histograms([block], plan, [tree, tree], [np.array([], int), np.array([0])], False)
    assert ended.shape == (2, 0, 8) and going[0, 0, :7].sum() == 6 and going[1, 0, -1] == 5


@pytest.fixture(scope="module")
def decided(spark):
    """Blocks of rows whose targets one category decides, and their layout."""
    plan = boosting.layout([3, 4], [False, True])
    rows = spark.range(600).selectExpr(
        "cast(id % 12 as int) as _code_0", "cast(id % 4 = 0 as double) as _y_class", "if(id % 4 = 0, 2.5D, 1.25D) as _y_log", "1.0D as _n")
    return boosting.pack(rows, plan).checkpoint(), plan


def test_nodes_of_equal_targets_take_no_pass(spark, decided):
    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"decided-{rounds}", "")
        boosting.boost(*decided, rounds, 0.1, 5, 19.5, 2)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"decided-{rounds}"))

    try:
        assert jobs(12) - jobs(4) <= 8 + 1  # and a checkpoint
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_trees_do_not_depend_on_what_is_kept(decided, monkeypatch):
    shape = lambda models: [[(n.feature, n.at, n.left) for n in t] for m in models for t in m]
    sums = lambda models: [x for m in models for t in m for n in t for x in n.sums[:2]]
    few = boosting.boost(*decided, 12, 0.1, 5, 19.5, 2)
    monkeypatch.setattr(boosting, "KEPT_LEVELS", 0)
    monkeypatch.setattr(boosting, "_ends", lambda sums, least: False)
    every = boosting.boost(*decided, 12, 0.1, 5, 19.5, 2)
    assert shape(few) == shape(every) and sums(few) == pytest.approx(sums(every), abs=1e-9)


def test_codes_are_those_of_the_models_stages(spark):
    df = spark.createDataFrame(
        [(float(i % 40), "cba"[i % 3]) for i in range(300)] + [(None, "a"), (float("nan"), "b"), (float("inf"), "c"), (-0.0, "d")],
        "_s_submission_hour double, _c_channel string").selectExpr("*", "coalesce(_s_submission_hour, double('NaN')) + 0.0D as x", "_c_channel as text")
    cuts = [0.0, 1.0, 7.5, 39.0]
    plan = boosting.layout([6, 4], [False, True])
    both = boosting.coded(df, {"_s_submission_hour": cuts}, {"_c_channel": ["a", "b", "c"]}, plan, ["x", "text"])
    bins = Bucketizer(
        splits=[-float("inf"), *cuts, float("inf")], inputCol="x", outputCol="bin", handleInvalid="keep")
    wanted = bins.transform(both).collect()
    for r in wanted:
        assert plan.values(0)[r["_code_0"]] == r["bin"]
        assert plan.values(1)[r["_code_0"]] == "abcd".index(r["text"])
    assert len(wanted) == 304
