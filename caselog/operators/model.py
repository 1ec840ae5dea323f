"""Risk classifier and duration regressor on Spark ML.

Both are boosted trees over one shared preprocessing: scaled numbers, cut into bins, and
one-hot categories. The classifier predicts whether a case breaches, the regressor the logarithm
of its days. Everything fitted is one PipelineModel, so scoring is one pass.

Rows that share all bins, categories and the class take the same way through every tree, so
boosting sees each such combination once, weighted by its rows. The real features have
a bounded number of combinations however many rows there are; where combinations
hardly repeat, the rows stay as they are. Both models are boosted in the same passes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from caselog.operators import boosting, features, metrics
from caselog.session import in_workers, shared_dir, staged, together
from caselog.sources.paths import exists

MODEL_TYPE = "GradientBoostedTrees"
KIND = "caselog.risk_model"
UNFITTED = "model is not fitted yet, call fit() first"
MISSING_CATEGORY = "<none>"

# Boosting rounds and learning rate. Depth 5 allows 32 leaves, and leaves
# hold at least 20 rows.
ROUNDS, RATE, DEPTH, LEAF_ROWS, BINS = 100, 0.1, 5, 20, 255
ROWS_PER_TASK = 50_000
#: Tasks per core beyond which a task takes more rows than that, up to the second number.
TASKS_PER_CORE, MOST_ROWS_PER_TASK = 2, 2_000_000
RESULTS = ("risk_class", "risk_probability", "predicted_processing_days")


def fit_preprocessing(df: DataFrame, subset: str) -> PipelineModel:
    """From feature columns (see :func:`inputs`) to one vector: scaled numbers, then
    one-hot categories, fitted by one aggregate. Numbers get mean 0 and (population) deviation 1;
    missing ones do not enter the statistics and stay missing (NaN), a constant column becomes
    0. A category not seen in training does not fail: its part is all zero."""
    numbers, names = features.numeric(subset), list(features.categorical(subset))
    found = df.agg(
        *[F.avg(f"_n_{c}").alias(f"m_{c}") for c in numbers], *[F.stddev_pop(f"_n_{c}").alias(f"s_{c}") for c in numbers],
        *[F.collect_set(f"_c_{c}").alias(f"l_{c}") for c in names],
    ).first()
    number = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    scaled = ", ".join(
        f"(_n_{c} - {number(found[f'm_{c}'] or 0.0)}) / {number(found[f's_{c}'] or 1.0)} AS _s_{c}" for c in numbers
    )
    indexed, hot = [f"_i_{c}" for c in names], [f"_v_{c}" for c in names]
    # a row for each place in the longest list; shorter ones repeat their first label
    labels = [found[f"l_{c}"] for c in names]
    rows = [tuple(x[i] if i < len(x) else x[0] for x in labels) for i in range(max(map(len, labels)))]
    indexing = StringIndexer(
        inputCols=[f"_c_{c}" for c in names], outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc",
    ).fit(df.sparkSession.createDataFrame(rows, StructType([StructField(f"_c_{c}", StringType()) for c in names])))
    return PipelineModel(stages=[
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        indexing,
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True).fit(indexing.transform(df)),
        VectorAssembler(inputCols=[*(f"_s_{c}" for c in numbers), *hot], outputCol="_features", handleInvalid="keep"),
    ])


def _few_values(df: DataFrame, names: list[str], most: int) -> dict[str, list[float] | None]:
    """The values of each column, sorted; None for a column of more than ``most``."""
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.empty(0) for c in names}
        for batch in batches:
            for c in [c for c in names if len(held[c]) <= most]:
                x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                held[c] = np.union1d(held[c], x[~np.isnan(x)] + 0.0)[:most + 1]
        for c, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(x), pa.string()), pa.array(x, pa.float64())], ["name", "value"])

    in_workers(df.sparkSession)
    found = df.select(*names).mapInArrow(values, "name string, value double").groupBy("name").agg(
        F.slice(F.array_sort(F.collect_set("value")), 1, most + 1).alias("listed"))
    listed = {r["name"]: r["listed"] for r in found.collect()}
    return {c: v if len(v := listed.get(c, [])) <= most else None for c in names}


def fit_bins(scaled: DataFrame, subset: str) -> PipelineModel:
    """Cuts of the scaled numbers into at most ``BINS`` bins, the last one of missing numbers:
    between all values of a number that has few, at quantiles of the others."""
    names = [f"_s_{c}" for c in features.numeric(subset)]
    most = BINS - 1
    values = _few_values(scaled, names, most)
    several = [c for c in names if values[c] is None]
    cuts = {c: [(a + b) / 2 for a, b in zip(v, v[1:])] for c, v in values.items() if v is not None}
    if several:
        shares = [i / most for i in range(1, most)]
        cuts.update(zip(several, scaled.approxQuantile(several, shares, 0.1 / most)))
    ends = float("inf")
    names_of = lambda kind: [f"_{kind}_{c}" for c in features.numeric(subset)]
    # a sum is never -0.0, which Bucketizer puts below 0.0
    known = ", ".join(f"COALESCE(_s_{c}, DOUBLE('NaN')) + 0.0D AS _d_{c}" for c in features.numeric(subset))
    return PipelineModel(stages=[
        SQLTransformer(statement=f"SELECT *, {known} FROM __THIS__"),
        Bucketizer(
            splitsArray=[[-ends, *(sorted({x + 0.0 for x in cuts[c]}) or [0.0]), ends] for c in names],
            inputCols=names_of("d"), outputCols=names_of("k"), handleInvalid="keep"),
        # a sum has no attributes: trees take the bins as numbers in order, not as categories
        SQLTransformer(statement="SELECT *, " + ", ".join(
            f"{k} + 0.0D AS {b}" for k, b in zip(names_of("k"), names_of("b"))) + " FROM __THIS__"),
    ])


def combined(binned: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``columns``, _y_class and _y_log with a weight _n: one row per combination of
    columns and class, with the mean of _y_log; or all rows if combinations hardly repeat."""
    keys = [*columns, "_y_class"]
    size = binned.agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("groups"), F.count(F.lit(1)).alias("rows")).first()
    if size["groups"] * 2 > size["rows"]:
        return binned.withColumn("_n", F.lit(1.0))
    return binned.groupBy(*keys).agg(F.avg("_y_log").alias("_y_log"), F.count(F.lit(1)).cast("double").alias("_n"))


def inputs(df: DataFrame, subset: str) -> DataFrame:
    """Feature columns in the types and names the preprocessing reads."""
    return df.withColumns({
        **{f"_n_{c}": F.col(c).cast("double") for c in features.numeric(subset)},
        **{f"_c_{c}": F.coalesce(F.col(c), F.lit(MISSING_CATEGORY)) for c in features.categorical(subset)},
    })


class RiskModel:
    """``fit`` on a frame of features and targets, then ``predict``, ``evaluate``, ``save``."""

    def __init__(self, subset: str = "full", seed: int = 42, rounds: int = ROUNDS):
        features.columns(subset)
        self.subset, self.seed, self.rounds = subset, seed, rounds
        self.model_type = MODEL_TYPE
        self._model: PipelineModel | None = None

    @property
    def is_fitted(self) -> bool:
        return self._model is not None

    def _trees(self, rows: float) -> list:
        """A leaf holds at least ``LEAF_ROWS`` rows, counted by weight; fewer than two leaves' rows
        are not split."""
        shape = dict(
            featuresCol="_binned", weightCol="_n", maxIter=self.rounds, stepSize=RATE, maxDepth=DEPTH if rows >= 2 * LEAF_ROWS else 0,
            minInstancesPerNode=1, minWeightFractionPerNode=(LEAF_ROWS - 0.5) / max(rows, 2 * LEAF_ROWS),
            maxBins=BINS, seed=self.seed, checkpointInterval=10,
        )
        return [
            GBTClassifier(labelCol="_y_class", predictionCol="_class", **shape)
            .setProbabilityCol("_probability").setRawPredictionCol("_raw"),
            GBTRegressor(labelCol="_y_log", predictionCol="_log_days", **shape),
        ]

    def fit(self, df: DataFrame, breach: str, log_days: str) -> RiskModel:
        """Train on rows that have both targets. These rows and their codes are stored in the shared
        folder and the blocks that boosting reads are checkpointed, so that the plan of the
        rows runs once and the many passes read them."""
        features.require(df.columns, self.subset)
        spark = df.sparkSession
        shared_dir(spark)
        rows = inputs(df, self.subset).where(F.col(breach).isNotNull() & F.col(log_days).isNotNull())
        scaled, binned, texts, numbers = ([f"_{kind}_{c}" for c in names(self.subset)] for kind, names in (
            ("s", features.numeric), ("b", features.numeric), ("c", features.categorical), ("n", features.numeric)))
        slim = staged(rows.select(
            *numbers, *texts, F.col(breach).cast("double").alias("_y_class"), F.col(log_days).alias("_y_log")), "training")
        scaling, indexing, hot, _ = fit_preprocessing(slim, self.subset).stages
        bins = fit_bins(scaling.transform(slim), self.subset)
        assembler = VectorAssembler(inputCols=[*binned, *hot.getOutputCols()], outputCol="_binned", handleInvalid="keep")
        cuts = bins.stages[1].getSplitsArray()
        plan = boosting.layout(
            [*map(len, cuts), *hot.categorySizes], [False] * len(binned) + [True] * len(texts))
        coded = staged(boosting.coded(
            scaling.transform(slim), {c: s[1:-1] for c, s in zip(scaled, cuts)}, dict(zip(texts, indexing.labelsArray)),
            plan, ["_y_class", "_y_log"]), "coded")
        blocks = boosting.pack(combined(coded, boosting.code_columns(plan)), plan).checkpoint()
        # Boosting runs hundreds of short jobs: as many tasks as the rows are worth, no more.
        found = blocks.agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")).first()
        tasks = lambda size: max(1, -(-found["rows"] // size))
        most = max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, tasks(MOST_ROWS_PER_TASK))
        estimators = self._trees(found["total"])
        shape = estimators[0]
        models = boosting.boost(
            blocks, plan, self.rounds, RATE, shape.getMaxDepth(), shape.getMinWeightFractionPerNode() * found["total"],
            min(tasks(ROWS_PER_TASK), most))
        trees = [boosting.as_model(e, spark, m, plan, RATE) for e, m in zip(estimators, models)]
        self._model = PipelineModel(stages=[scaling, indexing, bins, hot, assembler, *trees])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """The frame with risk_class, risk_probability (of class 1) and
        predicted_processing_days, unrounded."""
        if self._model is None:
            raise RuntimeError(UNFITTED)
        features.require(df.columns, self.subset)
        scored = self._model.transform(inputs(df, self.subset))
        return scored.select(
            *df.columns,
            F.col("_class").cast("int").alias("risk_class"),
            vector_to_array("_probability")[1].alias("risk_probability"),
            F.expm1(F.greatest(F.col("_log_days"), F.lit(0.0))).alias("predicted_processing_days"),
        )

    def evaluate(self, df: DataFrame, breach: str, days: str) -> dict[str, float]:
        """Metrics on labelled rows, rounded to four decimals."""
        shared_dir(df.sparkSession)
        rows = df.select(*features.columns(self.subset), F.col(breach).alias("_label"), F.col(days).alias("_days"))
        scored = self.predict(rows).select("_label", "_days", *RESULTS).checkpoint()
        row = metrics.evaluate(
            scored, "_label", "risk_probability", "risk_class", "_days", "predicted_processing_days"
        ).first()
        return row.asDict()

    def cross_validate(
        self, df: DataFrame, breach: str, days: str, folds: int = 5, key: str = "application_id",
        parallelism: int = 2,
    ) -> dict[str, float]:
        """Mean metrics over stratified folds of the training rows. A metric that a fold lacks
        (ROC-AUC of a single class) is the mean of the other folds, NULL if none has it."""
        shared_dir(df.sparkSession)
        log_days = F.when(F.col(days).isNotNull(), F.log1p(F.greatest(F.col(days), F.lit(0.0))))
        parts = features.with_folds(df, breach, folds, key, self.seed).withColumn("_log", log_days).checkpoint()

        def run(i: int) -> dict[str, float]:
            fold_model = RiskModel(self.subset, self.seed, self.rounds)
            fold_model.fit(parts.where(F.col("fold") != i), breach, "_log")
            return fold_model.evaluate(parts.where(F.col("fold") == i), breach, days)

        results = together(df.sparkSession, [lambda i=i: run(i) for i in range(folds)], parallelism)
        wanted = ("roc_auc", "pr_auc", "f1_score", "mae_days")
        found = {m: [r[m] for r in results if r[m] is not None] for m in wanted}
        return {f"cv_mean_{m}": round(sum(v) / len(v), 4) if v else None for m, v in found.items()}

    def save(self, path: str) -> str:
        if self._model is None:
            raise RuntimeError(UNFITTED)
        spark = SparkSession.active()
        self._model.write().overwrite().save(f"{path}/model")
        about = {"kind": KIND, "subset": self.subset, "seed": self.seed, "rounds": self.rounds,
                 "model_type": self.model_type}
        spark.range(1).select(F.lit(json.dumps(about)).alias("value")).write.mode("overwrite").text(f"{path}/about")
        return path

    @classmethod
    def load(cls, path: str) -> RiskModel:
        spark = SparkSession.active()
        if not exists(spark, path):
            raise FileNotFoundError(f"no model at {path}")
        if not exists(spark, f"{path}/about"):
            raise TypeError(f"{path} does not hold a {cls.__name__}")
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        if about.get("kind") != KIND:
            raise TypeError(f"{path} does not hold a {cls.__name__}")
        model = cls(about["subset"], about["seed"], about["rounds"])
        model.model_type = about["model_type"]
        model._model = PipelineModel.load(f"{path}/model")
        return model


def dummy_predictions(test: DataFrame, train: DataFrame, breach: str, days: str, center: str = "median") -> DataFrame:
    """Baseline: the majority class of the training rows, and their mean or median days."""
    share = train.agg(F.avg(F.col(breach).cast("double"))).first()[0] or 0.0
    value = features.training_threshold(train, days, center)
    return test.withColumns({
        "risk_class": F.lit(int(share > 0.5)),
        "risk_probability": F.lit(float(share)),
        "predicted_processing_days": F.lit(value),
    })


def ablation(
    train: DataFrame, test: DataFrame, breach: str, log_days: str, days: str, seed: int = 42, rounds: int = ROUNDS
) -> dict[str, dict[str, float]]:
    """Metrics of the real and the full feature set and their difference."""
    results = {
        subset: RiskModel(subset, seed, rounds).fit(train, breach, log_days).evaluate(test, breach, days)
        for subset in features.SUBSETS
    }
    results["delta"] = {m: round(results["full"][m] - results["real"][m], 4) for m in results["full"]}
    return results
