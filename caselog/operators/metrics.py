"""Model metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.operators import ordered


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _ranking() -> list[Column]:
    """ROC-AUC (ties count half) and average precision, from one row per distinct score with
    its positives p and negatives n and the running totals tp and fp from the highest score
    down: a group's negatives are outranked by the positives before it and tie with its own."""
    won = F.sum(_d("n") * (_d("tp") - _d("p") / 2))
    precision = F.sum(_d("p") * _d("tp") / F.nullif(_d("tp") + _d("fp"), F.lit(0.0)))
    positives, negatives = F.sum("p").cast("double"), F.sum("n").cast("double")
    return [
        F.bround(won / F.nullif(positives * negatives, F.lit(0.0)), 4).alias("roc_auc"),
        F.bround(precision / F.nullif(positives, F.lit(0.0)), 4).alias("pr_auc"),
    ]


def _counts(label: str) -> list[Column]:
    return [F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")]


def _running(groups: DataFrame) -> DataFrame:
    return ordered.running_totals(groups, [F.col("s").desc()], {"tp": "p", "fp": "n"})


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: ROC-AUC and average precision. Rows are reduced to one per distinct score;
    the running totals over the scores are cut into slices, however many there are."""
    return _running(df.groupBy(_d(score).alias("s")).agg(*_counts(label))).agg(*_ranking())


def _confusion(label: str, predicted: str) -> list[Column]:
    yes, said = F.col(label) == 1, F.col(predicted) == 1
    return [F.count_if(yes & said).alias("c_tp"), F.count_if(~yes & said).alias("c_fp"), F.count_if(yes & ~said).alias("c_fn")]


def _classification() -> list[Column]:
    tp, fp, fn = (F.sum(x).cast("double") for x in ("c_tp", "c_fp", "c_fn"))
    ratio = lambda a, b: F.bround(F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0)), 4)
    return [
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
    ]


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: F1, precision, recall of class 1; 0 where the quotient is not defined."""
    return df.agg(*_confusion(label, predicted)).agg(*_classification())


def _errors(actual: str, predicted: str) -> list[Column]:
    """Sums over the rows that have both numbers."""
    y = F.when(_d(predicted).isNotNull(), _d(actual))
    e = _d(actual) - _d(predicted)
    return [
        F.count(e).alias("e_n"), F.sum(F.abs(e)).alias("e_abs"), F.sum(e * e).alias("e_sq"),
        F.sum(y).alias("y_sum"), F.sum(y * y).alias("y_sq"),
    ]


def _regression() -> list[Column]:
    n = F.nullif(F.sum("e_n").cast("double"), F.lit(0.0))
    square, mean = F.sum("e_sq") / n, F.sum("y_sum") / n
    return [
        F.bround(F.sum("e_abs") / n, 4).alias("mae_days"),
        F.bround(F.sqrt(square), 4).alias("rmse_days"),
        F.bround(1 - square / F.nullif(F.sum("y_sq") / n - mean * mean, F.lit(0.0)), 4).alias("r2_score"),
    ]


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: MAE, RMSE and R²."""
    return df.agg(*_errors(actual, predicted)).agg(*_regression())


def evaluate(
    df: DataFrame, label: str, score: str, predicted: str, actual: str, forecast: str
) -> DataFrame:
    """All metrics in one row. The rows are read once: everything is a sum over the rows of a
    score, carried through the running totals."""
    groups = df.groupBy(_d(score).alias("s")).agg(*_counts(label), *_confusion(label, predicted), *_errors(actual, forecast))
    return _running(groups).agg(*_ranking(), *_classification(), *_regression())
