"""Table constraints as queries: Spark does not enforce keys, so violations are selected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is not in the parent table."""
    return child.join(parent.select(key), key, "left_anti")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def invalid_predictions(predictions: DataFrame) -> DataFrame:
    """Rows outside the value ranges of the prediction table."""
    c = F.col
    valid = (
        c("risk_class").isin(0, 1)
        & c("risk_probability").between(0, 1)
        & (c("predicted_processing_days") >= 0)
        & (F.trim("application_id") != "")
        & (F.trim("model_version") != "")
    )
    return predictions.where(~F.coalesce(valid, F.lit(False)))
