"""Ordered neighbours and running totals that do not need a whole group in one task.

A plain window sorts each group in one task. That is right for groups of ordinary size
and is what :func:`neighbours` uses for them. A group above ``hot_rows`` is instead
range-partitioned on (key, order), which cuts it into slices of even size; neighbours
are found inside each slice, and one summary row per slice carries positions and
border values across.

Slices are numbered by the partition they landed in, so they are checkpointed before
use: a lost executor must not renumber them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.session import shared_dir

HOT_ROWS = 2_000_000
BROADCAST_KEYS = 100_000


def _shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return condition


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys with more rows than one task should sort. Map-side counts make this one
    narrow scan with a small shuffle, whatever the skew."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)


def _slices(df: DataFrame, by: Sequence[Column], parts: int) -> DataFrame:
    """Rows in range-partitioned slices, ``_slice`` ascending in the order of ``by``."""
    shared_dir(df.sparkSession)
    return (
        df.repartitionByRange(parts, *by).withColumn("_slice", F.spark_partition_id()).checkpoint()
    )


def _windowed(df: DataFrame, keys, order, position, lags, leads) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(
        "*",
        *([F.row_number().over(w).cast("bigint").alias(position)] if position else []),
        *[F.lag(c).over(w).alias(name) for name, c in lags.items()],
        *[F.lead(c).over(w).alias(name) for name, c in leads.items()],
    )


def _sliced(df: DataFrame, keys, order_by, position, lags, leads, parts) -> DataFrame:
    order = [F.col(c).asc_nulls_last() for c in order_by]
    rows = _slices(df, [F.col(k).asc_nulls_last() for k in keys] + order, parts)
    local = Window.partitionBy("_slice", *keys).orderBy(*order)
    # One row per (slice, key): at most one per slice plus one per key. A slice is no larger
    # than a task sorts, so the join may shuffle; Spark broadcasts the borders where they are small.
    rank = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order_by])
    border = {**lags, **leads}
    ends = F.struct(*[F.col(c).alias(name) for name, c in border.items()], F.lit(0).alias("_"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    borders = (
        rows.groupBy("_slice", *keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min_by(ends, rank).alias("_first"),
            F.max_by(ends, rank).alias("_last"),
        )
        .select(
            "_slice", *keys, "_n",
            (F.sum("_n").over(across) - F.col("_n")).alias("_before"),
            F.lag("_last").over(across).alias("_prev"),
            F.lead("_first").over(across).alias("_next"),
        )
    )
    numbered = rows.select(
        "*",
        F.row_number().over(local).alias("_rn"),
        *[F.lag(c).over(local).alias(f"_lag_{name}") for name, c in lags.items()],
        *[F.lead(c).over(local).alias(f"_lead_{name}") for name, c in leads.items()],
    )
    joined = numbered.alias("r").join(borders.alias("b"), _same("r", "b", ["_slice", *keys]))
    first, last = F.col("r._rn") == 1, F.col("r._rn") == F.col("b._n")
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        *([(F.col("r._rn") + F.col("b._before")).cast("bigint").alias(position)] if position else []),
        *[F.when(first, F.col(f"b._prev.{n}")).otherwise(F.col(f"r._lag_{n}")).alias(n) for n in lags],
        *[F.when(last, F.col(f"b._next.{n}")).otherwise(F.col(f"r._lead_{n}")).alias(n) for n in leads],
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    *,
    position: str | None = None,
    lags: dict[str, str] | None = None,
    leads: dict[str, str] | None = None,
    hot_rows: int | None = HOT_ROWS,
    sizes_of: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add the row number and the values of the previous and next row of each group.

    ``lags`` and ``leads`` map a new column to the column it takes from the neighbour.
    ``order_by`` must order the rows of a group completely; NULLs come last.
    Group sizes are counted first, on ``sizes_of`` if given: a frame with at least the same
    rows per key that is cheaper to read. ``sizes`` has them already counted (the keys and
    ``_n``), such as a case table's number of events. ``hot_rows=None`` promises that no group is too
    large for a task and saves the count.
    """
    lags, leads = lags or {}, leads or {}
    order = [F.col(c).asc_nulls_last() for c in order_by]
    if hot_rows is None:
        return _windowed(df, keys, order, position, lags, leads)
    if sizes is not None:
        hot = sizes.select(*keys, "_n").where(F.col("_n") > hot_rows)
    else:
        hot = hot_groups(df if sizes_of is None else sizes_of, keys, hot_rows)
    found = hot.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rows")).first()
    if not found.groups:
        return _windowed(df, keys, order, position, lags, leads)

    hot_keys = hot.select(*keys)
    if found.groups <= BROADCAST_KEYS:
        hot_keys = F.broadcast(hot_keys)
    is_hot = _same("d", "h", keys)
    cold_rows = df.alias("d").join(hot_keys.alias("h"), is_hot, "left_anti")
    hot_part = df.alias("d").join(hot_keys.alias("h"), is_hot, "left_semi")
    parts = max(_shuffle_width(df), -(-found.rows // hot_rows))
    return _windowed(cold_rows, keys, order, position, lags, leads).unionByName(
        _sliced(hot_part, keys, order_by, position, lags, leads, parts)
    )


def running_totals(df: DataFrame, order_by: Sequence[Column], totals: dict[str, str]) -> DataFrame:
    """Running sums over the whole frame without sorting it in one task.

    ``totals`` maps a new column to the column it accumulates, the current row included.
    The order must be complete.
    """
    rows = _slices(df, list(order_by), _shuffle_width(df))
    local = Window.partitionBy("_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    # One row per slice: the shuffle width bounds this window and the broadcast.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_slice").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in totals.items()])
        .select("_slice", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals])
    )
    return (
        rows.select("*", *[F.sum(c).over(local).alias(f"_l_{n}") for n, c in totals.items()])
        .join(F.broadcast(offsets), "_slice")
        .select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in totals])
    )
