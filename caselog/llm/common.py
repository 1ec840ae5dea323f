"""Pieces that the operators share: tables kept in the shared folder, distributed ranks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselog.session import scratch_path

#: A word of the contracts: a run of characters other than space, tab, line feed, vertical
#: tab, form feed and carriage return. ``bytes.split()`` splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"

PLACE, PART, ROW = "_place", "_part", "_row"

#: Bytes of an Arrow batch handed to a Python worker, where the session sets no other limit.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

#: What a Python worker keeps from task to task, by name, and how to drop it. The dropping
#: function says whether there was anything.
_caches: dict[str, Callable[[], bool]] = {}


def worker_cache(name: str, drop: Callable[[], bool]) -> None:
    _caches[name] = drop


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256, uses: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most ``rows``. A Python worker serves one stage after the
    other: the caches that stages before it left there, all but the one it ``uses``, are
    dropped first and their memory is given back."""
    if any([drop() for name, drop in _caches.items() if name != uses]):
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_workers(df: DataFrame) -> DataFrame:
    """The same rows; Python workers started from here on find this package wherever the
    session began. On a cluster the package is shipped with --py-files. Batches of texts are
    bounded by bytes as well as by rows."""
    spark = df.sparkSession
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return df


def internal(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of ours that no column of the frame has, by any case."""
    taken = {c.lower() for c in df.columns}
    tail = next(i for i in range(len(taken) + 1) if not any(f"_{name}_{i}" in taken for name in names))
    return [f"_{name}_{tail}" for name in names]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, every
    executor can reach the files, and columns that are not asked for are not read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows in a global order, cut into even ranges, stored with their place.

    ``_part`` numbers the ranges in order and ``_row`` the rows of a range from 0. Both are
    written with the rows, so a lost executor can't renumber them. Rows that tie in
    ``order`` share a range; a caller whose rows may tie in bulk adds a last column.
    """
    placed = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    kept = stored(placed.withColumn(PLACE, F.monotonically_increasing_id()), name)
    return kept.withColumn(PART, F.shiftright(PLACE, 33)).withColumn(ROW, F.col(PLACE).bitwiseAND((1 << 33) - 1))


def running(df: DataFrame, **values: Column) -> DataFrame:
    """Adds the sum of each value over all rows before a row in the order of ``ordered``.

    Sums within a range come from a window on the range, those of the ranges before it from
    one row per range, whose number is that of the shuffle partitions and safe to broadcast.
    """
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", *(value.cast("long").alias(f"_v_{name}") for name, value in values.items()))
    per_part = df.groupBy(PART).agg(*(F.sum(f"_v_{name}").alias(f"_t_{name}") for name in values))
    bases = per_part.select(PART, *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values))
    local = df.select("*", *(F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)).alias(f"_l_{n}") for n in values))
    joined = local.join(F.broadcast(bases), PART)
    for name in values:
        joined = joined.withColumn(name, F.col(f"_b_{name}") + F.col(f"_l_{name}"))
    return joined.drop(*(f"_{kind}_{name}" for kind in "vbl" for name in values))
