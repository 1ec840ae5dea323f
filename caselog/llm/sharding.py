"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2 ** bits`` cells, the cells of a row give its index on the
curve, and the rows in curve order are cut into runs of nearly equal bytes. Rows of a run are
near each other in every dimension, so a filter on any of them can skip most runs by their
smallest and largest values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.llm.common import PART, ROW, in_workers, internal, ordered, running, stored


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve for rows of cells (one column a dimension, below 2^bits).

    The cells are turned, from the highest bit down, into the frame in which the curve
    visits that level, then read as a Gray code, one bit of every dimension at a time.
    """
    x = [cells[:, d].astype(np.uint64) for d in range(cells.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        top = one << np.uint64(level)
        low = top - one
        for d in range(len(x)):
            flip = (x[d] & top) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        top = one << np.uint64(level)
        turn = np.where((x[-1] & top) != 0, turn ^ (top - one), turn)
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for column in x:
            index = (index << one) | (((column ^ turn) >> np.uint64(level)) & one)
    return index.astype(np.int64)


def text_cuts(df: DataFrame, column: str, bits: int) -> list[str]:
    """At most ``2 ** bits`` values at which a text column is cut into cells of nearly equal
    rows. Counted exactly and in a distributed order, whatever the number of values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    placed = running(ordered(counts, [F.col(column)], "cuts"), _before=F.col("_n"))
    total = placed.agg(F.sum("_n")).first()[0] or 1
    cell = F.floor((F.col("_before") + F.col("_n") / 2) * (1 << bits) / F.lit(total))
    return sorted(r["cut"] for r in placed.groupBy(cell.alias("_cell")).agg(F.min(column).alias("cut")).collect())


def _cell(value: Column, cuts: list[str]) -> Column:
    """How many cuts lie at or below a value; 0 for null."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= value)), F.lit(0))


def shards(
    df: DataFrame, size: Column, texts: tuple[str, ...] = ("source", "lang"), numbers: tuple[str, ...] = ("doc_id",),
    magnitudes: tuple[str, ...] = (), n_shards: int = 24, bits: int = 5,
) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1), ``slot`` (gapless from 0) and ``curve`` to the rows.

    ``texts`` are cut at values that split the rows evenly, ``numbers`` linearly between
    their smallest and largest value, ``magnitudes`` by the logarithm; null is cell 0. A row
    goes to the shard in which the middle of its bytes lies, so shards differ in bytes by
    about the size of a row. Equal rows are told apart by their place in the input, so a
    large group of them is cut like other rows. An empty table gives no rows.
    """
    cells: list[Column] = []
    top = (1 << bits) - 1
    for name in texts:
        cuts = text_cuts(df, name, bits)
        cells.append(_cell(F.col(name), cuts))
    scaled = {**{n: F.col(n).cast("double") for n in numbers}, **{n: F.log2(F.greatest(F.col(n), F.lit(0)) + 1.0) for n in magnitudes}}
    if scaled:
        ends = df.agg(*(f(v).alias(f"{f.__name__}_{n}") for n, v in scaled.items() for f in (F.min, F.max))).first()
        for n, v in scaled.items():
            lo, hi = ends[f"min_{n}"], ends[f"max_{n}"]
            span = (hi - lo) if lo is not None and hi > lo else 1.0
            cells.append(F.coalesce(F.floor((v - F.lit(lo)) / span * (top + 1)), F.lit(0)) if lo is not None else F.lit(0))

    @F.pandas_udf("long")
    def on_curve(*columns: pd.Series) -> pd.Series:
        grid = np.stack([np.clip(c.to_numpy(), 0, top) for c in columns], axis=1)
        return pd.Series(curve_index(grid, bits))

    rows = in_workers(df).withColumn("_bytes", size.cast("long")).withColumn("curve", on_curve(*(c.cast("long") for c in cells)))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = running(ordered(rows, [F.col("curve"), F.col("_tie")], "shards"), _start=F.col("_bytes"), _rank=F.lit(1))
    total = placed.agg(F.sum("_bytes")).first()[0] or 1
    shard = F.least(F.lit(n_shards - 1), F.floor((F.col("_start") + F.col("_bytes") / 2) * n_shards / F.lit(total)))
    placed = placed.withColumn("shard", shard.cast("int"))
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_rank") - F.col("_first")).drop(
        "_bytes", "_tie", "_place", PART, ROW, "_start", "_rank", "_first")


def document_shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Documents sharded by source, language, length and id; texts are read once for their
    size and checksum, which are stored before the cuts and ends are taken from them. Null texts have 8 bytes and the checksum of the empty text."""
    slim = docs.select(
        "doc_id", "source", "lang", F.coalesce(F.octet_length("text").cast("long"), F.lit(0)).alias("_n"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    ).withColumn("size", F.col("_n") + 8)
    return shards(stored(slim, "shard-metadata"), F.col("size"), magnitudes=("_n",), n_shards=n_shards)


def write_shards(docs: DataFrame, path: str, n_shards: int = 24) -> str:
    """Writes whole documents, one folder a shard and rows in curve order, as Parquet. Returns
    the name of the shard in the folders: ``shard``, or another if documents have such a
    column. A document travels as one value, so its own columns may have any names."""
    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + 8
    whole = docs.select(F.struct("*").alias("document"), "doc_id", "source", "lang", size.alias("size"))
    placed = shards(whole, F.col("size"), n_shards=n_shards)
    folder = "shard" if "shard" not in {c.lower() for c in docs.columns} else internal(docs, "shard")[0]
    (placed.repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot")
     .select("document.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path))
    return folder
