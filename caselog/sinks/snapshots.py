"""Parquet tables that change.

``write`` replaces a table as a whole: each write is a complete directory, and readers take
the newest one that finished. Spark marks a finished directory with ``_SUCCESS``, so a job
that dies half-way leaves the previous state in force. ``upsert`` keeps a table in buckets of
its keys and replaces those it has rows for. One writer per table is assumed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselog.session import configure, staged
from caselog.sources.paths import delete, directories, exists

PREFIX = "snapshot="
KEEP = 2


def _finished(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def current(spark: SparkSession, path: str) -> str | None:
    """Directory of the newest finished snapshot, None when there is none."""
    for name in reversed(directories(spark, path, PREFIX)):
        if _finished(spark, f"{path}/{name}"):
            return f"{path}/{name}"
    return None


def write(df: DataFrame, path: str, keep: int = KEEP) -> str:
    """Store a snapshot and drop those older than the last ``keep``."""
    spark, names = df.sparkSession, directories(df.sparkSession, path, PREFIX)
    number = int(names[-1].removeprefix(PREFIX)) + 1 if names else 1
    target = f"{path}/{PREFIX}{number:08d}"
    df.write.parquet(target)
    finished = [n for n in directories(spark, path, PREFIX) if _finished(spark, f"{path}/{n}")]
    for name in finished[:-keep]:
        delete(spark, f"{path}/{name}")
    return target


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table's rows, or those of its newest snapshot; an empty table when nothing was
    written yet."""
    if buckets_of(spark, path) is not None:
        return read_buckets(spark, path, schema).select(*schema.fieldNames())
    found = current(configure(spark), path)
    if found is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(found)


# ------------------------------------------------------------ tables in buckets of their keys
BUCKET = "bucket"
#: Buckets of a table whose first rows ask for no more, and the rows of a bucket then.
LEAST_BUCKETS, BUCKET_ROWS = 16, 250_000
_LAYOUT = "_layout"


def buckets_of(spark: SparkSession, path: str) -> int | None:
    """Number of buckets of the table at ``path``, None where there is none."""
    if not exists(spark, f"{path}/{_LAYOUT}/_SUCCESS"):
        return None
    return spark.read.schema("buckets int").parquet(f"{path}/{_LAYOUT}").first()[0]


def bucket_column(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def set_buckets(spark: SparkSession, path: str, rows: int) -> int:
    """Gives a table its number of buckets, a power of two that fits its first rows."""
    buckets = 1 << (max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)) - 1).bit_length()
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/{_LAYOUT}")
    return buckets


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, touched: Sequence[int] | None = None) -> DataFrame:
    """Rows of a table in buckets; of some buckets only, and then no other is listed or read."""
    table = configure(spark).read.schema(T.StructType([*schema, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
    return table if touched is None else table.where(F.col(BUCKET).isin(*touched))


def in_buckets(batch: DataFrame, path: str, keys: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """The rows of a stored batch with their buckets of the table at ``path``, and which
    buckets these are: at most as many numbers as there are buckets. Makes a new table's layout."""
    spark = batch.sparkSession
    buckets = buckets_of(spark, path) or set_buckets(spark, path, batch.count())
    rows = batch.withColumn(BUCKET, bucket_column(keys, buckets))
    return rows, sorted(r[0] for r in rows.select(BUCKET).distinct().collect())


def merge(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("created_at",)
) -> DataFrame:
    """Incoming rows replace stored rows with the same keys, except for the ``keep``
    columns; all other stored rows stay. The keys are unique on both sides (see ``upsert``)."""
    joined = (
        existing.withColumn("_stored", F.lit(True)).alias("o")
        .join(incoming.withColumn("_new", F.lit(True)).alias("n"), list(keys), "full_outer")
    )
    def value(c: str):
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        return F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[F.col(c) if c in keys else value(c).alias(c) for c in existing.columns])


def greatest(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a stored batch; of those with the same keys the greatest by their other
    columns. Counting finds the keys that repeat, so that whole rows are only sorted for these."""
    same = lambda a, b: reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    repeated = staged(
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys), "repeated-keys")
    if repeated.isEmpty():
        return batch
    others = [c for c in batch.columns if c not in keys]
    of_repeated = lambda kind: batch.alias("b").join(repeated.alias("r"), same("b", "r"), kind)
    chosen = of_repeated("left_semi").groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row")).select(
        *[F.col("_row")[c].alias(c) if c in others else F.col(c) for c in batch.columns]
    )
    return staged(of_repeated("left_anti").unionByName(chosen), "upserted-once")


def upsert(
    incoming: DataFrame, path: str, keys: Sequence[str], schema: T.StructType,
    keep: Sequence[str] = ("created_at",),
) -> str:
    """Merge rows into the table at ``path``. Columns the incoming rows lack are NULL. Of
    incoming rows with the same keys the greatest by their other columns is taken, so keys
    stay unique.

    The table lies in buckets by a hash of its keys. Only buckets that the batch has rows for
    are read and replaced; the others are not opened. A job that fails leaves all as it was.
    If the driver dies while the finished buckets are moved into place, some are new and some
    old; the same upsert again completes it."""
    spark = incoming.sparkSession
    rows = incoming.select(*[
        F.col(f.name).cast(f.dataType) if f.name in incoming.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema
    ])
    # a table without a layout holds no rows: there is nothing to merge with
    is_new = buckets_of(spark, path) is None
    rows, touched = in_buckets(greatest(staged(rows, "upserted"), keys), path, keys)
    if not touched:
        return path
    merged = rows if is_new else merge(read_buckets(spark, path, schema, touched), rows, [*keys, BUCKET], keep)
    # a bucket is one file; Spark writes beside the table and swaps the touched folders at the end
    (merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET).parquet(path))
    return path


# ------------------------------------------------------------ tables split by one column
def part_path(path: str, column: str, value: str) -> str:
    return f"{path}/{column}={quote(value, safe='.-_')}"


def read_parts(spark: SparkSession, path: str, column: str, schema: T.StructType) -> DataFrame:
    """All parts of a table that keeps one table in buckets per value of ``column``. The
    column is a partition column, so a filter on it prunes directories."""
    found = [f"{path}/{name}" for name in directories(spark, path, f"{column}=")]
    found = [f for f in found if buckets_of(spark, f) is not None]
    if not found:
        return spark.createDataFrame([], schema)
    return configure(spark).read.schema(schema).option("basePath", path).parquet(*found).select(*schema.fieldNames())


def upsert_part(
    incoming: DataFrame, path: str, column: str, value: str, keys: Sequence[str], schema: T.StructType
) -> str:
    """Upsert rows that all carry ``column`` = ``value``; other parts are not touched."""
    inner = T.StructType([f for f in schema if f.name != column])
    return upsert(incoming.drop(column), part_path(path, column, value), keys, inner)
