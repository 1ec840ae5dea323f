"""Parquet tables of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog import schemas
from caselog.session import configure
from caselog.sinks import snapshots
from caselog.sources.paths import directories


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one model table with its declared schema: no inference pass over the files. Of a
    table kept as snapshots the newest finished one is read; tables in buckets, split by model
    version or not, are read without the bucket."""
    path, schema = f"{root.rstrip('/')}/{name}", schemas.TABLES[name]
    if directories(spark, path, "model_version="):
        return snapshots.read_parts(spark, path, "model_version", schema)
    if snapshots.buckets_of(spark, path) is not None or directories(spark, path, snapshots.PREFIX):
        return snapshots.read(spark, path, schema)
    return configure(spark).read.schema(schema).parquet(path)


FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def counted(spark: SparkSession, path: str) -> DataFrame:
    """One row with the number of rows stored at a path (``row_count``), from the footers of
    the Parquet files: no column is read. The frame lives in a session of its own, for the
    settings that push the count down hold for a whole session."""
    own = spark.newSession()
    for key, value in FOOTERS.items():
        own.conf.set(key, value)
    return own.read.parquet(path).agg(F.count("*").alias("row_count"))


def stored_rows(spark: SparkSession, path: str) -> int:
    return counted(spark, path).first()[0]


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return configure(spark).createDataFrame([], schemas.TABLES[name])
