"""Report exports as CSV and Parquet, with a manifest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselog.functions import validation as check
from caselog.plans import kpis
from caselog.session import together
from caselog.sources.paths import delete

FORMATS = ("csv", "parquet")
CSV = {"header": True, "encoding": "UTF-8", "escape": '"'}
MANIFEST = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("source_function", T.StringType()),
    T.StructField("exported_at", T.TimestampType()),
    T.StructField("error", T.StringType()),
])

Tables = dict[str, DataFrame]

# Dataset -> (report function, builder), in export order.
DATASETS: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "executive_summary": ("executive_summary", lambda t: kpis.executive_summary(t["cases"], t["events"])),
    "application_volume_by_type": (
        "application_volume_by_type", lambda t: kpis.application_volume_by_type(t["cases"])),
    "application_volume_monthly": (
        "application_volume_over_time", lambda t: kpis.application_volume_over_time(t["cases"], "monthly")),
    "application_volume_daily": (
        "application_volume_over_time", lambda t: kpis.application_volume_over_time(t["cases"], "daily")),
    "activity_summary": ("activity_summary", lambda t: kpis.activity_summary(t["events"])),
    "resource_workload": (
        "resource_workload", lambda t, limit=None: kpis.resource_workload(t["events"], limit)),
    "lifecycle_outcomes": ("lifecycle_outcome_summary", lambda t: kpis.lifecycle_outcome_summary(t["events"])),
    "loan_goal_summary": ("loan_goal_summary", lambda t: kpis.loan_goal_summary(t["cases"])),
    "processing_time_distribution": (
        "processing_time_distribution", lambda t: kpis.processing_time_distribution(t["cases"])),
}


def as_frame(spark: SparkSession, data: Any) -> DataFrame:
    """A DataFrame as it is; a dict as one row; a non-empty list of dicts as rows."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, dict):
        data = [data]
    if not isinstance(data, list) or not all(isinstance(row, dict) for row in data):
        raise ValueError(f"data must be a DataFrame, a dict or a list of dicts, got {type(data).__name__}")
    if not data:
        raise ValueError("data is empty, nothing to export")
    return spark.createDataFrame(data)


def flat(df: DataFrame) -> DataFrame:
    """Columns CSV can hold: nested values as JSON text, intervals as text."""
    def column(f: T.StructField):
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(f.name).alias(f.name)
        if isinstance(f.dataType, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
            return F.col(f.name).cast("string").alias(f.name)
        return F.col(f.name)

    return df.select(*[column(f) for f in df.schema])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**CSV, multiLine=True).csv(path)


def _size(spark: SparkSession, path: str) -> int:
    """Bytes of the data files; only file metadata is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def _written(spark, dataset, path, kind, rows, source) -> dict[str, Any]:
    return {
        "dataset": dataset, "path": path, "format": kind, "rows": rows, "size_bytes": _size(spark, path),
        "source_function": source, "exported_at": datetime.now(timezone.utc), "error": None,
    }


def export(
    spark: SparkSession, data: Any, out: str, name: str, formats: Sequence[str] = FORMATS, source: str = "unknown"
) -> list[dict[str, Any]]:
    """Write a report in the given formats. It is computed once: with both formats the CSV
    is made from the stored Parquet. Rows are counted in what was stored (for Parquet from
    the file footers), so a repeated task cannot count twice."""
    wanted = {check.one_of(f, FORMATS, "format") for f in formats}
    df, results, rows = as_frame(spark, data), [], None
    for kind in (f for f in ("parquet", "csv") if f in wanted):
        path = f"{out.rstrip('/')}/{name}.{kind}"
        if kind == "parquet":
            df.write.mode("overwrite").parquet(path)
            df = spark.read.parquet(path)
        else:
            flat(df).write.mode("overwrite").options(**CSV).csv(path)
        if rows is None:
            rows = df.count() if kind == "parquet" else read_csv(spark, path).count()
            if rows == 0:
                delete(spark, path)
                raise ValueError("data is empty, nothing to export")
        results.append(_written(spark, name, path, kind, rows, source))
    return results


def export_dataset(
    spark: SparkSession, tables: Tables, out: str, name: str, formats: Sequence[str] = FORMATS, **options
) -> list[dict[str, Any]]:
    """Export one dataset; ``options`` go to its report (``limit`` of the resources)."""
    check.one_of(name, tuple(DATASETS), "dataset")
    source, build = DATASETS[name]
    return export(spark, build(tables, **options), out, name, formats, source)


def export_all(
    spark: SparkSession, tables: Tables, out: str, formats: Sequence[str] = FORMATS, parallelism: int = 4
) -> dict[str, Any]:
    """Export every dataset, a few at a time. One that fails is recorded and the others go on."""
    def run(name: str) -> list[dict[str, Any]]:
        try:
            return export_dataset(spark, tables, out, name, formats)
        except Exception as error:
            return [{
                **dict.fromkeys(MANIFEST.fieldNames()), "dataset": name, "source_function": DATASETS[name][0],
                "exported_at": datetime.now(timezone.utc), "error": str(error),
            }]

    done = together(spark, [lambda name=name: run(name) for name in DATASETS], parallelism)
    datasets = dict(zip(DATASETS, done))
    entries = [entry for listed in datasets.values() for entry in listed]
    manifest = f"{out.rstrip('/')}/manifest"
    spark.createDataFrame(
        [[e[c] for c in MANIFEST.fieldNames()] for e in entries], MANIFEST
    ).write.mode("append").parquet(manifest)
    good = [e for e in entries if e["error"] is None]
    return {
        "datasets": datasets, "manifest": manifest,
        "total_files": len(good), "total_rows": sum(e["rows"] for e in good),
    }


def list_exports(spark: SparkSession, out: str) -> DataFrame:
    """What is stored below an export folder: one row per dataset and format."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "part-*").load(out)
    )
    name = F.regexp_extract("path", r"/([^/]+)\.(csv|parquet)/part-[^/]*$", 1)
    kind = F.regexp_extract("path", r"/([^/]+)\.(csv|parquet)/part-[^/]*$", 2)
    return (
        files.select(name.alias("dataset"), kind.alias("format"), "length", "modificationTime")
        .where(F.col("dataset") != "")
        .groupBy("dataset", "format")
        .agg(F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("modified_at"))
        .orderBy("dataset", "format")
    )
