"""Jobs that write tables: loading, view refresh, extensions, audit records."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog import schemas
from caselog.operators import extensions as ext
from caselog.operators import features, loading
from caselog.operators.model import ROUNDS, RiskModel
from caselog.plans import views
from caselog.session import scratch_path, shuffles_dropped, staged, stored
from caselog.sinks import snapshots
from caselog.sources import tables
from caselog.sources.paths import delete, exists, move


def _now() -> datetime:
    return datetime.now(timezone.utc)


def record_load(
    spark: SparkSession, path: str, source: str, kind: str, rows: int | None, status: str,
    started: datetime, error: str | None = None,
) -> None:
    """Append one row to the load log."""
    row = spark.range(1).select(
        F.uuid().alias("load_id"), F.lit(source).alias("source_file"), F.lit(kind).alias("load_type"),
        F.lit(rows).cast("bigint").alias("records_loaded"), F.lit(status).alias("load_status"),
        F.lit(started).cast("timestamp").alias("started_at"), F.lit(_now()).cast("timestamp").alias("completed_at"),
        F.lit(error).cast("string").alias("error_message"),
    )
    row.write.mode("append").parquet(path)


PARTIALS = "activity string, resource string, application_id string, n bigint"


class LoadResult(NamedTuple):
    cases: int
    events: int
    rejected: int


def load_log(traces: DataFrame, root: str, fail_on_bad_time: bool = False) -> LoadResult:
    """Add a log to the case and event tables below ``root``; returns the stored rows.

    Known events are left alone and known cases keep their attributes, so loading a log
    twice changes nothing but for ``rejected``, to which each load adds its events with an
    unreadable time under its load_id. Events lie in buckets by a hash of their id, and only
    the ids in the buckets of the incoming events are read to find the known ones. Rows bear
    the time they were first stored at, cases also that of the last load that changed their
    span. ``loads`` gets a row for the load, ``partials`` what the event views need of it. The
    traces are stored first and parsed from files once.

    What a step stores is deleted as soon as no later one reads it, and shuffle files with their step.
    New events are stored beside the table, some buckets at a time, and their files moved into it at the
    end; if the driver dies meanwhile, the same load again completes the events."""
    spark, started = traces.sparkSession, _now()
    staged, load_id = scratch_path(spark, "load"), uuid.uuid4().hex
    at = lambda step: f"{staged}/{step}"
    cases, events, rejected = f"{root}/cases", f"{root}/events", f"{root}/rejected"
    now, beside = F.lit(started).cast("timestamp"), f"{root}/load-{load_id}"
    try:
        with shuffles_dropped(spark):
            traces = stored(traces, at("traces"))
            incoming = stored(loading.load_cases(traces), at("cases")).withColumns({"created_at": now, "updated_at": now})
            # the choice of the first event of each id is made once, for events and rejected ones
            timed = stored(loading.timed_events(traces, fail_on_bad_time, True), at("every"))
            delete(spark, at("traces"))
            repeated = stored(loading.repeated_ids(timed), at("repeated"))
            first = loading.first_of_each(timed, repeated)
            if not repeated.isEmpty():
                timed = stored(first, at("first"))
                delete(spark, at("every"))
            found, unreadable = loading.by_time(timed)
            new = _store_new(found.withColumn("created_at", now), events, f"{beside}/events")
            bad = stored(unreadable.withColumn("load_id", F.lit(load_id)), at("bad"))
            for step in ("every", "repeated", "first"):
                delete(spark, at(step))
            stored(views.event_partials(new), f"{beside}/partials")
            move(spark, f"{beside}/events", events)
            move(spark, f"{beside}/partials", f"{root}/partials/load={load_id}")
            known = snapshots.current(spark, cases)
            snapshots.write(loading.merge_cases(spark.read.parquet(known), incoming) if known else incoming, cases)
            bad.write.mode("append").parquet(rejected)
    finally:
        delete(spark, staged)
        delete(spark, beside)
    of_load = spark.read.parquet(rejected).where(F.col("load_id") == load_id).count()
    counts = [tables.stored_rows(spark, p) for p in (snapshots.current(spark, cases), events)]
    record_load(spark, f"{root}/loads", "traces", "log", counts[1], "SUCCESS", started)
    return LoadResult(*counts, of_load)


#: Parts at most in which a load stores events, the incoming rows and the buckets of a part at least.
PARTS, PART_ROWS, PART_BUCKETS = 8, 2_000_000, 16


def _store_new(found: DataFrame, events: str, path: str) -> DataFrame:
    """Stores the events that the table does not hold in its buckets, but at ``path``. Buckets are
    compared and filled some at a time, so that a part of the events at a time is on its way."""
    spark = found.sparkSession
    rows, touched = snapshots.in_buckets(found, events, ["event_id"])
    parts = max(1, min(PARTS, found.count() // PART_ROWS, len(touched) // PART_BUCKETS))
    for part in range(parts):
        buckets = touched[part::parts]
        new = rows.where(F.col(snapshots.BUCKET).isin(buckets)) if parts > 1 else rows
        if exists(spark, f"{events}/_SUCCESS"):
            held = snapshots.read_buckets(spark, events, schemas.EVENTS, buckets)
            new = loading.new_events(held, new, [snapshots.BUCKET, "event_id"])
        (new.repartition(snapshots.BUCKET).write.mode("append").option("compression", "zstd")
         .partitionBy(snapshots.BUCKET).parquet(path))
    return snapshots.read_buckets(spark, path, schemas.EVENTS)


class Trained(NamedTuple):
    model: RiskModel
    threshold: float
    metrics: dict[str, float]


def train(
    cases: DataFrame, extensions: DataFrame, path: str, subset: str = "full", strategy: str = "median",
    seed: int = 42, rounds: int = ROUNDS,
) -> Trained:
    """From cases and extensions to a saved and evaluated model.

    The training set is stored, then split with equal shares of the application types. What
    counts as a breach is learned from the training part alone (its median or mean days);
    the held-out part is labelled with the same threshold and only evaluates."""
    spark = cases.sparkSession
    staged = scratch_path(spark, "training")
    try:
        features.training_set(cases, extensions).write.parquet(staged)
        parts = features.stratified_split(spark.read.parquet(staged), "application_type", seed=seed)
        threshold = features.training_threshold(parts[0], "processing_days", strategy)
        fitting, held_out = (features.prepare(part, threshold) for part in parts)
        model = RiskModel(subset, seed, rounds).fit(fitting, "is_sla_breach_operational", "log_processing_days")
        found = model.evaluate(held_out, "is_sla_breach_operational", "processing_days")
    finally:
        delete(spark, staged)
    model.save(path)
    return Trained(model, threshold, found)


def store_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "application_id") -> None:
    """Store a table clustered by case, with a Bloom filter of the case ids in each row group:
    the look-up of an id skips the row groups that don't hold it. Tables with the same number of buckets are counted
    per case, ordered per case and joined on the case without a shuffle. Rows are first
    gathered by bucket, so that a bucket is one file and not one per task."""
    (
        df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        .option("parquet.bloom.filter.enabled#" + key, "true").option("path", path).saveAsTable(table)
    )


def refresh_materialized_views(tables: dict[str, DataFrame], root: str) -> list[str]:
    """Store the four materialized views; returns their names in order. Readers see the
    previous contents until a new snapshot is complete."""
    for name in views.MATERIALIZED:
        snapshots.write(views.build(name, tables), f"{root.rstrip('/')}/{name}")
    return list(views.MATERIALIZED)


def refresh_loaded_views(spark: SparkSession, root: str, target: str) -> list[str]:
    """The four materialized views of the tables that ``load_log`` keeps below ``root``.

    The event views are put together from the partials that each load left, so a refresh reads
    a row per activity, resource and case and load, and no event again. Cases change with
    loads, so their two views read the case table."""
    partials = spark.read.schema(PARTIALS).parquet(f"{root}/partials")
    cases = tables.read_table(spark, root, "cases")
    built = {
        "mv_activity_summary": views.mv_activity_of_partials(partials), "mv_resource_workload": views.mv_resource_of_partials(partials),
        **{name: views.build(name, {"cases": cases}) for name in ("mv_monthly_summary", "mv_application_type_summary")},
    }
    for name, df in built.items():
        snapshots.write(df, f"{target.rstrip('/')}/{name}")
    return list(built)


def read_materialized_view(spark: SparkSession, root: str, name: str) -> DataFrame:
    found = snapshots.current(spark, f"{root.rstrip('/')}/{name}")
    if found is None:
        raise ValueError(f"{name} has not been refreshed yet")
    return spark.read.parquet(found)


class Populated(NamedTuple):
    cases: int
    written: bool


def populate_extensions(
    cases: DataFrame, path: str, audit_path: str, seed: int = 42, dry_run: bool = False
) -> Populated:
    """Generate the extensions of all cases and upsert them by case id. A row that breaks
    a table rule fails the write, which then never becomes the current snapshot."""
    spark, started = cases.sparkSession, _now()
    # the ids are all that is read of cases: stored, so that counting them is no second pass
    cases = staged(cases.select("application_id"), "case-ids")
    total = cases.count()
    if total == 0:
        raise ValueError("no cases found")
    now = F.lit(started).cast("timestamp")
    rows = ext.checked(ext.generate(cases, seed)).drop("lineage_tag").withColumns(
        {"created_at": now, "updated_at": now}
    )
    if dry_run:
        rows.write.format("noop").mode("overwrite").save()
        return Populated(total, False)
    snapshots.upsert(rows, path, ["application_id"], schemas.EXTENSIONS)
    record_load(
        spark, audit_path, f"synthetic_generator_seed_{seed}", "synthetic_extension", total, "SUCCESS", started
    )
    return Populated(total, True)
