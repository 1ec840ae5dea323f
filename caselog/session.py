"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from caselog.sources.paths import delete

CHECKPOINT_KEY = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the results depend on (times are UTC instants)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build(app_name: str = "caselog", master: str | None = None, **conf) -> SparkSession:
    """Start a session; cluster settings come from spark-submit, ``conf`` adds to them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def in_workers(spark: SparkSession) -> None:
    """Lets the Python workers of a local or shared installation import this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[1]))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder: on a cluster such a
    folder exists on one machine and would be lost with it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not named and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="caselog-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate results that operators store inside the block are deleted at its end, so
    what is computed from them has to be written or collected inside it."""
    first = len(_scratch)
    try:
        yield
    finally:
        for path in _scratch[first:]:
            delete(spark, path)
        del _scratch[first:]


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again, for plans that read them several
    times: a lost executor re-reads them, and nothing before them runs again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """The rows written to ``path``, closely packed as they are read again only a few times, and read again."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside the block the shuffle files of a query are deleted when it ends. Else they stay on disk until
    the driver happens to collect its garbage, so that a job of many steps holds those of all its steps."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def together(spark: SparkSession, jobs: list[Callable], parallelism: int) -> list:
    """Results of independent Spark jobs in order, a few of them submitted at a time: one
    small job, or one round of boosting, leaves much of a cluster idle."""
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs)
