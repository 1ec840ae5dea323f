"""Staging of event-log files as they arrive.

XML is costly to parse and a gzip file is one task, so each file is parsed once, into
Parquet that every later job can split. The checkpoint remembers which files were taken;
a batch that is repeated after a failure overwrites its own directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog.session import configure
from caselog.sources import xes


def stage_new_files(
    spark: SparkSession, landing: str, staged: str, checkpoint: str, files_per_batch: int = 1000
) -> None:
    """Parse the files that are new in ``landing`` into ``staged``, then return."""
    arriving = (
        configure(spark).readStream.format("xml").schema(xes.TRACE).options(**xes.OPTIONS)
        .option("maxFilesPerTrigger", files_per_batch).load(landing)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        xes.place_traces(batch).write.mode("overwrite").parquet(f"{staged}/batch={batch_id}")

    (
        arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


def read_staged(spark: SparkSession, staged: str) -> DataFrame:
    """All staged traces. A file belongs to one batch, so (source_file, trace_pos) stays unique."""
    return configure(spark).read.parquet(staged).drop("batch")
