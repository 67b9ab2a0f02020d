"""Incremental file ingest: convert files as they land, in bounded batches.

Every batch is written to a folder of its own, ``sink/batch=<id>``, and then
entered in a log, ``log/batch=<id>``, with the rows that its write counted. Both
are overwritten when a batch runs again, so a batch that was killed at any point
counts once after a restart; readers see the batches of the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch"


def log_path(checkpoint: str) -> str:
    """The log that belongs to a checkpoint, beside it."""
    return checkpoint.rstrip("/") + "-log"


def _make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def ingest_log(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per finished batch: batch, rows written, running total."""
    log = spark.read.schema(f"rows long, {BATCH} long").parquet(log_path(checkpoint))
    upto = Window.orderBy(BATCH).rowsBetween(Window.unboundedPreceding, 0)
    # One row per batch, so this window is as small as the number of batches.
    return log.select(BATCH, "rows", F.sum("rows").over(upto).alias("rows_total"))


def read_ingested(spark: SparkSession, sink: str, checkpoint: str, *, sink_format: str = "parquet",
                  schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of the finished batches (those in the log), with their ``batch``."""
    done = [r[0] for r in ingest_log(spark, checkpoint).select(BATCH).collect()]
    reader = spark.read.format(sink_format)
    rows = (reader.schema(schema) if schema is not None else reader).load(sink)
    return rows.where(F.col(BATCH).isin(done))


def _write_batch(sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None, fmt: str, options: dict[str, str]):
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        seen = Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        counted.write.mode("overwrite").options(**options).format(fmt).save(f"{sink.rstrip('/')}/{BATCH}={batch_id}")
        entry = batch.sparkSession.range(1).select(F.lit(seen.get.get("rows", 0)).cast("long").alias("rows"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{log_path(checkpoint)}/{BATCH}={batch_id}")
    return write


def incremental_ingest(spark: SparkSession, source: str, schema: T.StructType | str, sink: str,
                       checkpoint: str, *, fmt: str = "parquet",
                       transform: Callable[[DataFrame], DataFrame] | None = None,
                       max_files_per_trigger: int = 1000, sink_format: str = "parquet",
                       sink_options: dict[str, str] | None = None,
                       source_options: dict[str, str] | None = None) -> DataFrame:
    """Process every file under ``source`` not yet seen by ``checkpoint``.

    A fixed schema, batches of at most ``max_files_per_trigger`` files (the
    bounded chunk; each batch is converted by all tasks in parallel) and an
    ``availableNow`` trigger: the query drains what is there and stops.
    Re-running picks up only new files, and a batch that failed or was killed.
    Returns the log of all batches so far (``ingest_log``).
    """
    stream = (spark.readStream.format(fmt).schema(schema)
              .option("maxFilesPerTrigger", str(max_files_per_trigger))
              .options(**(source_options or {})).load(source))
    _make_folder(spark, log_path(checkpoint))  # a source without files leaves an empty log
    write = _write_batch(sink, checkpoint, transform, sink_format, sink_options or {})
    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return ingest_log(spark, checkpoint)
