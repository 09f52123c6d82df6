"""Resumable batch as a stream: new files once each, reports rewritten per batch, done markers.

``availableNow`` processes what has arrived and stops; the checkpoint is the done marker. Batches are
written idempotently under their batch id, so a batch repeated after a lost driver replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def drain(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, fmt: str = "parquet") -> StreamingQuery:
    """Everything new, once: each batch goes to its own folder under ``out``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").format(fmt).save(f"{out}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def running_totals(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event type and window; later than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def rewrite_report(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame], DataFrame], state: str, report: str, checkpoint: str) -> StreamingQuery:
    """Keep a report over all batches: ``partial`` summarises a batch, ``combine`` the summaries.

    Only the summaries are kept and read again, never the rows of earlier batches. Each batch writes its report
    as a new version (``report/version=N``); readers take ``latest_report``, so none reads a folder that is
    being written. Versions before the last but one are left to the reader's clean-up.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        partial(batch).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        combine(spark.read.parquet(state).drop("batch")).write.mode("overwrite").parquet(f"{report}/version={batch_id}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest_report(spark: SparkSession, report: str) -> DataFrame:
    """The last whole version of a report (a version counts once its success marker is there)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(report)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{report}/version={max(done)}")
