"""Structured Streaming forms: url ingest, upsert sink, throughput."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.url import http_only
from millrace.operators.store import folded


def url_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Lines of arriving text files that the ingest filter keeps."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path).where(http_only(F.col("value"))).select(F.col("value").alias("url"))


def throughput(events: DataFrame, at: str = "ts", size: str = "value", every: str = "5 seconds") -> DataFrame:
    """Bytes and documents by window; the same plan for batch and stream."""
    return events.groupBy(F.window(at, every).alias("w")).agg(F.sum(size).alias("bytes"), F.count("*").alias("docs"))


def upsert_sink(stream: DataFrame, key: str, order: list[str], read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is folded into the stored table, as of ``store.folded``.

    ``read`` gives the table, ``write`` replaces it by a new path.  Each column goes by its own
    last write, so a batch that runs again changes nothing.
    """

    def fold(batch: DataFrame, _: int) -> None:
        write(folded(read(), batch, key, order))

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate(totals: DataFrame, at: str, size: str) -> DataFrame:
    """``totals`` (running bytes by time) with kb_s: kilobytes a second since the row before, null for the first.

    ``totals`` is a row a tick, so few; all of them stand in one window.
    """
    order = Window.orderBy(at)
    seconds = F.col(at).cast("double") - F.lag(at).over(order).cast("double")
    return totals.withColumn("kb_s", F.when(seconds > 0, (F.col(size) - F.lag(size).over(order)) / seconds / 1000))
