"""The host-partitioned crawl frontier, in batch form.

Arrivals are (seq, url, host).  The first ``slots`` distinct hosts, by first arrival, have a
queue each, in arrival order; all other hosts wait and are served by host, descending.
Hosts are ranked on one row per host; the arrivals themselves are partitioned by host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def queues(arrivals: DataFrame, slots: int) -> DataFrame:
    """``arrivals`` with queue (null: waiting) and pos (from 1, in the queue or among the host's waiting).

    Hosts with a queue are a top-k by first arrival, at most ``slots`` rows, which are sent.
    """
    hosts = arrivals.groupBy("host").agg(F.min("seq").alias("__first"))
    first = hosts.orderBy("__first").limit(slots)
    ranked = first.withColumn("queue", F.row_number().over(Window.orderBy("__first")) - 1).select(F.col("host").alias("__host"), "queue")
    # at most ``slots`` rows
    placed = arrivals.join(F.broadcast(ranked), F.col("host").eqNullSafe(F.col("__host")), "left").drop("__host")
    return placed.withColumn("pos", F.row_number().over(Window.partitionBy("host").orderBy("seq")))


def waiting_order(placed: DataFrame) -> DataFrame:
    """Waiting hosts in the order in which freed queues take them: (host, turn, urls).

    Hosts are ranked within ranges of their first two bytes, and ranges by their sizes, so no
    task holds all hosts.
    """
    hosts = placed.where("queue is null").groupBy("host").agg(F.count("*").alias("urls"))
    ranged = hosts.withColumn("__range", F.substring("host", 1, 2))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # one row a range, few
    before = F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("__range").alias("__r"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc("host")))
    joined = ranged.withColumn("__in", inside).join(sizes, F.col("__range").eqNullSafe(F.col("__r")))
    return joined.select("host", "urls", (F.col("__before") + F.col("__in")).cast("int").alias("turn"))


def lengths(placed: DataFrame) -> DataFrame:
    """(queue, urls): one row a queue, -1 for what waits."""
    return placed.groupBy(F.coalesce("queue", F.lit(-1)).cast("int").alias("queue")).agg(F.count("*").alias("urls"))


def wave(placed: DataFrame) -> DataFrame:
    """The urls that one tick fetches: the front of each queue (one request a host)."""
    return placed.where("queue is not null and pos = 1")


def pop(placed: DataFrame) -> DataFrame:
    """The frontier after the fronts are done."""
    return placed.where("not (queue is not null and pos = 1)").withColumn("pos", F.when(F.col("queue").isNull(), F.col("pos")).otherwise(F.col("pos") - 1))
