"""Connected components of a link table, wholly as DataFrame steps.

Alternates the large-star and small-star operations until the link set stops
changing; every node then hangs directly from the least id of its component.
Each step is an aggregation with map-side combine and one equi-join whose skewed
keys (hubs) adaptive execution splits.  Nothing is collected but two counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import written


def _linked(links: DataFrame) -> DataFrame:
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        least.select("u", F.col("m").alias("v"))
    )


def _settled(links: DataFrame) -> bool:
    """Does every node hang from one root, and no root from a node?"""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.max("down").alias("root"))
    return per.where("ups > 1 or (ups = 1 and root = 1)").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links(u, v)``; component is the least id reachable.

    No links gives no rows; self-links and repeats change nothing; null ends are dropped.
    """
    now = written(_linked(links.dropna(subset=["u", "v"])))
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = written(_linked(_small_star(_linked(_large_star(now)))), now)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        roots.select("id", F.col("id").alias("component"))
    )


def relabelled(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """``label`` (node, component) after new links; only components that the links touch are solved.

    Nodes that never had a link are in no row.
    """
    if label is None:
        return written(components(links).withColumnRenamed("id", "node"))
    for end in ("u", "v"):
        of_end = label.select(F.col("node").alias(end), F.col("component").alias("__c"))
        links = links.join(of_end, end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
    merged = written(components(links))
    old = label.join(merged.select(F.col("component").alias("__c"), F.col("id").alias("component")), "component", "left")
    fresh = merged.withColumnRenamed("id", "node").join(label.select("node"), "node", "left_anti")
    return written(old.select("node", F.coalesce("__c", "component").alias("component")).unionByName(fresh.select("node", "component")))
