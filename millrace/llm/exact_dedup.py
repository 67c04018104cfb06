"""Exact dedup by two-pass Bloom filtering (DataFrame functions only).

Rows are equal when their texts are equal after deleting white space.  A row's key
is the SHA-256 of that normalised text.  Finding copies would shuffle every row; here
only rows that may have a copy do:

1. Pass one maps each key to one slot of a Bloom filter and counts rows by slot, with
   map-side combine; what moves is a slot number a row.  Slots hit at least twice are the
   filter of *possibly repeated* keys.
2. Pass two does the same with an independent hash, over pass one's survivors only.
3. Rows whose slots were hit twice in both passes may repeat: they are grouped by the
   key.  All others are alone in their group and pass straight through.

A filter has at most ``max_bits`` bits (128 MB), eight a row.  Where that is too few for the
table, keys are dealt into ranges of a third hash, written in a folder each, and filtered
range after range, so the method does its work at every size and what is broadcast stays
bounded.  Texts are read once; a narrow table of keys is written and reused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.bitmap import bitmap, filter_bits, slot, tested
from millrace.llm.common import SPACES, written

_PER_ROW = 8  # slots
_SEND_ROWS = 200_000  # of some 100 bytes


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACES}]+", "")


def keys(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(rid, id, points, sha) by row; ``points`` is the original text's code points."""
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(key).cast("long").alias("id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("points"),
        F.sha2(normalised(F.col(text)), 256).alias("sha"),
    )


def _hash(turn: int) -> Column:
    return F.xxhash64("sha", F.lit(turn))


def _filter(rows: DataFrame, bits: int, turn: int) -> DataFrame:
    """The bitmap of the slots that two rows or more hit: at most bits / 8 bytes."""
    hit = rows.groupBy(slot(_hash(turn), bits).alias("slot")).count().where("count > 1")
    return written(bitmap(hit.select("slot"), bits))


def _flagged(rows: DataFrame, bits: int) -> DataFrame:
    first = tested(rows, _hash(1), _filter(rows, bits, 1), bits)
    left = first.where("maybe").drop("maybe")
    return first.where("not maybe").unionByName(tested(left, _hash(2), _filter(left, bits, 2), bits))


def flagged(rows: DataFrame, max_bits: int) -> DataFrame:
    """``rows`` (written, with sha) with boolean maybe: may another row have the same sha?"""
    n = rows.count()
    ranges = -(-_PER_ROW * n // max_bits)
    if ranges <= 1:
        return _flagged(rows, filter_bits(n, _PER_ROW, max_bits))
    bits = filter_bits(n // ranges, _PER_ROW, max_bits)
    dealt = written(rows.withColumn("__range", F.pmod(_hash(3), F.lit(ranges)).cast("int")), by="__range")
    parts = [written(_flagged(dealt.where(F.col("__range") == r).drop("__range"), bits)) for r in range(ranges)]
    return reduce(DataFrame.unionByName, parts)


def _rank(rid: Column) -> Column:
    """Greatest for the row that stays: most points, then least id (nulls last), then ``rid``.

    ~x orders longs downwards without overflow.
    """
    return F.struct(F.col("points"), F.col("id").isNotNull().alias("has"), F.bitwise_not("id").alias("down"), rid.alias("rid"))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = 1 << 30) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with most code points stays, then the least id (null ids last).
    Null and empty texts, and those of white space only, are equal to each other.  Exactly
    one row of a group is kept, also where rows repeat with one id.  Long texts are read
    whole.  An empty table gives no rows.  Other columns are not read.
    """
    rows = flagged(written(keys(docs, text, key)), max_bits)
    alone, maybe = rows.where("not maybe").drop("maybe"), rows.where("maybe").drop("maybe")
    groups = maybe.groupBy("sha").agg(F.max(_rank(F.bitwise_not("rid"))).alias("w"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(groups.select("sha", "group_size", F.bitwise_not("w.rid").alias("win"), F.when(F.col("w.has"), F.bitwise_not("w.down")).alias("keep_id")))
    # counted; beyond the bound a join of two plain shuffles, which adaptive execution splits
    found = maybe.join(F.broadcast(groups) if groups.count() <= _SEND_ROWS else groups, "sha", "left")
    one = F.col("win").isNull()
    found = found.select(
        "rid", "id", "points", "sha", F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("win", "rid").alias("win"), F.when(one, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id")
    )
    alone = alone.select("rid", "id", "points", "sha", F.lit(1).cast("long").alias("group_size"), F.col("rid").alias("win"), F.col("id").alias("keep_id"))
    return found.unionByName(alone).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("rid") == F.col("win")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = 1 << 30) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns; one row of each group.

    The keys that do repeat make a last filter, and whole rows move only where it says that a
    copy may exist, combined on the map side first.  The row that stays is that of
    ``exact_dedup``; rows that tie in all but other columns are told apart by a hash of the
    whole row.  Null and empty texts are one group.  An empty table gives an empty one.
    """
    rows = flagged(written(keys(docs, text, key)), max_bits)
    again = written(rows.where("maybe").groupBy("sha").count().where("count > 1").select("sha"))
    bits = filter_bits(again.count(), 2 * _PER_ROW, max_bits)
    seen = written(bitmap(again.select(slot(_hash(4), bits).alias("slot")), bits))
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(key).cast("long").alias("id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("points"),
        F.sha2(normalised(F.col(text)), 256).alias("sha"),
    )
    whole = tested(whole, _hash(4), seen, bits)
    best = whole.where("maybe").groupBy("sha").agg(F.max_by("row", _rank(F.xxhash64("row"))).alias("row"))
    return whole.where("not maybe").select("row.*").unionByName(best.select("row.*"))
