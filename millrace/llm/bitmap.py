"""One-hash Bloom filters as small tables of 64-bit words, by DataFrame functions only.

A filter of ``bits`` slots is cut into buckets of 2 ** 15 slots, a row of 512 longs each.  It
is joined by broadcast, and a slot is read from its row by index, so a test costs a hash
lookup and a shift, in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKET = 1 << 15


def filter_bits(n: int, per_key: int, most: int) -> int:
    """``per_key`` slots a key, a power of two, between one bucket and ``most``."""
    return min(most, max(BUCKET, 1 << (per_key * max(1, n) - 1).bit_length()))


def slot(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits))


def bitmap(slots: DataFrame, bits: int) -> DataFrame:
    """(bucket, words) for every bucket, of ``slots(slot)``; bits / 8 bytes in all."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))
    set_ = slots.select(F.shiftright("slot", 6).alias("word"), one.alias("bits"))
    none = slots.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_.unionAll(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = words.groupBy(F.shiftright("word", 9).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all"))
    return rows.select("bucket", F.transform("all", lambda x: x["bits"]).alias("words"))


def tested(rows: DataFrame, key: Column, filter_: DataFrame, bits: int) -> DataFrame:
    """``rows`` with boolean maybe: is the key's slot set?  Null keys are set nowhere."""
    at = slot(key, bits)
    keyed = rows.withColumns({"__bucket": F.shiftright(at, 15), "__word": F.pmod(F.shiftright(at, 6), F.lit(512)).cast("int"), "__bit": F.pmod(at, F.lit(64)).cast("int")})
    # the broadcast side has bits / 8 bytes, which the callers bound, whatever the input
    joined = keyed.join(F.broadcast(filter_.withColumnsRenamed({"bucket": "__bucket", "words": "__words"})), "__bucket", "left")
    is_set = F.call_function("shiftright", F.get("__words", F.col("__word")), F.col("__bit")).bitwiseAND(1) == 1
    return joined.withColumn("maybe", F.coalesce(is_set, F.lit(False))).drop("__bucket", "__words", "__word", "__bit")
