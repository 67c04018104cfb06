"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame functions only.  The steps:

1. *Targets.*  Each source has a size (words) and a weight.  ``share`` times all words
   are divided by weight; a target stops at ``cap`` times its source's size and the excess
   is reshared by weight (water filling, closed form over sources sorted by saturation).
2. *Blocks.*  A document's place in its source is a hash of its id.  The hash's leading
   digits name one of 256 blocks, so blocks are already in random order.  A source gives
   whole passes over all its blocks, then the leading blocks of one more pass up to its
   quota.  The block in which the quota ends is divided by radix selection: next digits,
   and in what is left a window over few rows.  The document at the edge gives its leading
   words, or with ``whole`` is taken or left as a whole, whichever is nearer.
3. *Tree.*  The drawn blocks of all sources are divided among ``2 ** depth`` output shards.
   A node holds one count for each source; it gives its left child half of its blocks,
   drawn as a multivariate hypergeometric variate (source after source, each univariate,
   by inversion).  Leaves so hold exact quotas of each source's blocks.
4. *Draw.*  A source's blocks, permuted by hash, are dealt to leaves in disjoint runs; in
   a shard, rows are ordered by a hash (local shuffle).

What grows with documents is one aggregation with map-side combine.  Tree and block
tables have at most (sources x 512) rows; the join with documents broadcasts them only
below ``broadcast_rows`` counted rows and is a shuffle join beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.common import SPACES, written

_DIGITS = 2  # hexadecimal digits a radix step reads: 256 blocks
_STEPS = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, place); place is the document's hash, by which a source is permuted."""
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), place(F.col(key), seed).alias("place")
    )


def place(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))


def targets(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, idx, source_size, target, quota) by source; one row per source in one task."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("idx"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("idx", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    # sources fill up in order of cap / weight: those before are full, the rest share what is left
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "idx")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("full", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
    per = per.withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.col("full")) / F.col("open"))
    # the water level is that of the first source that does not fill up
    stays = F.when(F.col("level") * F.col("weight") <= F.col("source_size") * cap, F.col("level"))
    per = per.withColumn("level", F.first(stays, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    top = (F.col("source_size") * cap).cast("double")
    target = F.least(top, F.coalesce(F.col("level") * F.col("weight"), top))
    return per.select("source", "idx", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("quota"))


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", F.substring("place", 1, _DIGITS).alias("block")).agg(F.sum("size").alias("n"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _cuts(rows: DataFrame, blocks: DataFrame, per: DataFrame, whole: bool) -> DataFrame:
    """By source: passes, and where the last pass ends: cut_place, cut_id, cut_words (of the row there)."""
    left = F.when(F.col("source_size") > 0, F.pmod("quota", "source_size")).otherwise(0)
    open_ = per.select(F.col("source").alias("s"), F.lit("").alias("prefix"), left.alias("left")).where("left > 0")
    held = rows
    for step in range(1, _STEPS + 1):
        if step == 1:
            sums = blocks.withColumnRenamed("block", "next")
        else:  # the rows of the one block of each source in which its quota ends
            held = held.join(open_.select("s", "prefix"), _same("source", "s") & F.col("place").startswith(F.col("prefix"))).drop("s", "prefix")
            sums = held.groupBy("source", F.substring("place", 1, step * _DIGITS).alias("next")).agg(F.sum("size").alias("n"))
        so_far = Window.partitionBy("source").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
        sums = sums.join(open_.select("s", "left"), _same("source", "s"))
        open_ = written(sums.where("before < left and left <= before + n").select("s", F.col("next").alias("prefix"), (F.col("left") - F.col("before")).alias("left")))
    few = held.join(open_, _same("source", "s") & F.col("place").startswith(F.col("prefix")))
    so_far = Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    few = few.groupBy("s", "source", "left", "place", "doc_id").agg(F.sum("size").alias("size"))  # repeated rows share the edge
    few = few.withColumn("before", F.coalesce(F.sum("size").over(so_far), F.lit(0)))
    some = F.col("left") - F.col("before")
    if whole:
        some = F.when(some * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    cut = few.where("before < left and left <= before + size").select(
        "s", F.col("place").alias("cut_place"), F.col("doc_id").alias("cut_id"), some.alias("cut_words"), F.col("size").alias("cut_total")
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("int")
    return per.join(cut, _same("source", "s"), "left").drop("s").withColumn("passes", passes)


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many good ones ``draws`` of ``total`` hold: the u-quantile, by the ratio of neighbouring probabilities.

    Weights are carried as logarithms; the first fold finds their peak, the second their
    sum, the third the quantile.
    """
    lo = F.greatest(F.lit(0).cast("long"), draws - (total - good))
    hi = F.least(good, draws)
    steps = F.sequence(lo, F.greatest(lo, hi - 1))
    zero = F.lit(0.0)

    def up(w: Column, k: Column) -> Column:
        return w + F.log(((good - k) * (draws - k)).cast("double") / ((k + 1) * (total - good - draws + k + 1)).cast("double"))

    def third(top: Column, mass: Column) -> Column:
        begin = F.struct(zero.alias("w"), F.exp(-top).alias("sum"), lo.alias("k"))
        return F.aggregate(
            steps,
            begin,
            lambda a, k: _let(
                up(a["w"], k),
                lambda w: F.struct(
                    w.alias("w"), (a["sum"] + F.exp(w - top)).alias("sum"), F.when(a["sum"] < mass * u, k + 1).otherwise(a["k"]).alias("k")
                ),
            ),
        )["k"]

    def second(top: Column) -> Column:
        begin = F.struct(zero.alias("w"), F.exp(-top).alias("sum"))
        mass = F.aggregate(
            steps, begin, lambda a, k: _let(up(a["w"], k), lambda w: F.struct(w.alias("w"), (a["sum"] + F.exp(w - top)).alias("sum")))
        )["sum"]
        return _let(mass, lambda m: third(top, m))

    peak = F.aggregate(
        steps,
        F.struct(zero.alias("w"), zero.alias("top")),
        lambda a, k: _let(up(a["w"], k), lambda w: F.struct(w.alias("w"), F.greatest(a["top"], w).alias("top"))),
    )["top"]
    return F.when(lo >= hi, lo).otherwise(F.least(_let(peak, second), hi))


def _halved(level: int, seed: int) -> Column:
    """Of a node's counts ``ns``, those of its left child."""
    zero = F.lit(0).cast("long")
    every = F.aggregate("ns", zero, lambda a, x: a + x)
    # an odd block goes left or right by a coin
    half = F.floor((every + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "node"), F.lit(2))) / 2).cast("long")
    start = F.struct(every.alias("total"), half.alias("draws"), F.array().cast("array<bigint>").alias("out"))

    def deal(a: Column, x: Column) -> Column:
        u = _uniform(F.lit(seed), F.lit(level), F.col("node"), F.size(a["out"]))
        return _let(
            hypergeometric(a["total"], x, a["draws"], u),
            lambda k: F.struct((a["total"] - x).alias("total"), (a["draws"] - k).alias("draws"), F.concat(a["out"], F.array(k)).alias("out")),
        )

    return F.aggregate("ns", start, deal)["out"]


def tree(counts: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """(leaf, idx, n): ``counts(idx, n)`` divided among 2 ** depth leaves of equal size (to one block a level)."""
    node = counts.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "n"))), lambda x: x["n"]).alias("ns"), F.lit(0).alias("node"))
    for level in range(depth):
        both = node.select("node", "ns", _halved(level, seed).alias("left"))
        right = F.zip_with("ns", "left", lambda n, k: n - k)
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("ns")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("ns"))
        )
        node = written(both.select(F.explode(children).alias("x")).select("x.node", "x.ns"))
    return node.select(F.col("node").alias("leaf"), F.posexplode("ns").alias("idx", "n"))


def _draws(joined: DataFrame, cuts: DataFrame, depth: int, seed: int) -> DataFrame:
    """(source, block, shards array<struct<pass, shard>>): for each block of each source, where its passes go."""
    part = F.when(F.col("block") <= F.substring("cut_place", 1, _DIGITS), 1).otherwise(0)
    times = F.col("passes") + F.coalesce(part, F.lit(0))
    draws = joined.where(times > 0).select("source", "idx", "block", F.explode(F.sequence(F.lit(1), times)).alias("pass"))
    order = Window.partitionBy("idx").orderBy(F.xxhash64(F.lit(seed), "idx", "block", "pass"), "block", "pass")
    draws = written(draws.withColumn("j", F.row_number().over(order)))
    # a source whose passes end inside a document that is left out may have no draw
    counts = draws.groupBy("idx").agg(F.count("*").alias("n"))
    counts = cuts.select("idx").join(counts, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    run = Window.partitionBy("idx").orderBy("leaf").rowsBetween(Window.unboundedPreceding, 0)
    leaves = tree(counts, depth, seed).withColumn("end", F.sum("n").over(run)).where("n > 0")
    dealt = leaves.select("idx", "leaf", F.explode(F.sequence(F.col("end") - F.col("n") + 1, F.col("end"))).alias("j"))
    placed = draws.join(dealt, ["idx", "j"])
    return placed.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", F.col("leaf").alias("shard")))).alias("shards"))


def plan(
    docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, depth: int = 6, seed: int = 0, whole: bool = False,
    broadcast_rows: int = 100_000, text: str = "text", key: str = "doc_id", source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(narrow rows, block table) from which ``draw`` takes documents."""
    rows = written(sized(docs, text, key, source, f"mix{seed}"))
    blocks = written(_blocks(rows))
    per = written(targets(blocks.withColumnRenamed("n", "size"), weights, share, cap))
    cuts = written(_cuts(rows, blocks, per, whole))
    full = blocks.join(cuts.withColumnRenamed("source", "s"), _same("source", "s")).drop("s", "n")
    dealt = _draws(full, cuts, depth, seed).withColumnsRenamed({"source": "s", "block": "b"})
    full = written(full.join(dealt, _same("source", "s") & (F.col("block") == F.col("b")), "left").drop("s", "b"))
    return rows, F.broadcast(full) if full.count() <= broadcast_rows else full


def draw(rows: DataFrame, blocks: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` (doc_id, source, size, place, ...) with source_size, target, taken and copies.

    ``copies`` is an array of (pass, shard, words, order), one for each time that the mix
    takes the document.  Rows that share id and source share the edge's words in proportion.
    """
    b = blocks.withColumnsRenamed({"source": "s", "block": "b"})
    joined = rows.join(b, F.col("source").eqNullSafe(F.col("s")) & (F.substring("place", 1, _DIGITS) == F.col("b")), "left").drop("s", "b")
    here = F.struct("place", F.coalesce("doc_id", F.lit(-(2**63)))) 
    cut = F.struct(F.col("cut_place").alias("place"), F.coalesce("cut_id", F.lit(-(2**63))))
    last = F.when(F.col("cut_place").isNull() | (here > cut), 0).when(here < cut, F.col("size")).otherwise(F.floor(F.col("size") * F.col("cut_words") / F.col("cut_total")))
    copies = F.transform(
        F.coalesce("shards", F.array().cast("array<struct<pass:int,shard:int>>")),
        lambda x: F.struct(
            x["pass"].alias("pass"), x["shard"].alias("shard"), F.when(x["pass"] <= F.col("passes"), F.col("size")).otherwise(last).cast("long").alias("words"),
            F.xxhash64(F.lit(seed), x["shard"], x["pass"], F.col("place")).alias("order"),
        ),
    )
    copies = F.filter(copies, lambda x: x["words"] > 0)
    out = joined.withColumn("copies", copies)
    return out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"])).drop(
        "cut_place", "cut_id", "cut_words", "cut_total", "passes", "shards", "idx", "quota", "block"
    )


def mix_report(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source.

    Null text has no words; documents without words are never taken but are listed.  A null
    source is a source of its own, last in order.  Repeated rows count each.  An empty table
    gives no rows; if no document has words, all targets are 0.
    """
    rows, blocks = plan(docs, seed=seed, **options)
    return draw(rows, blocks, seed).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def mix(docs: DataFrame, seed: int = 0, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, whole, as often as they are taken, with columns shard and order.

    Rows of a shard, sorted by order, are shuffled.  Texts do not move: each document reads
    off the block table what becomes of it.  Null and empty texts have no words and are never
    taken.  A null source is a source.  Rows that tie in id and source, repeated ones among
    them, are drawn alike.  Long texts count in full.  An empty table gives no rows.  Where
    ``docs`` has columns shard or order, the new ones are mix_shard and mix_order.
    """
    _, blocks = plan(docs, seed=seed, whole=True, text=text, key=key, source=source, **options)
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"),
        words(F.col(text)).alias("size"), place(F.col(key), f"mix{seed}").alias("place"),
    )
    out = draw(wide, blocks, seed).select("row", F.explode("copies").alias("copy"))
    names = {c for c in docs.columns}
    shard, order = ("shard", "order") if not names & {"shard", "order"} else ("mix_shard", "mix_order")
    return out.select("row.*", F.col("copy.shard").alias(shard), F.col("copy.order").alias(order))
