"""Near-duplicate documents: BagMinHash, banding, verified multiset overlap, components.

1. A document is the bag of its five-word shingles.  One pass makes a BagMinHash signature
   and a 128-bit sum that identifies the bag; the rows, with their texts, are written.
2. Documents of one bag are one *class* from here on (map-side combined), so thousands of
   copies weigh as one.
3. Classes that share a band are candidates.  Each bucket has a pivot: its member that
   meets the most classes over all its buckets, which is the middle of a group of near copies
   and so links to most of it.  The other members are compared with the pivot; buckets of one
   group name the same pivot, so pairs are few after distinct.
4. Buckets whose members are not all in one component then are compared once more, by
   sketches: 512 slots of 8 bits, made for their members only.  A bucket is dealt in blocks by
   a hash of the member, and a task holds two blocks at most, whatever the bucket.  Only pairs
   of unlike components come out whose sketches agree to within four standard deviations of
   ``least``.  So every pair that shares a bucket is verified, known to be connected, or
   ruled out by its sketch (a pair of overlap ``least`` with probability 3e-5).
5. A pair is verified on whole texts: sum of minima over sum of maxima of shingle counts.
   Pairs are grouped by pivot, a popular one in several groups; a group holds the pivot's text
   once, first, and then the others', so a worker holds one bag.

The sketches of a bucket whose members are alike without being near copies are compared with
each other, some 10^6 pairs a second and core; nothing but likely links is emitted.

The bands are 64 runs of 8 of 256 slots: a pair of similarity 0.8 is missed with probability
5.5e-5 (simulated, as the bands share slots), and documents that share a passage of half their
length seldom meet.

Counts of buckets, pivots and components are written before rows are joined with them, so
such a join is of two plain shuffles and adaptive execution splits its hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.bagminhash import bands, rows_at_once, signatures
from millrace.llm.common import in_slices, release, written
from millrace.llm.components import relabelled
from millrace.llm.textbytes import U64, bags, blocks, mix, shingles

_SEND_ROWS = 500_000  # a broadcast of so many rows of two or four longs at most (8 to 16 MB)
_SKETCH = 512  # slots of a sketch, a byte each
_BLOCK_ROWS = 2048  # a block of a bucket, on average at most
_GROUP_PAIRS = 256  # of one pivot, verified together, on average at most

_SIGNED = pa.schema([("bag_a", pa.int64()), ("bag_b", pa.int64()), ("weight", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(column: pa.Array, size: int, m: int, n_bands: int, rows: int) -> pa.RecordBatch:
    parts = []
    for first, end, data, offsets in blocks(column, rows=rows_at_once(m)):
        row, value = shingles(data, offsets, size)
        n = end - first
        sums = [np.zeros(n, U64), np.zeros(n, U64)]
        for k, s in enumerate(sums):
            np.add.at(s, row, mix(value + U64(k + 1)))
        sig = signatures(*bags(row, value), n, m)
        parts.append((*(s.astype(np.int64) for s in sums), np.bincount(row, minlength=n), bands(sig, n_bands, rows)))
    a, b, weight, band = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros((0, n_bands), np.int64),)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * n_bands, pa.int32()), pa.array(band.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(weight), lists], schema=_SIGNED)


def signed(docs: DataFrame, size: int, m: int, n_bands: int, rows: int, text: str, key: str, others: list[str]) -> DataFrame:
    """(id, text, others, bag_a, bag_b, weight, bands) by row; ``others`` is a struct of columns passed through."""
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.lit(0).alias("none"))
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), rest.alias("others"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _sign(batch.column(1), size, m, n_bands, rows)
        return pa.RecordBatch.from_arrays([*batch.columns, *made.columns], names=["id", "text", "others", *made.schema.names])

    return slim.mapInArrow(in_slices(make), f"id long, text string, others {slim.schema['others'].dataType.simpleString()}, bag_a long, bag_b long, weight long, bands array<long>")


def _bag(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    for _, _, data, offsets in blocks(pa.array([text or ""])):
        _, value, count = bags(*shingles(data, offsets, size))
        return value, count
    return np.zeros(0, U64), np.zeros(0, np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (sorted values, counts); of two empty bags 0."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def _small(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` narrow rows, sent everywhere where they are few; beyond the bound joined by a shuffle."""
    return F.broadcast(df) if n <= _SEND_ROWS else df


def _verify(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Those (u, v) of the written ``pairs`` whose texts overlap enough; ``texts`` is (node, text).

    u is the pivot.  A null text stands for none; such a pair can't be, as classes have words.
    """
    n = pairs.count()
    slots = written(pairs.groupBy("u").agg(F.ceil(F.count("*") / _GROUP_PAIRS).alias("n")))
    dealt = pairs.join(_small(slots, n), "u").select("u", F.pmod(F.xxhash64("v"), "n").alias("slot"), F.col("v").alias("node"))
    heads = slots.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"), F.lit(None).cast("long").alias("v"), F.col("u").alias("node"))
    asked = heads.unionByName(dealt.select("u", "slot", F.col("node").alias("v"), "node"))
    rows = texts.join(_small(asked, 2 * n), "node").select("u", "slot", "v", "text")
    rows = rows.repartition("u", "slot").sortWithinPartitions("u", "slot", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None, (np.zeros(0, U64), np.zeros(0, np.int64))
        for batch in batches:
            u, v, text = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            keep = np.zeros(len(u), bool)
            for i in range(len(u)):
                bag = _bag(text[i].as_py(), size)
                if v[i] is None:
                    pivot = u[i], bag
                else:
                    assert pivot[0] == u[i]
                    keep[i] = overlap(pivot[1], bag) >= least
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(2).filter(mask)], names=["u", "v"])
        release()

    return rows.mapInArrow(run, "u long, v long")


def _members(classes: DataFrame) -> DataFrame:
    """(band, hash, node, weight, others, meets) in buckets of two classes or more.

    others: how many share the bucket; meets: their sum over all buckets of the class.
    """
    rows = classes.select("node", "weight", F.posexplode("bands").alias("band", "hash"))
    shared = written(rows.groupBy("band", "hash").agg((F.count("*") - 1).alias("others")).where("others > 0"))
    held = written(rows.join(shared, ["band", "hash"]), shared)
    return written(held.join(held.groupBy("node").agg(F.sum("others").alias("meets")), "node"), held)


def near_dedup(
    docs: DataFrame, least: float = 0.8, size: int = 5, slots: int = 256, n_bands: int = 64, band_rows: int = 8, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    A class is a component of the links of overlap >= ``least``; its id is its least
    document id (null ids last), and one row of that id is kept.  Texts of fewer than
    ``size`` words are one shingle.  Null texts and texts without words have no shingles
    and link with nothing.  Repeated rows are members each.  Extra columns are not read.
    """
    _, found = _classes(docs, [], text, key, least, size, slots, n_bands, band_rows)
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", (F.col("rid") == F.col("keep")).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.8, size: int = 5, slots: int = 256, n_bands: int = 64, band_rows: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class; all columns as they were, whatever their names.

    Of a class stays a row of its least id (null ids last; of rows that share it, any one, told
    apart by where they stand).  Rows with null or empty texts or without words all stay.
    Long texts are read whole.  Repeated rows are copies, so one stays.  An empty table gives
    an empty one.
    """
    others = [c for c in docs.columns if c != text]
    base, found = _classes(docs, others, text, key, least, size, slots, n_bands, band_rows)
    gone = written(found.where("rid <> keep").select("rid"))
    stay = base.join(_small(gone, gone.count()), "rid", "left_anti")
    back = {c: F.col(f"others.c{i}") for i, c in enumerate(others)} | {text: F.col("text")}
    return stay.select(*[back[c].alias(c) for c in docs.columns])


def _classes(docs, others, text, key, least, size, slots, n_bands, band_rows) -> tuple[DataFrame, DataFrame]:
    """The signed rows, written, and (rid, id, class_id, class_size, keep)."""
    rows = signed(docs, size, slots, n_bands, band_rows, text, key, others)
    base = written(rows.withColumn("rid", F.monotonically_increasing_id()))
    slim = base.select("rid", "id", "bag_a", "bag_b", "weight")
    # least row of each distinct bag; bags without words stay apart
    bag = base.where("weight > 0").groupBy("bag_a", "bag_b").agg(F.min("rid").alias("node"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    classes = written(bag)
    label = _links(classes.select("node", "weight", "bands"), base.select(F.col("rid").alias("node"), "text"), size, least)
    of_bag = classes.select("bag_a", "bag_b", "node", F.col("node").alias("component"))
    if label is not None:
        of_bag = of_bag.drop("component").join(label, "node", "left").select("bag_a", "bag_b", F.coalesce("component", "node").alias("component"))
    member = slim.where("weight > 0").join(of_bag.select("bag_a", "bag_b", "component"), ["bag_a", "bag_b"]).select("rid", "id", "component")
    member = written(member.unionByName(slim.where("weight = 0").select("rid", "id", F.col("rid").alias("component"))))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid"))
    top = member.groupBy("component").agg(first.alias("x"), F.count("*").alias("class_size")).where("class_size > 1")
    top = written(top.select("component", "class_size", F.col("x.id").alias("class_id"), F.col("x.rid").alias("keep")))
    every = member.join(_small(top, top.count()), "component", "left")
    alone = F.col("keep").isNull()
    return base, every.select(
        "rid", "id", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.coalesce("keep", "rid").alias("keep")
    )


def _with_pivots(members: DataFrame, least: float) -> DataFrame:
    """(u, v): each bucket's pivot u and its members v, where their weights allow a link; a pair once."""
    order = F.struct(-F.col("meets"), F.xxhash64("node"), "node")
    pivot = members.groupBy("band", "hash").agg(F.min(F.struct(order.alias("order"), "node", "weight")).alias("p")).select("band", "hash", "p.node", "p.weight")
    met = members.join(written(pivot).withColumnsRenamed({"node": "u", "weight": "wu"}), ["band", "hash"])
    fits = F.least("weight", "wu") >= F.greatest("weight", "wu") * F.lit(least)
    # each of two may be the pivot of the other in some bucket
    pairs = met.where((F.col("node") != F.col("u")) & fits).groupBy(F.least("u", "node").alias("a"), F.greatest("u", "node").alias("b")).agg(F.min("u").alias("u"))
    return pairs.select("u", F.when(F.col("u") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("v"))


def _sketched(texts: DataFrame, size: int) -> DataFrame:
    """(node, sketch): a byte of each of the slots of a longer signature."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for first, end, data, offsets in blocks(batch.column(1), rows=rows_at_once(_SKETCH)):
            sig = signatures(*bags(*shingles(data, offsets, size)), end - first, _SKETCH)
            made += [row.tobytes() for row in mix(sig).astype(np.uint8)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "sketch"])

    return texts.mapInArrow(in_slices(make), "node long, sketch binary")


def _likely(component: np.ndarray, weight: np.ndarray, block: np.ndarray, band: np.ndarray, bands: np.ndarray, sketch: np.ndarray, need: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs in one group that may link; with two blocks, only pairs across them.

    A pair that shares several bands comes out in the first: an earlier bucket of both
    compares them too, or it has only these two and they have been verified.
    """
    order = np.argsort(component, kind="stable")
    comp, w, b, s = component[order], weight[order], block[order], sketch[order]
    after = np.searchsorted(comp, comp, side="right")  # the first place of a greater component
    two = b.min() != b.max()
    left, right = [], []
    for i in np.flatnonzero(after < len(comp)):
        j = np.arange(after[i], len(comp))
        fits = np.minimum(w[j], w[i]) >= np.maximum(w[j], w[i]) * least
        j = j[fits & (b[j] != b[i])] if two else j[fits]
        for first, end in ((0, _SKETCH // 4), (0, _SKETCH)):  # a quarter first, with as many spare deviations
            share = (end - first) / _SKETCH
            at_least = need if end == _SKETCH else share * _SKETCH * least - 4 * np.sqrt(share * _SKETCH * least * (1 - least)) - 1
            j = j[np.count_nonzero(s[j, first:end] == s[i, first:end], axis=1) >= at_least] if len(j) else j
        if len(j):
            k = order[i]
            j = j[~(bands[order[j], : band[k]] == bands[k, : band[k]]).any(axis=1)]
        left.append(np.full(len(j), order[i]))
        right.append(order[j])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _by_sketch(rows: DataFrame, least: float) -> DataFrame:
    """(u, v) of unlike components that share a bucket and may link.

    ``rows`` is (band, hash, node, weight, component, n, sketch, bands); n: blocks of the bucket.
    """
    need = int(np.floor(_SKETCH * least - 4 * np.sqrt(_SKETCH * least * (1 - least))))
    dealt = rows.select("*", F.pmod(F.xxhash64("node"), F.col("n")).alias("own"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")
    dealt = dealt.select("*", other).select(
        F.xxhash64("band", "hash", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "own", "node", "weight", "component", "sketch", "band", "bands"
    )
    dealt = dealt.repartition("g").sortWithinPartitions("g")

    def pairs(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        g, own, node, weight, component = (t.column(k).to_numpy() for k in range(5))
        sketch = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(-1, _SKETCH)
        band = t.column(6).to_numpy()
        bands = pa.concat_arrays(t.column(7).chunks).flatten().to_numpy().reshape(len(g), -1)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(g)) + 1, [len(g)]))
        found: set[tuple[int, int]] = set()
        for a, b in zip(cut[:-1], cut[1:]):
            i, j = _likely(component[a:b], weight[a:b], own[a:b], band[a:b], bands[a:b], sketch[a:b], need, least)
            x, y = node[a + i], node[a + j]
            found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
        u, v = zip(*sorted(found)) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # whole groups are handed on; the last may go on in the next batch
            if not batch.num_rows:
                continue
            g = batch.column(0).to_numpy()
            last = np.flatnonzero(np.diff(g))
            begin = int(last[-1]) + 1 if len(last) else 0
            if held and (begin or g[0] != held[0].column(0)[-1].as_py()):
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, begin)]))
                held = []
            elif begin:
                yield pairs(pa.Table.from_batches([batch.slice(0, begin)]))
            held.append(batch.slice(begin))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _links(classes: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame | None:
    """(node, component) after all candidates are compared or known to be connected; None without links."""
    members = _members(classes)
    pairs = written(_with_pivots(members, least))
    new = written(_verify(pairs, texts, size, least), pairs)
    label = None if new.isEmpty() else relabelled(None, new)
    now = members.select("band", "hash", "node", "weight")
    if label is None:
        now = now.withColumn("component", F.col("node"))
    else:
        now = now.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = now.groupBy("band", "hash").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"))
    # of two classes one is the pivot: they have been compared
    now = written(now.join(written(mixed.where("a < b and n > 2").select("band", "hash")), ["band", "hash"]), members, new)
    nodes = now.select("node").distinct()
    sketch = written(_sketched(texts.join(_small(nodes, nodes.count()), "node", "left_semi"), size))
    signed_nodes = sketch.join(classes.select("node", "bands"), "node")
    count = written(now.groupBy("band", "hash").agg(F.ceil(F.count("*") / _BLOCK_ROWS).alias("n")))
    pairs = written(_by_sketch(now.join(count, ["band", "hash"]).join(signed_nodes, "node"), least), now, sketch, count)
    new = written(_verify(pairs, texts, size, least), pairs)
    return label if new.isEmpty() else relabelled(label, new)
