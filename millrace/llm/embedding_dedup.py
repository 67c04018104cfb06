"""Embedding near-dedup by a random-projection tree forest.

1. *Nodes.*  Vectors that are equal in all components are one node that counts as many.
2. *Balls.*  Nodes within 4.5 degrees of a pivot are at most 9 degrees apart, so they are all
   linked (cosine 0.95 is 18.2 degrees) without comparing.  Pivots are found within the cells of
   the first tree; a cell that holds more than ``_CELL`` nodes is dealt out by a hash, and
   its pivots meet again in a further round, with their radii.  So a group of near copies
   weighs as one from here on, and no task holds more than a cell.
3. *Forest.*  A tree splits at random directions, at the median of a bounded sample; below
   the sample's resolution at the sample's overall median.  Vectors near a split go both
   ways (spill).  Depth grows with the number of balls, and the number of trees with depth.
4. *Leaves.*  Pivots are compared within leaves, as 16-bit components with a known error.  An
   overfull leaf is dealt in blocks, and a task holds two at most.  An angle that with radii and
   error says that all members are linked, or none, decides; what remains is compared member
   by member, in double precision.
5. *Union.*  Links between balls make the components; counts of links add ball sizes.

All links but those within a ball come from leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import in_slices, release, written
from millrace.llm.components import components

SAMPLE = 8192  # rows that trees are fitted on, by least hash; one in a thousand beyond, up to eight times as many
_LEAF = 64
_CELL = 2048  # nodes of a cell, on average at most
_BLOCK = 1024  # of an overfull leaf
_RADIUS = np.deg2rad(4.5)
_SEND_ROWS = 200_000  # of a few longs
_ROUNDS = 6


def unit(vectors) -> np.ndarray:
    """Rows of length 1, in double precision, also where squares would overflow."""
    x = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(x: np.ndarray) -> np.ndarray:
    """Unit rows as 16-bit components."""
    return np.rint(x * 32767).astype(np.int16)


def error(d: int) -> float:
    """How far the cosine of two packed rows of ``d`` components may be from the true one."""
    one = np.sqrt(d) * 0.5 / 32767
    return float(2 * one + one * one + 1e-6)


@dataclass
class Tree:
    """Directions and node thresholds by level, and the half-width of the spill by level."""

    directions: np.ndarray
    thresholds: list[np.ndarray]
    spill: np.ndarray

    def cells(self, x: np.ndarray, spill: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of each row of ``x``; with ``spill``, several cells a row."""
        row, cell = np.arange(len(x)), np.zeros(len(x), np.int64)
        if not len(x):
            return row, cell
        p = x @ self.directions.T
        for level, t in enumerate(self.thresholds):
            at = p[row, level] - (t[cell] if len(t) > 1 else t[0])
            width = self.spill[level] if spill else 0.0
            right, left = at > -width if spill else at > 0, at < width if spill else at <= 0
            row, cell = np.concatenate((row[left], row[right])), np.concatenate((2 * cell[left], 2 * cell[right] + 1))
        return row, cell


def fit(sample: np.ndarray, depth: int, seed: int, width: float = 0.08) -> Tree:
    rng = np.random.default_rng(seed)
    d = sample.shape[1] if sample.ndim == 2 and sample.shape[1] else 1
    fitted = max(0, int(np.log2(max(1, len(sample) / 8))))  # levels with a median for each node
    directions = rng.standard_normal((depth, d))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    p = sample @ directions.T if len(sample) else np.zeros((0, depth))
    cell, thresholds = np.zeros(len(sample), np.int64), []
    for level in range(depth):
        t = np.full(1 << level if level < fitted else 1, np.median(p[:, level]) if len(p) else 0.0)
        if level < fitted:
            order = np.argsort(cell, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
                if len(part) >= 8:
                    t[cell[part[0]]] = np.median(p[part, level])
        thresholds.append(t)
        cell = 2 * cell + (p[:, level] > (t[cell] if len(t) > 1 else t[0]))
    return Tree(directions, thresholds, width * (p.std(axis=0) if len(p) else np.zeros(depth)))


def depth_for(n: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n) / leaf))))


def trees_for(depth: int) -> int:
    """More trees for deeper ones, as each level parts some near pairs."""
    return max(5, int(np.ceil(0.6 * depth)))


def greedy_balls(x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the row that is its pivot, and the angle to it.

    The first row that is left takes all rows whose own balls lie within its own.
    """
    n = len(x)
    pivot, off = np.arange(n), np.zeros(n)
    social = np.zeros(n, bool)
    for s in range(0, n, 512):
        social[s : s + 512] = (x[s : s + 512] @ x.T >= np.cos(_RADIUS)).sum(axis=1) > 1
    left = np.flatnonzero(social)
    while len(left):
        far = angle(x[left] @ x[left[0]])
        far[0] = 0.0
        member = far + radius[left] <= _RADIUS
        member[0] = True
        pivot[left[member]], off[left[member]] = left[0], far[member]
        left = left[~member]
    return pivot, off


def angle(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _small(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` narrow rows, sent where they are few; beyond the bound joined by a shuffle."""
    return F.broadcast(df) if n <= _SEND_ROWS else df


def _round(items: DataFrame, cells: Tree) -> tuple[DataFrame, bool]:
    """(node, q, pivot, off) of ``items(node, q, radius)``, written, and whether a cell was dealt out."""
    scale = np.float32(1 / 32767)

    def placed(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int16).reshape(b.num_rows, -1).astype(np.float64)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.cells(x / 32767, False)[1] if b.num_rows else np.zeros(0, np.int64))], names=["node", "q", "radius", "cell"])

    rows = items.select("node", "q", "radius").mapInArrow(in_slices(placed), "node long, q binary, radius double, cell long")
    full = written(rows.groupBy("cell").count().where(F.col("count") > _CELL).select("cell", F.ceil(F.col("count") / _CELL).alias("parts")))
    n = full.count()
    dealt = rows.join(_small(full, n), "cell", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), "parts"), F.lit(0)))

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("node").reset_index(drop=True)
        x = np.frombuffer(b"".join(b["q"]), np.int16).reshape(len(b), -1).astype(np.float32) * scale
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        pivot, off = greedy_balls(x, b["radius"].to_numpy())
        return b.assign(pivot=b["node"].to_numpy()[pivot], off=off)[["node", "q", "radius", "pivot", "off"]]

    return written(dealt.groupBy("cell", "part").applyInPandas(gather, "node long, q binary, radius double, pivot long, off double"), full), n > 0


def _balls(nodes: DataFrame, cells: Tree) -> tuple[DataFrame, DataFrame]:
    """(node, ball) of all nodes, and (ball, q, radius) of the pivots; written.

    radius: no member is farther from the pivot.
    """
    items = nodes.select("node", "q", F.lit(0.0).alias("radius"))
    member = None
    for _ in range(_ROUNDS):
        found, again = _round(items, cells)
        step = found.select("node", F.col("pivot").alias("__ball"))
        member = step.withColumnRenamed("__ball", "ball") if member is None else member.join(step.withColumnRenamed("node", "ball"), "ball").select("node", F.col("__ball").alias("ball"))
        radius = found.groupBy("pivot").agg(F.max(F.col("off") + F.col("radius")).alias("radius"))
        before = items
        items = written(found.where("node = pivot").select("node", "q").join(radius.withColumnRenamed("pivot", "node"), "node"))
        member = written(member)
        if not again or items.count() > 0.9 * before.count():
            break
    return member, items.withColumnRenamed("node", "ball")


def _near_pairs(reps: DataFrame, forest: list[Tree], least: float, wrong: float) -> DataFrame:
    """(p, q, cosine) of balls whose pivots are near enough for a link between members; p < q, distinct."""
    limit = float(angle(least))

    def leaves(b: pa.RecordBatch, whole: bool) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int16).reshape(b.num_rows, -1).astype(np.float64) / 32767 if b.num_rows else np.zeros((0, 1))
        parts = [t.cells(x, True) for t in forest]
        rows = np.concatenate([r for r, _ in parts]) if parts else np.zeros(0, np.int64)
        tree = np.concatenate([np.full(len(r), k, np.int32) for k, (r, _) in enumerate(parts)])
        leaf = np.concatenate([c for _, c in parts])
        columns = [pa.array(tree), pa.array(leaf)]
        if whole:
            columns += [c.take(pa.array(rows)) for c in (b.column(0), b.column(1), b.column(2))]
        return pa.RecordBatch.from_arrays(columns, names=["tree", "leaf", "ball", "q", "radius"][: len(columns)])

    slim = reps.select("ball", "q", "radius")
    full = slim.mapInArrow(in_slices(lambda b: leaves(b, False), 1 << 20), "tree int, leaf long").groupBy("tree", "leaf").count()
    full = written(full.where(F.col("count") > _BLOCK).select("tree", "leaf", F.ceil(F.col("count") / _BLOCK).alias("parts")))
    placed = slim.mapInArrow(in_slices(lambda b: leaves(b, True), 1 << 20), "tree int, leaf long, ball long, q binary, radius double")
    placed = placed.join(_small(full, full.count()), ["tree", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("ball"), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = placed.select("*", other).select(F.xxhash64("tree", "leaf", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "own", "ball", "radius", "q")
    dealt = dealt.repartition("g").sortWithinPartitions("g")

    def compared(own: np.ndarray, ball: np.ndarray, radius: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        two = own.min() != own.max()
        floor = np.cos(min(np.pi, limit + radius.max() * 2)) - wrong
        out = []
        for i in range(0, len(x), 512):
            c = x[i : i + 512] @ x.T
            u, w = np.nonzero(c >= floor)
            u, c = u + i, c[u, w]
            ok = ball[u] < ball[w]
            if two:
                ok &= own[u] != own[w]
            u, w, c = u[ok], w[ok], c[ok]
            ok = angle(c + wrong) <= limit + radius[u] + radius[w]
            out.append((ball[u[ok]], ball[w[ok]], c[ok].astype(np.float64)))
        return tuple(np.concatenate(k) for k in zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            g, own, ball, radius = (t.column(k).to_numpy() for k in range(4))
            x = np.frombuffer(b"".join(t.column(4).to_pylist()), np.int16).reshape(len(g), -1).astype(np.float32) / np.float32(32767)
            edge = np.concatenate(([0], np.flatnonzero(np.diff(g)) + 1, [len(g)]))
            found = [compared(own[s:e], ball[s:e], radius[s:e], x[s:e]) for s, e in zip(edge[:-1], edge[1:])]
            p, q, c = (np.concatenate(k) for k in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(c)], names=["p", "q", "cosine"])

        for b in batches:  # whole groups are handed on; the last may go on in the next batch
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(g))
            begin = int(cut[-1]) + 1 if len(cut) else 0
            if held and (begin or g[0] != held[0].column(0)[-1].as_py()):
                yield groups([*held, b.slice(0, begin)])
                held = []
            elif begin:
                yield groups([b.slice(0, begin)])
            held.append(b.slice(begin))
        if held:
            yield groups(held)
        release()

    pairs = dealt.mapInArrow(run, "p long, q long, cosine double")
    return written(pairs.groupBy("p", "q").agg(F.max("cosine").alias("cosine")), full)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def near_dedup(vectors: DataFrame, least: float = 0.95, trees: int | None = None, vector: str = "embedding", key: str = "vec_id", sample_rows: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id = component_id).

    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing.  Vectors are compared in double precision with those of their own length, in one
    run for each length that two or more have.  Repeated rows link with each other.  Null ids
    take part but are no component's id unless it has no other.  Other columns are not read,
    whatever their names.  An empty table gives no rows.
    """
    v = F.col("v")
    clean = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    base = written(base.select("*", F.coalesce(clean, F.lit(False)).alias("ok"), F.monotonically_increasing_id().alias("rid")))
    lengths = base.where("ok").groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect()  # a row for each length
    usable = F.col("ok") & F.size("v").isin([x["d"] for x in lengths])
    out = base.where(~usable).select("rid", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("rid").alias("component"))
    for x in lengths:
        out = out.unionByName(_linked(base.where(F.col("ok") & (F.size("v") == x["d"])), x["count"], x["d"], least, trees, sample_rows))
    least_id = out.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    least_id = written(least_id.select("component", "component_id", F.lit(True).alias("several")))
    every = out.join(_small(least_id, least_id.count()), "component", "left")
    every = every.withColumn("component_id", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("vec_id")))
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _linked(rows: DataFrame, n: int, d: int, least: float, trees: int | None, sample_rows: int) -> DataFrame:
    """(rid, vec_id, n_links, component) of ``n`` clean vectors of length ``d``; written.  A component is the rid of one of its rows."""
    # equal vectors are one node: hashes of 128 bits meet, with map-side combine; -0.0 equals 0.0
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = rows.withColumns({"h1": F.xxhash64(plain), "h2": F.xxhash64(F.lit(7), plain)})
    same = written(rows.groupBy("h1", "h2").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1"))
    tagged = rows.join(_small(same, same.count()), ["h1", "h2"], "left")
    tagged = tagged.select("rid", "vec_id", "v", F.coalesce("first", "rid").alias("node"), F.coalesce("n", F.lit(1).cast("long")).alias("copies"))

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        q = packed(unit(b.column(1).to_pylist())) if b.num_rows else np.zeros((0, d), np.int16)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in q], pa.binary())], names=["node", "v", "copies", "q"])

    # by its greatest component, so that no square overflows
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / F.col("__top")).alias("v")
    alone = tagged.where("rid = node").withColumn("__top", top).select("node", scaled, "copies")
    nodes = written(alone.mapInArrow(in_slices(pack), "node long, v array<double>, copies long, q binary"))
    size = min(8 * sample_rows, max(sample_rows, n // 1000))
    sample = nodes.select("node", "v").orderBy(F.xxhash64("v"), "node").limit(size).toPandas()  # bounded
    xs = unit(sample["v"].tolist()) if len(sample) else np.zeros((0, d))
    n_nodes = nodes.count()
    member, reps = _balls(nodes, fit(xs, depth_for(n_nodes, _CELL), seed=1))
    deep = depth_for(reps.count(), _LEAF)
    wrong = error(d)
    pairs = _near_pairs(reps, [fit(xs, deep, seed=100 + k) for k in range(trees or trees_for(deep))], least, wrong)
    member = written(member.join(nodes.select("node", "copies"), "node"))
    info = written(member.groupBy("ball").agg(F.sum("copies").alias("size")).join(reps.select("ball", "radius"), "ball"))
    known = pairs.join(info.withColumnsRenamed({"ball": "p", "size": "size_p", "radius": "r_p"}), "p").join(info.withColumnsRenamed({"ball": "q", "size": "size_q", "radius": "r_q"}), "q")
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.col("cosine") - F.lit(wrong), F.lit(1.0)))) + F.col("r_p") + F.col("r_q")
    known = written(known.withColumn("sure", apart <= F.lit(float(angle(least)))), pairs)
    # member by member, in double precision, where error and radii leave it open
    open_ = known.where("not sure").select("p", "q")
    one = member.join(nodes.select("node", "v"), "node").select(F.col("ball").alias("p"), F.col("node").alias("x"), F.col("v").alias("vx"), F.col("copies").alias("cx"))
    two = one.withColumnsRenamed({"p": "q", "x": "y", "vx": "vy", "cx": "cy"})
    cosine = _dot("vx", "vy") / (F.sqrt(_dot("vx", "vx")) * F.sqrt(_dot("vy", "vy")))
    exact = written(open_.join(one, "p").join(two, "q").where(cosine >= least).select("p", "q", "x", "y", "cx", "cy"))
    links = known.where("sure").select(F.col("p").alias("u"), F.col("q").alias("v")).unionByName(exact.select(F.col("p").alias("u"), F.col("q").alias("v")))
    joined = components(links)
    whole = known.where("sure")
    by_ball = whole.select(F.col("p").alias("ball"), F.col("size_q").alias("n")).unionAll(whole.select(F.col("q").alias("ball"), F.col("size_p").alias("n")))
    by_ball = by_ball.groupBy("ball").agg(F.sum("n").alias("outer"))
    by_node = exact.select(F.col("x").alias("node"), F.col("cy").alias("n")).unionAll(exact.select(F.col("y").alias("node"), F.col("cx").alias("n"))).groupBy("node").agg(F.sum("n").alias("own"))
    per = info.join(by_ball, "ball", "left").join(joined.withColumnRenamed("id", "ball"), "ball", "left")
    per = written(per.select("ball", (F.col("size") - 1 + F.coalesce("outer", F.lit(0))).alias("common"), F.coalesce("component", "ball").alias("component")))
    of_node = member.select("node", "ball").join(per, "ball").join(by_node, "node", "left")
    of_node = written(of_node.select("node", (F.col("common") + F.coalesce("own", F.lit(0))).cast("long").alias("n_links"), "component"))
    return written(tagged.select("rid", "vec_id", "node").join(of_node, "node").select("rid", "vec_id", "n_links", "component"), known, exact, per)
