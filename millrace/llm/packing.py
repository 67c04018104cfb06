"""Best-fit packing with large-item matching.

Token sequences of at most ``capacity`` tokens are packed from whole documents; only
longer documents are cut.  The steps:

1. Each document is encoded once (Arrow batches) and leaves rows (doc_id, piece, start,
   length, crc32); texts and ids move no further.
2. Lengths are at most ``capacity``, so their histogram has at most that many rows, at any
   scale.  The packing of the *whole* corpus is planned on it, in bulk: items above a third
   of the capacity go at most two to a bin, so they are matched greedily (each, from the
   largest, with the largest partner that fits); smaller ones, from the largest, go into
   the smallest gap that holds them (best fit decreasing).  A plan step says: these ranks
   of this length, so many to a bin, from this bin on, at this offset.
3. Items get their rank among those of their length, in buckets that grow in number with
   the table, so that a length that a third of the rows share is no hot key.  A rank and a
   length give sequence and offset by binary search in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.common import in_slices, written
from millrace.llm.tokens import worker_encoder

_BUCKET_ROWS = 100_000


@dataclass(frozen=True)
class Step:
    """Ranks first .. first + count - 1 of ``length``: ``per_bin`` to a bin, from ``bin`` on, at ``offset``."""

    length: int
    first: int
    count: int
    per_bin: int
    bin: int
    offset: int


class _Bins:
    """Open bins as runs of equal gap."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self._gaps: list[int] = []
        self._runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def open(self, n: int) -> int:
        self.count += n
        return self.count - n

    def put(self, gap: int, start: int, n: int) -> None:
        if gap > 0 and n > 0:
            if not self._runs[gap]:
                bisect.insort(self._gaps, gap)
            self._runs[gap].append((start, n))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """A run of the smallest gap that holds ``length``."""
        i = bisect.bisect_left(self._gaps, length)
        if i == len(self._gaps):
            return None
        gap = self._gaps[i]
        start, n = self._runs[gap].pop()
        if not self._runs[gap]:
            del self._gaps[i]
        return gap, start, n


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Step], int]:
    """The steps that pack ``histogram`` (length -> items), and the number of bins."""
    left = {k: int(n) for k, n in histogram.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    steps: list[Step] = []
    bins = _Bins(capacity)

    def put(length: int, count: int, per_bin: int, at: int, offset: int) -> None:
        steps.append(Step(length, used[length], count, per_bin, at, offset))
        used[length] += count
        left[length] -= count

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        while left[a]:
            top = min(a, capacity - a)
            i = bisect.bisect_right(large, top) - 1
            while i >= 0 and left[large[i]] < (2 if large[i] == a else 1):
                i -= 1
            if i < 0:
                n = left[a]
                at = bins.open(n)
                put(a, n, 1, at, 0)
                bins.put(capacity - a, at, n)
                continue
            b = large[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            at = bins.open(n)
            put(a, n, 1, at, 0)
            put(b, n, 1, at, a)
            bins.put(capacity - a - b, at, n)
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            run = bins.take(s)
            if run is None:
                n = -(-left[s] // (capacity // s))
                run = capacity, bins.open(n), n
            gap, at, n = run
            k = gap // s
            whole = min(n, left[s] // k)
            if whole:
                put(s, whole * k, k, at, capacity - gap)
                bins.put(gap - k * s, at, whole)
            rest = min(left[s], k - 1) if whole < n else 0
            if rest:
                put(s, rest, rest, at + whole, capacity - gap)
                bins.put(gap - rest * s, at + whole, 1)
            bins.put(gap, at + whole + bool(rest), n - whole - bool(rest))
    return steps, bins.count


def encoded(docs: DataFrame, capacity: int, tokenizer: tuple, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as ids with a 0 after, cut where longer than ``capacity``.

    All pieces of a cut document but the first have ``capacity`` ids.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = worker_encoder(*tokenizer)
        out: list[tuple] = []
        for doc_id, text_ in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(enc.ids(text_.as_py() or ""), np.uint32(0)).astype("<u4")
            first = (len(ids) - 1) % capacity + 1
            start = 0
            for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                out.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                start = end
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _PIECE.types)] if out else [pa.array([], t) for t in _PIECE.types], schema=_PIECE)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        in_slices(cut), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with length, doc_id, piece, ids_crc32) with sequence_id and offset."""
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    steps, _ = plan(histogram, capacity)
    steps.sort(key=lambda s: (s.length, s.first))
    starts = np.array([s.length << 44 | s.first for s in steps], np.int64)
    first, per, bin_, offset = (np.array([getattr(s, k) for s in steps], np.int64) for k in ("first", "per_bin", "bin", "offset"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(starts, n << 44 | r, side="right") - 1
        k = r - first[i]
        return pd.DataFrame({"sequence_id": bin_[i] + k // per[i], "offset": offset[i] + k % per[i] * n})

    buckets = max(64, sum(histogram.values()) // _BUCKET_ROWS)
    rows = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    inside = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "__bucket").count().withColumn("__base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = rows.withColumn("__rank", F.row_number().over(inside) - 1).join(base, ["length", "__bucket"])
    placed = ranked.withColumn("__at", look_up(F.col("length"), F.col("__rank") + F.col("__base")))
    return placed.select(*pieces.columns, "__at.sequence_id", "__at.offset")


def pack(docs: DataFrame, tokenizer: tuple, capacity: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one id (the closing 0).  Long texts are encoded whole and cut.
    Rows that tie in id and piece, repeated rows among them, are packed each, in any order.
    Null ids are packed as others.  Other columns are not read.  An empty table gives no rows.
    """
    return place(written(encoded(docs, capacity, tokenizer, text, key)), capacity)


def public_tokenizer() -> tuple:
    """The default vocabulary's files: (json, ranks, pattern)."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN
