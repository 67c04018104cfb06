"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut where a rolling hash of its last 16 bytes is small, so cuts depend on content
only and an insertion shifts nothing beyond its neighbourhood.  A stretch that has no such cut
(one word again and again, a table's rule) is cut where the hash is least among its
neighbours, which depends on content too.  Chunks have about 27 bytes.

Two chunks that adjoin are a *window*, known by one digest.  A window that stands in two
documents or more is repeated; windows one after the other make a passage.  Of a passage's
chunks, each belongs to the least document that holds the window it begins (the last chunk: the
window it ends); those next to each other that belong to one document are one span, and a
span stays where that is its own document.  So a chunk that goes from one document stays in
another.

A passage begins and ends with a chunk, up to some ten words inside the text that repeats.
Whether it may have ``least_words`` is therefore asked of the passage with the chunk before
and the chunk after it.  Cuts right at its ends may differ still (the hash looks back 16
bytes), so passages of over 50 words are asked for 45.

All byte work is vector operations.  Digests meet in one aggregation with map-side combine;
those that repeat are written and make a bounded bitmap, so that only windows which may repeat
move on with their places.  The join with the digests is of two plain shuffles, so that
adaptive execution splits its hot ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.bitmap import bitmap, filter_bits, slot, tested
from millrace.llm.common import in_slices, written
from millrace.llm.textbytes import BYTE, SPACE, U64, blocks, mix, span_hashes

_WINDOW = 16
_GAP = 8  # of two cuts nearer than this, the later is none
_BARE = 64  # bytes without a cut, from which the least hashes cut
_NEAR = 16  # bytes on either side among which a hash is least
_THIN = 16  # those cuts are no nearer than this
_GEAR = (BYTE >> np.uint64(32)).astype(np.uint32)
_FIRST = -(2**63)  # stands for a null id
_MOST_BITS = 1 << 29  # of the bitmap, 64 MB; beyond 10 ** 8 repeated digests more windows move, and the join stays exact


def gear(data: np.ndarray) -> np.ndarray:
    """sum(G[byte i places back] << i) over 16 bytes, at each byte, by doubling."""
    h = _GEAR[data]
    for k in range(4):
        step = 1 << k
        moved = np.zeros_like(h)
        moved[step:] = h[:-step] << np.uint32(step)
        h = h + moved
    return h


def _least(h: np.ndarray, lead: np.ndarray, start: int, end: int) -> np.ndarray:
    """Cuts between ``start`` and ``end`` after bytes whose hash is least within ``_NEAR`` bytes."""
    part = h[start:end]
    around = np.pad(part, _NEAR, constant_values=np.uint32(0xFFFFFFFF))
    low = np.lib.stride_tricks.sliding_window_view(around, 2 * _NEAR + 1).min(axis=1)
    low[: min(_WINDOW, len(low))] = 0  # the hash there takes in what is before
    at = np.flatnonzero(part == low) + start + 1
    at = at[(at < end) & lead[np.minimum(at, len(lead) - 1)]]
    if not len(at):
        return at
    # of a run of close ones, the first and then one in every _THIN bytes
    first = np.concatenate(([True], np.diff(at) >= _THIN))
    since = (at - at[first][np.cumsum(first) - 1]) // _THIN
    return at[first | np.concatenate(([True], np.diff(since) > 0))]


def cuts(data: np.ndarray, offsets: np.ndarray, mean: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of all chunks.  Cuts are between characters, and at least 16 bytes after a row's start."""
    row_starts = offsets[:-1][np.diff(offsets) > 0]
    lead = (data & 0xC0) != 0x80
    h = gear(data)
    at = np.flatnonzero((h[:-1] < np.uint32((1 << 32) // mean)) & lead[1:]) + 1 if len(data) else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at - offsets[row] >= _WINDOW
    at, row = at[inside], row[inside]
    far = np.ones(len(at), bool)
    far[1:] = (np.diff(at) >= _GAP) | (row[1:] != row[:-1])
    starts = np.sort(np.concatenate((row_starts, at[far])))
    for limit in (_BARE, longest):
        ends = np.append(starts[1:], len(data))
        wide = ends - starts > limit
        if not wide.any():
            break
        if limit == _BARE:
            extra = np.concatenate([_least(h, lead, s, e) for s, e in zip(starts[wide], ends[wide])])
        else:  # still without cuts: every ``longest`` bytes, back to a character's first byte
            extra = np.concatenate([np.arange(s + longest, e, longest) for s, e in zip(starts[wide], ends[wide])])
            for _ in range(3):
                extra = np.where(lead[extra], extra, extra - 1)
        starts = np.unique(np.concatenate((starts, extra)))
    return np.searchsorted(offsets, starts, side="right") - 1, starts


_CHUNK = pa.struct([("start", pa.int32()), ("length", pa.int16()), ("words", pa.int16()), ("digest", pa.int64())])


def chunk_lists(column: pa.Array, mean: int, longest: int) -> pa.Array:
    """The chunks of each text; start and length in characters.

    The digest is of the window that the chunk begins; of a row's last chunk, which begins
    none, it is 0.
    """
    parts = []
    for first, end, data, offsets in blocks(column):
        row, start = cuts(data, offsets, mean, longest)
        stop = np.append(start[1:], len(data)) if len(start) else start
        stop = np.minimum(stop, offsets[row + 1])
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        space = SPACE[data] if len(data) else np.zeros(0, bool)
        begins = ~space
        begins[1:] &= space[:-1]
        word = np.concatenate(([0], np.cumsum(begins)))
        own = span_hashes(data, start, stop)
        pair = np.zeros(len(own), U64)
        if len(own):
            pair[:-1] = np.where(row[1:] == row[:-1], mix(own[:-1] + mix(own[1:])) | U64(1), U64(0))
        fields = [
            pa.array((chars[start] - chars[offsets[row]]).astype(np.int32)), pa.array((chars[stop] - chars[start]).astype(np.int16)),
            pa.array((word[stop] - word[start]).astype(np.int16)), pa.array(pair.astype(np.int64)),
        ]
        ends = np.cumsum(np.bincount(row, minlength=end - first))
        parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_CHUNK))))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_CHUNK))


def chunks(docs: DataFrame, mean: int = 20, longest: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, chunks array<struct<start, length, words, digest>>) by row."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), chunk_lists(b.column(1), mean, longest)], names=["doc", "chunks"])

    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)).alias("doc"), F.col(text).alias("text")).mapInArrow(
        in_slices(make), "doc long, chunks array<struct<start: int, length: smallint, words: smallint, digest: long>>"
    )


def _windows(base: DataFrame) -> DataFrame:
    """(rid, digest, place, words): a row for each window.

    place: start << 20 | length of the first chunk << 10 | length of the second; words: four
    counts of words of ten, ten, five and five bits: first, second, before and after (31 at most).
    """

    def of(c, i):
        def word(k):
            return F.coalesce(F.get("chunks", i + k)["words"].cast("int"), F.lit(0))

        after = F.get("chunks", i + 1)
        place = F.shiftleft(c["start"].cast("long"), 20) + F.shiftleft(c["length"].cast("long"), 10) + after["length"].cast("long")
        words = F.shiftleft(word(0), 20) + F.shiftleft(word(1), 10) + F.shiftleft(F.least(word(-1), F.lit(31)), 5) + F.least(word(2), F.lit(31))
        return F.struct(c["digest"].alias("digest"), place.alias("place"), words.alias("words"))

    return base.select("rid", F.explode(F.filter(F.transform("chunks", of), lambda w: w["place"].isNotNull())).alias("w")).select("rid", "w.digest", "w.place", "w.words")


def repeated_spans(docs: DataFrame, least_words: int = 45, mean: int = 20, longest: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per repeated span: doc_id, start, end (characters), n_words, first_doc_id, stays.

    A passage is reported that, with the chunks before and after it (31 words at most of
    each), has ``least_words`` or more.  first_doc_id is the least id of the documents that hold
    each of the span's windows; a span stays where that is its own document.  Rows that share
    an id are one document; null ids are one document too, before all others.  Null, empty
    and short texts have no spans.  Repeats within one document alone are none.  Other
    columns are not read.  An empty table gives no rows.
    """
    if longest > 1000:
        raise ValueError("longest is at most 1000")
    base = written(chunks(docs, mean, longest, text, key).withColumn("rid", F.monotonically_increasing_id()))
    once = base.select("doc", F.explode(F.array_distinct(F.transform("chunks", lambda c: c["digest"]))).alias("digest")).where("digest <> 0")
    shared = once.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    shared = written(shared.select("digest", "first"))
    # packed until they have moved
    bits = filter_bits(shared.count(), 8, _MOST_BITS)
    seen = written(bitmap(shared.select(slot(F.col("digest"), bits).alias("slot")), bits))
    likely = tested(_windows(base), F.col("digest"), seen, bits).where("maybe").drop("maybe")
    moved = likely.join(shared, "digest").select("rid", "first", "place", "words").repartition("rid")
    hits = moved.select(
        "rid", "first", F.shiftright("place", 20).alias("start"), (F.shiftright("place", 10).bitwiseAND(1023)).alias("one"), F.col("place").bitwiseAND(1023).alias("two"),
        F.shiftright("words", 20).alias("words_one"), F.shiftright("words", 10).bitwiseAND(1023).alias("words_two"), F.shiftright("words", 5).bitwiseAND(31).alias("before"), F.col("words").bitwiseAND(31).alias("after"),
    )
    order = Window.partitionBy("rid").orderBy("start")
    adjoins = F.lag(F.col("start") + F.col("one")).over(order).eqNullSafe(F.col("start"))
    same = adjoins & F.lag("first").over(order).eqNullSafe(F.col("first"))
    last = ~F.lead("start").over(order).eqNullSafe(F.col("start") + F.col("one"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumns({"fresh_run": F.when(adjoins, 0).otherwise(1), "fresh_part": F.when(same, 0).otherwise(1), "last": last})
    rows = rows.withColumns({"run": F.sum("fresh_run").over(so_far), "part": F.sum("fresh_part").over(so_far)})
    # the second chunk of a passage's last window ends it
    rows = rows.withColumn("n", F.col("words_one") + F.when(F.col("last"), F.col("words_two")).otherwise(0)).withColumn(
        "around", F.when(F.col("fresh_run") == 1, F.col("before")).otherwise(0) + F.when(F.col("last"), F.col("after")).otherwise(0)
    )
    spans = rows.groupBy("rid", "run", "part").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("one") + F.when(F.col("last"), F.col("two")).otherwise(0)).alias("end"),
        F.sum("n").alias("n_words"), F.sum("around").alias("around"), F.min("first").alias("first"),
    )
    whole = F.sum(F.col("n_words") + F.col("around")).over(Window.partitionBy("rid", "run"))
    spans = spans.withColumn("whole", whole).where(F.col("whole") >= least_words)
    spans = spans.join(base.select("rid", "doc"), "rid")

    def shown(c: str):
        return F.when(F.col(c) > _FIRST, F.col(c))

    return spans.select(
        shown("doc").alias("doc_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "n_words", shown("first").alias("first_doc_id"), (F.col("first") == F.col("doc")).alias("stays")
    )
