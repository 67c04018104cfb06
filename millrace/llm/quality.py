"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are made from the whole text in Arrow batches.  The forest learns from at most
``max_labelled`` labelled documents, those with the least hash of their id, so the sample
is the same at every run; its ids are broadcast (a documented bound), its statistics are
what comes to the driver.  Scoring walks flat arrays batch by batch.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.boosting import Forest, boost
from millrace.llm.common import release

MAX_LABELLED = 12_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True  # lead bytes stand for letters beyond ASCII
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True
_MARK = ~(_LETTER | _DIGIT | _SPACE | _INNER)
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"-"]] = True
_ODD = _MARK & ~_PLAIN
_CLASSES = np.array([_LETTER, _UPPER, _DIGIT, _SPACE, _MARK, _ODD], float).T

STATISTICS = (
    "log_words", "word_length", "longest_word", "letters", "upper", "digits", "spaces", "marks", "odd_marks", "common_mark",
    "distinct_words", "top_word", "same_as_previous", "distinct_pairs", "log_lines", "distinct_lines", "words_per_line", "sentence_ends", "entropy", "halves",
)


def statistics(text: str) -> list[float]:
    """The values named in STATISTICS; an empty text has zeros."""
    raw = text.encode()
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, n_words = len(raw), len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, upper, digits, spaces, marks, odd = (hist @ _CLASSES / n).tolist()
    share = hist[hist > 0] / n
    counts = Counter(words)
    same = sum(map(eq, words, islice(words, 1, None)))
    pairs = len(set(zip(words, islice(words, 1, None))))
    lines = text.split("\n")
    ends = text.count(".") + text.count("?") + text.count("!")
    a, b = set(words[: n_words // 2]), set(words[n_words // 2 :])
    return [
        math.log1p(n_words), (len(text) - n_words) / n_words, max(map(len, counts)), letters, upper, digits, spaces, marks, odd, int(hist[_MARK].max()) / n,
        len(counts) / n_words, max(counts.values()) / n_words, same / n_words, pairs / max(1, n_words - 1), math.log1p(len(lines)), len(set(lines)) / len(lines),
        n_words / len(lines), ends / n_words, float(-(share @ np.log2(share))), len(a & b) / max(1, min(len(a), len(b))),
    ]


def table_of(texts) -> np.ndarray:
    rows = [statistics(t or "") for t in texts]
    return np.array(rows, float).reshape(-1, len(STATISTICS))


def held_out(key: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 modulo 3.  Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", max_labelled: int = MAX_LABELLED, **options) -> Forest:
    """A forest for P(label = 1).

    Labels that are null are ignored, as are ids without a document; contradicting labels
    of one id go by their mean.  Of documents that share an id, the one with the least
    statistics counts, so at most ``max_labelled`` rows come to the driver.  Without labels
    the score is 0.5 everywhere.
    """
    ids = (
        labels.select(F.col(key).cast("long").alias("__id"), F.col(label).alias("__y")).where("__y is not null and __id is not null").where(~held_out(F.col("__id")))
        .groupBy("__id").agg((F.avg("__y") >= 0.5).cast("double").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    )
    # at most max_labelled rows of 16 bytes
    chosen = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text")).join(F.broadcast(ids), "__id")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["__id"], "y": b["__y"], "x": list(table_of(b["__text"]))})
        release()

    rows = chosen.mapInPandas(measure, "id long, y double, x array<double>").groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x"))
    got = rows.toPandas().sort_values("id", kind="stable")
    got = got.assign(x=[np.asarray(v, float) for v in got["x"]])
    x = np.array(got["x"].to_list()).reshape(-1, len(STATISTICS))
    order = np.lexsort((*x.T, got["id"].to_numpy())) if len(got) else np.zeros(0, int)
    return boost(x[order], got["y"].to_numpy(float)[order], **options)


def score(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """``docs`` with double __score, every whole text; null counts as empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(forest.probability(table_of(texts)))
        release()

    return docs.withColumn("__score", scored(F.coalesce(F.col(text), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Null and empty texts score as a text of no words; long texts are read whole.  Repeated
    rows, and rows that tie in id, get a row each, equal texts equal scores.  A score of exactly
    0.5 predicts 1.  Null ids are never held out nor learnt from.  An empty table gives no
    rows; extra columns are not read, whatever their names.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = score(slim, train(docs, labels, text=text, key=key, **options))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, a tie included; all columns as they were.

    Null and empty texts go or stay by their score, as do repeated rows, each by its own text.
    Without labels all score 0.5.  An empty table gives an empty one.
    """
    forest = train(docs, labels, text=text, key=key, **options)
    return score(docs, forest, text).where(F.col("__score") >= threshold).drop("__score")
