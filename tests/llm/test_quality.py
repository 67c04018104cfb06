"""Boosted trees against naive ones, held-out accuracy, and odd rows."""

import zlib

import duckdb
import numpy as np
import pytest

from millrace.llm import boosting, quality

DIR = "/root/testdata/sf0.01"


def naive_raw(forest, row):
    total = forest.base
    for root in forest.roots:
        at = int(root)
        while forest.feature[at] >= 0:
            at = int(forest.left[at]) + int(row[forest.feature[at]] > forest.threshold[at])
        total += forest.value[at]
    return total


def naive_tree(x, grad, hess, depth, shrink, l2, least, borders):
    """Values on the rows of a tree whose every split is the best of all, by trying each."""
    out = np.zeros(len(x))

    def grow(rows, level):
        g, h = grad[rows].sum(), hess[rows].sum()
        best, pick = 1e-9, None
        if level < depth and len(rows) >= 2 * least:
            for f in range(x.shape[1]):
                for b in borders[f]:
                    low = x[rows, f] <= b
                    if least <= low.sum() <= len(rows) - least:
                        gl, hl = grad[rows[low]].sum(), hess[rows[low]].sum()
                        gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                        if gain > best + 1e-12:
                            best, pick = gain, (f, b)
        if pick is None:
            out[rows] = -shrink * g / (h + l2)
            return
        low = x[rows, pick[0]] <= pick[1]
        grow(rows[low], level + 1)
        grow(rows[~low], level + 1)

    grow(np.arange(len(x)), 0)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_boosting_against_naive_trees(seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((160, 4)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.standard_normal(160) * 0.3 > 0).astype(float)
    forest = boosting.boost(x, y, trees=6, depth=3, bins=16)
    p = (y.sum() + 1) / (len(y) + 2)
    raw = np.full(len(y), np.log(p / (1 - p)))
    borders = boosting.edges(x, 16)
    for _ in range(6):
        prob = 1 / (1 + np.exp(-raw))
        raw += naive_tree(x, prob - y, prob * (1 - prob), 3, 0.15, 1.0, 8, borders)
    assert np.allclose(forest.raw(x), raw, atol=1e-9)
    assert np.allclose(forest.raw(x), [naive_raw(forest, r) for r in x])


def test_held_out_accuracy(spark):
    got = quality.classify(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")).toPandas()
    labels = duckdb.sql(f"select doc_id, quality from '{DIR}/labels.parquet' where quality is not null").df()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert len(held) > 50 and (held["predicted"] == held["quality"]).mean() > 0.97
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got["doc_id"], got["held_out"]))


def test_odd_rows(spark):
    rows = [(1, "a b", 0.1), (1, "a b", 0.1), (1, "c", 0.2), (None, None, 0.3), (2, "", 0.4), (3, "word " * 300_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 0), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns and quality.keep_good(docs, labels.limit(0)).count() == 6
    forest = quality.train(docs, labels, max_labelled=2)
    assert np.isfinite(forest.base)
