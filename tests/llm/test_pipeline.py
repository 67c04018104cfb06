"""The pipeline's stages on a small table, each held against what it promises."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from millrace.llm.common import written

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DIR)))
    return out


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_duplicates", "near_duplicates", "source_mixing", "best_fit_packing"]
    assert all(sorted(d.columns) == sorted(stages[0].columns) for d in stages[1:-1])


def test_stages(stages):
    rows = [{r["doc_id"]: r for r in d.collect()} for d in stages[:4]]
    assert set(rows[3]) <= set(rows[2]) <= set(rows[1]) < set(rows[0])
    normal = defaultdict(list)
    for r in rows[1].values():
        normal["".join((r["text"] or "").split())].append(r)
    assert {min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"]))["doc_id"] for g in normal.values()} == set(rows[2])
    bags = {i: bag(r["text"]) for i, r in rows[2].items()}
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and (both := sum((bags[a] & bags[b]).values())) and both / sum((bags[a] | bags[b]).values()) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {root(i) for i in bags} == set(rows[3])


def test_mix_and_packing(stages):
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    before, after = stages[3].collect(), stages[4].collect()
    copies = Counter(r["doc_id"] for r in after)
    assert max(copies.values()) <= 2 and words(after) == pytest.approx(1.5 * words(before), rel=0.1)
    packed = stages[5].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
