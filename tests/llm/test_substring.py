"""Substring dedup against all repeated passages found by brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import substring_dedup


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def spans(spark, rows, **options):
    got = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string, start int, digest long").repartition(3), **options).collect()
    assert all(r["stays"] == (r["doc_id"] == r["first_doc_id"]) for r in got)
    return got


def left(rows, got):
    """Each document's text in pieces, without the spans that go."""
    out = {}
    for i, t in rows:
        at, pieces = 0, []
        for start, end in sorted((r["start"], r["end"]) for r in got if r["doc_id"] == i and not r["stays"]):
            pieces.append((t or "")[at:start])
            at = end
        out[i] = [*pieces, (t or "")[at:]]
    return out


def passages(rows, least):
    """(doc, start, end) in characters of all maximal runs of words that another document holds too."""
    texts = {i: t.split(" ") for i, t in rows if t}
    where = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    found = []
    for i, w in texts.items():
        at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in w])))
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                found.append((i, int(at[k]), int(at[k + least]) - 1))
    return found


def test_against_all_repeated_passages(spark):
    rng = random.Random(9)
    bits = [prose(rng, n) for n in (55, 80, 200, 30, 30, 60)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(20, 120)) if rng.random() < 0.6 else rng.choice(bits) for _ in range(rng.randint(1, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "short"), (103, rows[4][1]), (103, rows[4][1])]
    got = spans(spark, [(*r, 0, 0) for r in rows])
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["start"], r["end"]))
    for i, start, end in passages(rows, 51):
        middle = (start + end) // 2
        assert any(a <= middle < b for a, b in by[i]), (i, start, end)
    true = defaultdict(list)
    for i, start, end in passages(rows, 25):
        true[i].append((start, end))
    texts = dict(rows)
    for i, found in by.items():
        for a, b in found:  # what is found does repeat, but for a word that a chunk cuts
            inner = texts[i][a:b]
            assert sum(inner in t for k, t in rows if t and k != i), (i, a, b)
    assert {i for i in by} <= {i for i in true}


def test_what_goes_stays_elsewhere(spark):
    rng = random.Random(10)
    a, b, c = prose(rng, 70), prose(rng, 70), prose(rng, 70)
    rows = [(3, f"{a} {b}"), (5, f"{a} {b} {c}"), (9, f"{b} {c}"), (11, f"{c} {a}"), (12, f"{prose(rng, 40)} {a} {prose(rng, 40)} {b}")]
    got = spans(spark, [(*r, 0, 0) for r in rows])
    pieces = [p for x in left(rows, got).values() for p in x]
    for passage in (a, b, c):
        assert any(passage[80:-80] in p for p in pieces)
    chunk = substring_dedup.chunk_lists(pa.array([t for _, t in rows]), 20, 512).to_pylist()
    for (i, t), list_ in zip(rows, chunk):
        for x in list_:
            assert any(t[x["start"] : x["start"] + x["length"]] in p for p in pieces)
    assert sum(map(len, pieces)) < 0.62 * sum(len(t) for _, t in rows)


def test_first_documents(spark):
    rng = random.Random(11)
    passage = prose(rng, 80)
    rows = [(i, prose(rng, 150) + " " + (passage if i < 4 else "") + " " + prose(rng, 100)) for i in range(12)]
    rows += [(None, prose(rng, 30)), (23, "日本" * 2000), (24, "日本" * 2000), (None, prose(rng, 90) + " " + passage)]
    got = spans(spark, [(*r, 0, 0) for r in rows])
    assert {r["doc_id"] for r in got if r["doc_id"] != 23 and r["doc_id"] != 24} == {None, 0, 1, 2, 3}
    assert all(r["first_doc_id"] is None for r in got if r["doc_id"] in (0, 1, 2, 3))
    for r in got:
        if r["doc_id"] in range(4):
            assert rows[r["doc_id"]][1][r["start"] : r["end"]].strip() in passage and r["n_words"] > 40


@pytest.mark.parametrize("words", [51, 60, 80])
def test_repetitive_passages(spark, words):
    """Passages of a few words again and again, at other places in other texts."""
    rng = random.Random(words)
    rows, want = [], []
    for k in range(40):
        few = prose(rng, rng.choice([1, 2, 5, 9, 20])).split()
        passage = " ".join(few[i % len(few)] for i in range(words))
        for half in (0, 1):
            rows.append((2 * k + half, prose(rng, rng.randint(30, 90)) + " " + passage + " " + prose(rng, 40)))
        if len(passage) >= 200:
            want += [2 * k, 2 * k + 1]
    found = {r["doc_id"] for r in spans(spark, [(*r, 0, 0) for r in rows])}
    assert len(want) > 20 and len(set(want) - found) <= 0.05 * len(want)


def test_empty_table_and_bad_option(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.repeated_spans(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeated_spans(none, longest=5000)
