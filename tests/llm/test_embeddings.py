"""Embedding near-dedup against all pairs: small leaves, overfull cells, hot copies, odd vectors."""

import numpy as np
import pytest

from millrace.llm import embedding_dedup


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    for i in range(60):
        x[i] = x[i % 3] + rng.standard_normal(16) * 0.02
    for i in range(60, 120):
        x[i] = x[200 + i % 20] + rng.standard_normal(16) * 0.18
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), sample_rows=64).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    links = sum(got[i]["n_links"] for i in range(300))
    assert all(got[i]["n_links"] <= s[i].sum() for i in range(300)) and links >= 0.97 * s.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904))


def test_embedding_dedup_of_several_lengths(spark):
    rows = [(i, [1.0, float(i // 2) * 9, 0.5]) for i in range(6)] + [(10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [-1.0, 2.0]), (13, [1.0]), (14, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False) and got[0] == (1, 0, True) and got[1] == (1, 0, False)
    assert len(got) == 11 and all(got[i] == (0, i, True) for i in (12, 13, 14))


def brute(rows, least=0.95):
    """(n_links, component) by row, in double precision."""
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() if g else None for (_, v), g in zip(rows, good)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    ids = {}
    for i in range(n):
        ids.setdefault(root(i), []).append(rows[i][0])
    return [(rows[i][0], links[i], min(x for x in ids[root(i)] if x is not None)) for i in range(n)]


def clusters(rng, d=24):
    rows = []
    for k in range(40):
        centre = rng.standard_normal(d)
        for _ in range(int(rng.integers(1, 12))):
            rows.append(centre + rng.standard_normal(d) * rng.choice([0.0, 0.02, 0.15, 0.22]) * np.linalg.norm(centre) / np.sqrt(d))
    hot = rng.standard_normal(d)
    rows += [hot.copy() for _ in range(120)] + [hot * 3.0] * 5 + [hot + rng.standard_normal(d) * 0.03 for _ in range(90)]
    return [(i, v.tolist()) for i, v in enumerate(rows)]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(embedding_dedup, "_CELL", 24)
        monkeypatch.setattr(embedding_dedup, "_BLOCK", 6)
        monkeypatch.setattr(embedding_dedup, "_LEAF", 2)
        monkeypatch.setattr(embedding_dedup, "_SEND_ROWS", 0)
    rows = clusters(np.random.default_rng(5))
    rows += [(9000, [1e200, 1e200]), (9001, [1e200, 1.1e200]), (9002, [1e-300, 1e-300]), (9003, [float("inf"), 1.0]), (9004, None), (9005, [0.0, 0.0]), (9005, [0.0, 0.0]), (9006, [None, 1.0])]
    rows += [rows[0], rows[0]]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, node string, ball int").repartition(3)
    got = embedding_dedup.near_dedup(table, sample_rows=64).collect()
    want = brute(rows)
    assert len(got) == len(want)
    found, true = sum(r["n_links"] for r in got), sum(w[1] for w in want)
    assert (0.9 if small else 0.97) * true <= found <= true
    by = {}
    for i, n, c in want:
        by.setdefault(i, []).append((n, c))
    assert all(r["n_links"] <= max(n for n, _ in by[r["vec_id"]]) for r in got)
    assert np.mean([r["component_id"] == by[r["vec_id"]][0][1] for r in got]) > 0.97
    assert {r["vec_id"]: r["n_links"] for r in got if r["vec_id"] in (9000, 9001, 9002)} == {9000: 2, 9001: 2, 9002: 2}


def test_error_of_packed_rows():
    rng = np.random.default_rng(1)
    x = embedding_dedup.unit(rng.standard_normal((300, 64)))
    q = embedding_dedup.packed(x).astype(float) / 32767
    assert np.abs(q @ q.T - x @ x.T).max() < embedding_dedup.error(64)


def test_deep_trees_find_near_pairs():
    """Pairs at the threshold share a leaf of trees deeper than ten levels."""
    rng = np.random.default_rng(2)
    base = embedding_dedup.unit(rng.standard_normal((4000, 32)))
    side = embedding_dedup.unit(rng.standard_normal((4000, 32)))
    side = embedding_dedup.unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    near = 0.952 * base + np.sqrt(1 - 0.952**2) * side
    depth = 12
    hit = np.zeros(len(base), bool)
    for k in range(embedding_dedup.trees_for(depth)):
        tree = embedding_dedup.fit(base, depth, seed=100 + k)
        row_a, cell_a = tree.cells(base, True)
        row_b, cell_b = tree.cells(near, True)
        hit[np.array([r for r in {*zip(row_a.tolist(), cell_a.tolist())} & {*zip(row_b.tolist(), cell_b.tolist())}], np.int64).reshape(-1, 2)[:, 0]] = True
    assert hit.mean() > 0.95
