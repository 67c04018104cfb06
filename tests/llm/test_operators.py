"""Each operator against a brute-force version, with nulls, empties, repeats and odd columns."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bagminhash, embedding_dedup, exact_dedup, html_text, mixing, near_dedup, packing, quality, substring_dedup, textbytes, token_counts, warc
from millrace.llm.components import components
from millrace.llm.tokens import ByteBpe

ROWS = "doc_id long, text string, source string, id long, rid int, sha string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        rows.append((i, sentence(rng, rng.choice([3, 60, 200])), rng.choice(["a", "b", None]), 1, 2, "x"))
    base = sentence(rng, 120)
    for i in range(40, 46):
        w = base.split()
        w[rng.randrange(120)] = "changed"
        rows.append((i, " ".join(w), "a", 1, 2, "x"))
    rows += [(46, base, "b", 0, 0, ""), (47, "\n" + base + "  ", "b", 0, 0, ""), (48, None, None, None, None, None), (49, "", "a", 0, 0, ""), (50, " \t\n", "c", 0, 0, "")]
    rows += [(None, base, "a", 0, 0, ""), (46, base, "b", 0, 0, ""), (51, "é 日本 😀 " * 500, "c", 0, 0, ""), (52, sentence(rng, 4000), "a", 0, 0, "")]
    return spark.createDataFrame(rows, ROWS)


def test_components_by_brute_force(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3)]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in {y for u, v in links if u is not None and u != v for y in (u, v)}}


def test_exact_dedup(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        t = r["text"] or ""
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((-len(t), r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == docs.count() and sum(r["kept"] for r in got) == len(groups)
    assert sorted(Counter(r["text_sha256"] for r in got).values()) == sorted(len(v) for v in groups.values())
    assert all(r["keep_id"] == 47 for r in got if r["doc_id"] in (46, 47))
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_with_a_full_filter(docs):
    assert sorted(map(repr, exact_dedup.exact_dedup(docs, max_bits=32768).collect())) == sorted(map(repr, exact_dedup.exact_dedup(docs).collect()))


def test_bag_min_hash_is_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(6):
        a, b = ({int(k): int(rng.integers(1, 12)) for k in rng.choice(80, 50, False)} for _ in range(2))
        rows = [(i, k, x[k]) for i, x in enumerate((a, b)) for k in sorted(x)]
        r, v, c = (np.array(x) for x in zip(*rows))
        s = bagminhash.signatures(r, v.astype(np.uint64), c, 2, 4096)
        keys = a.keys() | b.keys()
        errors.append((s[0] == s[1]).mean() - sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys))
    assert abs(np.mean(errors)) < 0.012


def test_near_dedup(docs):
    got = near_dedup.near_dedup(docs).collect()
    rows = [(r["doc_id"], (r["text"] or "").split()) for r in docs.collect()]
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for _, w in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both / sum((bags[i] | bags[j]).values()) >= 0.8:
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(rows[i][0])
    want = sorted((min(x for x in c if x is not None), len(c)) for c in classes.values() for _ in c)
    assert sorted((r["class_id"], r["class_size"]) for r in got) == want
    assert near_dedup.keep_one(docs).count() == len(classes) and near_dedup.keep_one(docs).columns == docs.columns


def test_packing(docs):
    tokenizer = packing.public_tokenizer()
    e = ByteBpe(*tokenizer)
    got = packing.pack(docs, tokenizer, capacity=256).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    ids = e.ids(docs.where("doc_id = 52").first()["text"]).tolist() + [0]
    for r in sorted(pieces[52], key=lambda r: r["piece"]):
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and (r["piece"] == 0 or r["length"] == 256)
    assert sum(r["length"] for r in pieces[52]) == len(ids)
    assert len(bins) <= -(-sum(r["length"] for r in got) // 256) * 1.1 + 1


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.randint(1, 60) for _ in range(500))
    steps, n = packing.plan(histogram, 60)
    fill = defaultdict(list)
    for s in steps:
        for k in range(s.count):
            fill[s.bin + k // s.per_bin].append((s.offset + k % s.per_bin * s.length, s.length))
    assert Counter(x for b in fill.values() for _, x in b) == histogram and len(fill) == n
    for b in fill.values():
        assert [o for o, _ in sorted(b)] == [sum(x for _, x in sorted(b)[:i]) for i in range(len(b))] and sum(x for _, x in b) <= 60


def test_chunks_cover_texts():
    texts = ["", None, "x", "é" * 900, "ab cd " * 300]
    for t, c in zip(texts, substring_dedup.chunk_lists(pa.array(texts), 16, 512).to_pylist()):
        assert sum(x["length"] for x in c) == len(t or "") and [x["start"] for x in c] == [sum(y["length"] for y in c[:i]) for i in range(len(c))]


def test_mixing(docs):
    got = mixing.mix_report(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    target, weight, open_, left = {}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, list(names), sum(size.values()) * 1.5
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
            open_.remove(s)
    for s in names:
        assert by[s][0]["target"] == pytest.approx(target[s]) and abs(sum(r["taken"] for r in by[s]) - target[s]) < 2
    mixed = mixing.mix(docs)
    assert set(docs.columns) < set(mixed.columns) and mixed.count() > 0


def test_mixing_tree(spark):
    counts = spark.createDataFrame([(0, 100), (1, 40), (2, 0), (3, 7)], "idx int, n long")
    rows = mixing.tree(counts, 3).collect()
    leaves = Counter()
    for r in rows:
        leaves[r["leaf"]] += r["n"]
    assert max(leaves.values()) - min(leaves.values()) <= 3 and len(leaves) == 8
    assert {i: sum(r["n"] for r in rows if r["idx"] == i) for i in range(4)} == {0: 100, 1: 40, 2: 0, 3: 7}


def test_quality(spark):
    rng = random.Random(4)
    rows = [(i, sentence(rng, 80) if i % 4 else " ".join([sentence(rng, 1)] * 60)) for i in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(5, None), (7777, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 400]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.classify(docs, labels.limit(0)).where("score <> 0.5").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    tokenizer = packing.public_tokenizer()
    for f in (exact_dedup.exact_dedup, near_dedup.near_dedup, mixing.mix_report, substring_dedup.repeated_spans, lambda d: packing.pack(d, tokenizer), lambda d: token_counts.token_counts(d, tokenizer)):
        assert f(none).count() == 0
    assert embedding_dedup.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert textbytes.mix(np.zeros(1, np.uint64))[0] == 0


def test_classes_against_all_pairs_where_groups_are_only_alike(spark, monkeypatch):
    """Groups of texts that overlap by 0.5 to 0.9: no link is lost, also with buckets of many blocks."""
    monkeypatch.setattr(near_dedup, "_BLOCK_ROWS", 5)
    rng = np.random.default_rng(3)
    texts = []
    for group in range(4):
        base = [f"g{group}w{k}" for k in range(200)]
        for member in range(30):
            words = list(base)
            for at in rng.choice(200, rng.integers(1, 9), replace=False):
                words[at] = f"m{group}x{member}y{at}"
            texts.append(" ".join(words))
    rows = [(k, t) for k, t in enumerate(texts)] + [(900, texts[5]), (901, None), (902, ""), (903, "one two")]
    bag = {k: near_dedup._bag(t, 5) for k, t in rows if t}
    want = {k: k for k, _ in rows}
    for a in sorted(bag):
        for b in sorted(bag):
            if a < b and near_dedup.overlap(bag[a], bag[b]) >= 0.8 and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {k: low if c == high else c for k, c in want.items()}
    found = {r.doc_id: r.class_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == want
    assert len(set(want.values())) > 20
