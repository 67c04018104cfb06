"""Ids, counts and packing against a fresh Tokenizer, token by token, and against the best packing."""

import random
from collections import Counter
from functools import lru_cache

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, token_counts
from millrace.llm.tokens import ByteBpe

FILES = packing.public_tokenizer()
FRESH, OURS = Tokenizer.from_file(FILES[0]), ByteBpe(*FILES)
PARTS = st.sampled_from(["<|endoftext|>", " <|endoftext|> ", "<|endoftext", "a", " b", "  ", "\n\n", "\t", "don't", "I'LL", "123456", "é", "ſ", "ß", "\xa0", "\x85", " ", "日本", "😀", "é", "\x00", "x" * 300])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS | st.text(max_size=12), max_size=12).map("".join))
def test_ids_and_offsets_equal_a_fresh_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode()
    want = FRESH.encode(text, add_special_tokens=False)
    assert OURS.ids(text).tolist() == want.ids
    assert OURS.starts(text).tolist() == [s for s, _ in want.offsets]


def test_added_tokens():
    text = "a <|endoftext|> b"
    assert OURS.ids(text).tolist() == [64, 220, 50256, 275]
    assert 50256 not in ByteBpe(*FILES, True).ids(text).tolist()


def test_long_texts():
    for t in ("x" * 3000, " " * 500 + "y", "word " * 40_000, "日本語 " * 5000):
        want = FRESH.encode(t, add_special_tokens=False)
        assert OURS.ids(t).tolist() == want.ids and OURS.starts(t).tolist() == [s for s, _ in want.offsets]


def test_counts_token_by_token(spark):
    rng = random.Random(3)
    texts = ["one two\nthree\n\nfour é", "", None, "\n", "日本\n😀 x\n", "a <|endoftext|>\nb", "end\n", *["".join(rng.choice("ab \n日é") for _ in range(200)) for _ in range(30)]]
    rows = [(i, t, 7, "c") for i, t in enumerate(texts)] + [(None, "x y", 7, "c"), (0, texts[0], 7, "c")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, section string"), FILES)
    assert got.count() == len(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    for i, t in enumerate(texts):
        t = t or ""
        starts = [0] + [k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t)]
        counts = [0] * len(starts)
        for start, _ in FRESH.encode(t, add_special_tokens=False).offsets:
            counts[max(k for k, s in enumerate(starts) if s <= start)] += 1
        r = by[i]
        assert (r["section_starts"], r["section_tokens"], r["n_tokens"], r["n_chars"], r["n_sections"]) == (starts, counts, sum(counts), len(t), len(starts))
    sections = token_counts.by_section(got)
    assert sections.count() == sum(r["n_sections"] for r in got.collect())


def fewest(items, capacity):
    """The least number of bins, by trying all."""

    @lru_cache(maxsize=None)
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        least = len(left)
        seen = set()

        def fill(room, at, kept, taken):
            nonlocal least
            if (key := tuple(kept) + rest[at:]) not in seen:
                seen.add(key)
                least = min(least, 1 + best(key))
            for k in range(at, len(rest)):
                if rest[k] <= room and not (k > at and rest[k] == rest[k - 1]):
                    fill(room - rest[k], k + 1, [*kept, *rest[at:k]], taken + 1)

        fill(capacity - first, 0, [], 0)
        return least

    return best(tuple(sorted(items, reverse=True)))


@pytest.mark.parametrize("seed", range(12))
def test_packing_against_the_best(seed):
    rng = random.Random(seed)
    over = []
    for _ in range(15):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        _, n = packing.plan(Counter(items), 30)
        over.append(n - fewest(items, 30))
    assert 0 <= min(over) and max(over) <= 1 and sum(over) <= 3
