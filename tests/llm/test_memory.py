"""Working memory of the signatures does not grow with the number of rows."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from millrace.llm import near_dedup
from millrace.llm.bagminhash import rows_at_once, signatures
from millrace.llm.common import slices
from millrace.llm.textbytes import bags, blocks, shingles


@pytest.mark.parametrize("rows,words", [(10_000, 10), (3_000, 30), (3, 100_000)])
@pytest.mark.parametrize("slots", [256, 512])
def test_peak_of_signatures(rows, words, slots):
    rng = random.Random(rows)
    texts = pa.array([" ".join(f"w{rng.randrange(5000)}" for _ in range(words)) for _ in range(rows)])
    tracemalloc.start()
    if slots == 256:
        near_dedup._sign(texts, 5, slots, 64, 8)
    else:
        for first, end, data, offsets in blocks(texts, rows=rows_at_once(slots)):
            signatures(*bags(*shingles(data, offsets, 5)), end - first, slots)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_slices_cover_a_batch():
    texts = ["x" * n for n in (10, 5_000_000, 3, 0, 2_000_000, 2_500_000, 7)] + ["y" * 1000] * 9000
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["t", "i"])
    parts = list(slices(batch))
    assert [i for p in parts for i in p.column(1).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or p.nbytes <= 8 << 20 for p in parts) and len(parts) < 40
    assert list(slices(batch.slice(0, 0))) == []
