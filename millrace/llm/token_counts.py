"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole, so counts agree with what training sees.  Tokens
carry the character at which they start; sections are disjoint, ordered character spans
that cover the text.  The interval join of tokens with sections is a binary search in the
worker.  *Rule for tokens that cross a boundary:* a token belongs to the section that
holds its first character; tokens of one character (parts of its bytes) all start there.
So counts of sections add up to the document's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import in_slices
from millrace.llm.tokens import worker_encoder


def paragraphs(text: str) -> np.ndarray:
    """Starts of lines; a line keeps the line feed that ends it."""
    starts, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, np.int64)


def attribute(token_starts: np.ndarray, section_starts: np.ndarray) -> np.ndarray:
    """Tokens of each section."""
    at = np.searchsorted(section_starts, token_starts, side="right") - 1
    return np.bincount(at, minlength=len(section_starts))


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_chars", pa.int64()), ("n_sections", pa.int32()), ("section_starts", pa.list_(pa.int64())), ("section_tokens", pa.list_(pa.int64()))]
)


def token_counts(
    docs: DataFrame, tokenizer: tuple, sections: Callable[[str], np.ndarray] = paragraphs, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_chars, n_sections, section_starts, section_tokens.

    Null and empty texts have one empty section and no tokens.  Long texts are encoded whole.
    Repeated rows give a row each, null ids too; ties can't be.  Extra columns are not read, and
    an empty table gives no rows.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = worker_encoder(*tokenizer)
        rows: list[tuple] = []
        for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or ""
            starts = sections(t)
            tokens = attribute(enc.starts(t), starts)
            rows.append((doc_id, int(tokens.sum()), len(t), len(starts), starts, tokens))
        columns = list(zip(*rows)) or [[]] * len(_OUT)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _OUT)], schema=_OUT)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        in_slices(count), "doc_id long, n_tokens long, n_chars long, n_sections int, section_starts array<long>, section_tokens array<long>"
    )


def by_section(counts: DataFrame) -> DataFrame:
    """One row per section: doc_id, section (from 0), start, n_tokens."""
    zipped = F.arrays_zip("section_starts", "section_tokens")
    return counts.select("doc_id", F.posexplode(zipped).alias("section", "x")).select(
        "doc_id", "section", F.col("x.section_starts").alias("start"), F.col("x.section_tokens").alias("n_tokens")
    )
