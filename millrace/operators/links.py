"""The link graph of crawled pages, and the crawl join."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.batches import in_slices
from millrace.functions.html_lex import RESULT, lexed_arrow


def analysed(pages: DataFrame, html: str = "html", url: str = "url", fields: Sequence[str] = tuple(RESULT.names)) -> DataFrame:
    """``pages`` with the struct ``page`` (text, links, title, ...) instead of the html, made once per page.

    Only ``fields`` of it are made into columns.  A worker holds a slice of some MB and its results.
    """
    kept = [f for f in pages.schema if f.name != html]
    schema = T.StructType([*kept, T.StructField("page", T.StructType([RESULT[n] for n in fields]))])
    return pages.mapInArrow(in_slices(page_maker(html, url, [f.name for f in kept], fields)), schema)


def page_maker(html: str, url: str, kept: Sequence[str], fields: Sequence[str]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """From a slice of pages its ``kept`` columns and the struct ``page``."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        page = lexed_arrow(part.column(html), part.column(url), fields)
        return pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), page], names=[*kept, "page"])

    return make


def exploded(pages: DataFrame, url: str = "url") -> DataFrame:
    """(src, dst, txt) of every link."""
    return pages.select(F.col(url).alias("src"), F.inline("page.links").alias("dst", "txt"))


def in_degree(links: DataFrame) -> DataFrame:
    return links.groupBy("dst").agg(F.count("*").alias("n_links"))


def serialised(links: Column) -> Column:
    """The link stream: control marks 1, 2 and 3 around url and text."""
    clean = lambda c: F.regexp_replace(c, r"[\x00-\x08]", "")
    return F.array_join(F.transform(links, lambda x: F.concat(F.lit("\x01"), clean(x["url"]), F.lit("\x02"), clean(x["txt"]), F.lit("\x03"))), "")
