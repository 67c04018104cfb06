"""Tokens, postings and ranked search.

Terms are lower-case runs of letters and digits.  Statistics are grouped by (term, doc),
which spreads frequent terms; a posting list is written as bounded segments of documents,
so no term is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tokens(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, pos, term), pos counting split places from 0."""
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(_words(text)).alias("pos", "term")).where("term <> ''")


#: Asked terms, counted, up to which they are broadcast.
_FEW_ASKED = 100_000


def _words(text: str):
    return F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")


def distinct_words(text: str = "text") -> Column:
    """The different terms of a text, as an array."""
    return F.array_remove(F.array_distinct(_words(text)), "")


def apart(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has, and the rest; None where there is no rest, which a job over the keys tells."""
    many = docs.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).where("__n > 1").select("__key")
    if many.isEmpty():
        return docs, None
    same = F.col(key).eqNullSafe(F.col("__key"))
    return docs.join(many, same, "left_anti"), docs.join(many, same, "left_semi")


def term_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(term, df, cf): documents that hold a term, and its places in them.  Rows with the same key are one document.

    A row counts its own distinct words, so only (term, df, cf) shuffles; documents of several
    rows, where there are any, go by (term, doc).
    """
    single, rest = apart(docs, key)
    words = single.select(_words(text).alias("w"))
    # all words count for cf, the distinct ones for df
    both = words.select(F.inline(F.array(F.struct(F.lit(0).alias("d"), F.col("w").alias("w")), F.struct(F.lit(1).alias("d"), F.array_distinct("w").alias("w")))))
    counts = both.select("d", F.explode("w").alias("term")).where("term <> ''").groupBy("term").agg(F.sum("d").alias("df"), F.sum(F.lit(1) - F.col("d")).alias("cf"))
    if rest is None:
        return counts
    more = document_frequency(term_frequency(tokens(rest, text, key)))
    return counts.unionByName(more).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def term_frequency(toks: DataFrame) -> DataFrame:
    return toks.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def postings(tf: DataFrame, segment_docs: int = 65536) -> DataFrame:
    """(term, segment, n, docs): lists in document order, one row for each range of ``segment_docs`` ids."""
    return tf.groupBy("term", F.floor(F.col("doc_id") / segment_docs).alias("segment")).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("docs")
    )


def search_all(tf: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that hold all terms."""
    return tf.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(set(terms))).select("doc_id")


def bm25(toks: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) for ``queries(query_id, term)``; documents with a common term.

    ``toks`` are (doc_id, term) rows, repeats counted.  One pass makes a row for each document:
    its length and the counts of the asked terms only, so what shuffles is what is asked.
    """
    asked = queries.select("query_id", "term").distinct()
    wanted = asked.select("term").distinct().withColumn("__asked", F.lit(True))
    marked = toks.select("doc_id", "term").join(wanted, "term", "left")
    # terms that aren't asked are counted under null, on the map side
    counts = marked.groupBy("doc_id", F.when(F.col("__asked"), F.col("term")).alias("term")).agg(F.count("*").alias("tf"))
    docs = counts.groupBy("doc_id").agg(F.sum("tf").alias("len"), F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("found"))
    total = docs.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    hits = docs.select("doc_id", "len", F.explode("found").alias("f")).select("doc_id", "len", "f.term", "f.tf")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    known = df.join(asked, "term")
    if asked.limit(_FEW_ASKED + 1).count() <= _FEW_ASKED:  # hits stay dealt by document, so scores are summed where they are
        known = F.broadcast(known)
    # total is one row
    weighed = hits.join(known, "term").crossJoin(F.broadcast(total))
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.coalesce(F.nullif("avg_len", F.lit(0.0)), F.lit(1.0))))
    return weighed.select("query_id", "doc_id", (idf * norm).alias("w")).groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
