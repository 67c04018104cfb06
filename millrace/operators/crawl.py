"""The steps of a crawl as joins and columns: admission, acceptance, conditional requests, fetching, references."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.text import robots_allowed

#: Classes of content that are fetched (fixed values).
ACCEPTED = ("TEXT_HTML", "TEXT_PLAIN", "XHTML", "APPLICATION_PDF", "RSS_XML", "ATOM_XML")
LARGEST_BODY = 1_048_576
MOST_REDIRECTS = 5


def admitted(urls: DataFrame, robots: DataFrame, agent: str, mode: str = "documented") -> DataFrame:
    """``urls(host, path, ...)`` with allowed, by ``robots(host, robots)``: text of robots.txt, null where it could not be had.

    Hosts without an entry, and texts that are not rules, allow everything.
    """
    rules = robots.select(F.col("host").alias("__host"), F.col("robots").alias("__robots"))
    joined = urls.join(rules, F.col("host") == F.col("__host"), "left")
    return joined.withColumn("allowed", robots_allowed(agent, mode)(F.col("__robots"), F.col("path"))).drop("__host", "__robots")


def robots_dump(parsed: Column) -> Column:
    """Parsed rules as lines: ``ua: name`` and then kind and path of each rule."""
    group = lambda g: F.concat(F.transform(g["ua"], lambda u: F.concat(F.lit("ua: "), u)), F.transform(g["rules"], lambda r: F.concat_ws(" ", r["type"], r["path"])))
    return F.array_join(F.flatten(F.transform(parsed, group)), "\n")


def acceptance(heads: DataFrame, kind: str = "content_type", accepted: Sequence[str] = ACCEPTED) -> DataFrame:
    """``heads`` with wanted; those that are not get http_code 406 and no body is asked for."""
    wanted = F.coalesce(F.col(kind).isin(*accepted), F.lit(False))
    code = F.col("http_code") if "http_code" in heads.columns else F.lit(None).cast("int")
    return heads.withColumn("wanted", wanted).withColumn("http_code", F.when(wanted, code).otherwise(F.lit(406)))


def conditional(docs: DataFrame, etag: str = "etag", modified: str = "modified") -> DataFrame:
    """``docs`` with if_none_match, or where there is no etag if_modified_since; null for what was never fetched."""
    has = F.coalesce(F.col(etag) != "", F.lit(False))
    stamp = F.date_format(F.timestamp_seconds(modified), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return docs.withColumns({"if_none_match": F.when(has, F.col(etag)), "if_modified_since": F.when(~has & (F.col(modified) > 0), stamp)})


def fetched(urls: DataFrame, pages: DataFrame, largest: int = LARGEST_BODY) -> DataFrame:
    """The offline fetcher: bodies from ``pages(url, content)``; code 200, 404 where there is none.

    A body beyond ``largest`` bytes is broken off: fetch_code 23 and no content.
    """
    body = pages.select(F.col("url").alias("__url"), F.col("content").alias("__content"))
    got = urls.join(body, F.col("url") == F.col("__url"), "left")
    long = F.octet_length("__content") > largest
    return got.select(
        *urls.columns, F.when(F.col("__url").isNull(), 404).otherwise(200).alias("http_code"), F.when(long, 23).otherwise(0).alias("fetch_code"), F.when(~long, F.col("__content")).alias("content")
    )


def fetch_with(urls: DataFrame, fetch: Callable[[str, dict], tuple[int, bytes | None]], headers: Sequence[str] = ()) -> DataFrame:
    """``urls`` fetched by a function (url, headers) -> (code, body), in the order in which rows come; an error gives code 0.

    Partition by host first, and no host has two requests at once.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                try:
                    rows.append(fetch(r["url"], {h: r[h] for h in headers if r.get(h)}))
                except Exception as e:  # noqa: BLE001  a failing host is a row, not a failing job
                    rows.append((0, str(e).encode()))
            yield b.assign(http_code=[x[0] for x in rows], content=[x[1] for x in rows])

    return urls.mapInPandas(run, f"{kinds}, http_code int, content binary")


def stage_of(docs: DataFrame) -> Column:
    """Which step a url is at: ROBOTS, then HEAD, then CONTENT, then DONE or NEXT (not allowed, not wanted)."""
    c = {n: F.col(n) if n in docs.columns else F.lit(None) for n in ("allowed", "wanted", "content", "http_code")}
    return (
        F.when(c["allowed"].isNull(), "ROBOTS").when(~c["allowed"].cast("boolean"), "NEXT").when(c["wanted"].isNull(), "HEAD").when(~c["wanted"].cast("boolean"), "NEXT")
        .when(c["content"].isNull() & c["http_code"].isNull(), "CONTENT").otherwise("DONE")
    )


def resolved(rows: DataFrame, ref: str, collection: DataFrame, key: str, prefix: str = "ref_") -> DataFrame:
    """``rows`` with the columns of the document that ``ref`` points to; null where it is gone."""
    there = collection.select(*[F.col(c).alias(prefix + c) for c in collection.columns])
    return rows.join(there, F.col(ref) == F.col(prefix + key), "left")


def local_documents(files: DataFrame, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """Local files (path, content) as documents: url, http_code, text.

    With an extractor a PDF gives its text (code 200); without one, and for what is no PDF,
    the code is 415 and there is no text.
    """
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("http_code", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                url = path if path.startswith("file:") else "file://" + path
                pdf = content is not None and bytes(content[:5]) == b"%PDF-"
                out.append((url, 200, extract(bytes(content))) if extract and pdf else (url, 415, None))
            yield pd.DataFrame(out, columns=schema.names)

    return files.select("path", "content").mapInPandas(run, schema)


def blob_set(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A keyed blob table after ``rows``: their blobs replace those of the same key."""
    return stored.join(rows.select(key), key, "left_anti").unionByName(rows)


def blob_get(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return keys.select(key).join(stored, key, "left")


def blob_erase(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def for_each_batch(df: DataFrame, take: Callable) -> None:
    """Hand all rows to ``take``, an iterator a partition, on the executors."""
    df.foreachPartition(take)


def hinted(df: DataFrame, index: str, known: Sequence[str]) -> DataFrame:
    """``df``: there are no indexes to choose from; one that isn't known is an error, as it would be in a store."""
    if index not in known:
        raise ValueError(f"no index {index}")
    return df
