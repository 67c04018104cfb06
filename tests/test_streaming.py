"""Streams run to their end and are held against batch models."""

import os
from collections import defaultdict

import pandas as pd
import pytest

from millrace.operators import store
from millrace.streaming import crawl, frontier


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def put(folder, k, rows, columns):
    """A file a micro-batch; the source takes files by their time, so each has its own."""
    path = folder / f"{k}.json"
    pd.DataFrame(rows, columns=columns).to_json(path, orient="records", lines=True)
    os.utime(path, (1_700_000_000 + 10 * k,) * 2)


def run(stream, tmp_path, name):
    out = []
    query = stream.writeStream.foreachBatch(lambda b, i: out.append((i, b.collect()))).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return out


def test_frontier_against_a_model(rocks, tmp_path):
    batches = [
        [("a.org", 1, "http://a.org/1", None), ("a.org", 2, "http://a.org/2", None), ("b.org", 3, "http://b.org/x", None), ("b.org", 4, None, "User-agent: *\nDisallow: /no\n")],
        [("a.org", 5, "http://a.org/3", None), ("b.org", 6, "http://b.org/no/1", None), ("b.org", 7, "http://b.org/y", None)],
        [("a.org", 8, "http://a.org/4", None), ("b.org", 9, "http://b.org/z", None), ("c.org", 10, "http://c.org/", None)],
    ]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        put(tmp_path / "in", k, rows, ["host", "seq", "url", "robots"])
    arrivals = rocks.readStream.schema(frontier.ARRIVAL).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    got = [sorted((r["host"], r["seq"], r["stage"], r["waiting"]) for r in rows) for _, rows in run(frontier.waves(arrivals, "bot"), tmp_path, "check")]
    queues, want = defaultdict(list), []
    for rows in batches:
        wave = []
        for host in sorted({r[0] for r in rows}):
            queues[host] += [r[1:3] for r in rows if r[0] == host and r[2]]
            while queues[host]:
                seq, url = queues[host].pop(0)
                banned = host == "b.org" and "/no" in url
                wave.append((host, seq, "NEXT" if banned else "CONTENT", len(queues[host])))
                if not banned:
                    break
        want.append(sorted(wave))
    assert [g for g in got if g] == want
    wave = rocks.createDataFrame([("a", 5, "u", "CONTENT", 0), ("b", 2, "u", "CONTENT", 0), ("c", 1, "u", "NEXT", 0)], frontier.WAVE)
    assert {r["host"] for r in frontier.served(wave, 1).collect()} == {"b"}


def test_url_lines_and_throughput(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("http://a.org/\nhttps://b.org/\nx\n\nhttp://c.org/last")
    got = run(crawl.url_lines(spark, f"file://{tmp_path}/in"), tmp_path, "lines")
    assert sorted(r["url"] for _, rows in got for r in rows) == ["http://a.org/", "http://c.org/last"]


def test_upsert_sink_keeps_each_columns_last_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [[("u", 1, 10, "a", None)], [("u", 3, 1, None, 5)], [("u", 2, 99, "old", 7), ("v", 1, 1, None, 1)]]
    for k, batch in enumerate(rows):
        put(tmp_path / "in", k, batch, ["url", "crawled", "seq", "title", "code"])
    stream = spark.readStream.schema("url string, crawled long, seq long, title string, code long").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    paths = []

    def read():
        return spark.read.parquet(paths[-1]) if paths else None

    def write(df):
        path = f"file://{tmp_path}/table{len(paths)}"
        df.write.parquet(path)
        paths.append(path)

    crawl.upsert_sink(stream, "url", ["crawled", "seq"], read, write, f"file://{tmp_path}/sink").awaitTermination(240)
    got = {r["url"]: (r["title"], r["code"]) for r in store.shown(read()).collect()}
    assert got == {"u": ("old", 5), "v": (None, 1)}


def test_rate(spark):
    rows = spark.sql("select timestamp_seconds(id * 5) as at, id * id * 1000 as bytes from range(4)")
    assert [r["kb_s"] for r in crawl.rate(rows, "at", "bytes").orderBy("at").collect()] == [None, 0.2, 0.6, 1.0]
