"""The crawl, store, document and archive operators on small tables with nulls, ties and odd values."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import documents, text
from millrace.operators import crawl, find, frontier, index, links, store
from millrace.sources import archive


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect()) if columns else sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, "F", 1.0), (1, "O", None), (2, "F", 2.0), (None, "F", 3.0), (1, "F", 1.0), (3, None, 4.0)], "k int, s string, v double")


def test_remove_one_of_ties_and_nulls(table):
    left = store.remove(table, F.col("s") == "F", just_one=True, order=["k"])
    assert left.count() == 5 and left.where("k is null").count() == 0  # null is least
    left = store.remove(table.where("k is not null"), F.col("s") == "F", just_one=True, order=["k"])
    assert rows(left) == sorted([(1, "F", 1.0), (1, "O", None), (2, "F", 2.0), (3, None, 4.0)], key=repr)
    assert store.remove(table, F.col("s") == "none", just_one=True, order=["k"]).count() == 6
    assert store.remove(table.limit(0), F.col("s") == "F", just_one=True, order=["k"]).count() == 0


def test_update_forms(table, spark):
    got = store.update(table, F.col("s") == "F", {"v": F.lit(9.0), "s": None}, multi=False, order=["k"])
    assert rows(got.where("v = 9"), "k", "s") == [(None, None)] and got.where("v = 9").count() == 1
    assert store.update(table, F.col("s") == "F", {"v": None}).where("s = 'F' and v is null").count() == 4
    assert store.update(table, F.col("k") == 7, {"v": F.lit(1.0)}, insert={"k": 7, "v": 1.0}).where("k = 7 and s is null and v = 1").count() == 1
    assert store.update(table, F.col("k") == 2, {"v": F.lit(5.0)}, insert={"k": 7}).count() == 6
    deep = spark.createDataFrame([(1, (2, 3))], "a int, b struct<x: int, y: int>")
    assert store.unset(deep, "b.x").schema["b"].dataType.names == ["y"] and store.unset(deep, "a").columns == ["b"]
    assert store.rename(deep, {"a": "b"}).columns == ["b"] and store.rename(deep, {"a": "b"}).first()[0] == 1
    one = spark.createDataFrame([([1, 2, 1],), (None,)], "c array<int>")
    assert [r[0] for r in one.select(store.add_to_set(F.col("c"), 2)).collect()] == [[1, 2, 1], [2]]
    assert [r[0] for r in one.select(store.pull(F.col("c"), 1)).collect()] == [[2], None] and [r[0] for r in one.select(store.pop_end(F.col("c"), True)).collect()] == [[2, 1], None]


def test_find_on_mixed_types(table):
    count = lambda q: find.find(table, q).count()
    assert count({"s": {"$gt": 5}}) == 0 and count({"s": 5}) == 0 and count({"k": "x"}) == 0 and count({"k": {"$ne": "x"}}) == 6
    assert count({"k": {"$in": [1, "x", None]}}) == 4 and count({"k": {"$nin": [1, None]}}) == 2 and count({"k": True}) == 0
    assert count({"$and": []}) == 6 and count({"$or": []}) == 0 and count({"$nor": []}) == 6
    assert count({"s": re.compile("^f$", re.I)}) == 4 and count({"s": {"$in": [re.compile("^f", re.I)]}}) == 4 and count({"k": {"$regex": "1"}}) == 0
    assert count({"s": {"$mod": [2, 0]}}) == 0 and count({"k": {"$type": 16}}) == 5 and count({"k": {"$type": 2}}) == 0 and count({"k": {"$type": 10}}) == 1
    assert find.find(table, limit=-2).count() == 2 and find.find(table, limit=0).count() == 6 and find.count(table, {"s": "F"}, limit=3).first()[0] == 3
    with pytest.raises(ValueError):
        count({"k": {"$huh": 1}})


def test_find_in_arrays_of_documents(spark):
    df = spark.createDataFrame([(1, [("a", 5), ("b", 9)], [0.0, 3.0]), (2, [("a", 9)], [1.0, 1.0]), (3, None, None)], "id int, xs array<struct<n: string, v: int>>, at array<double>")
    ids = lambda q, **k: [r["id"] for r in find.find(df, q, **k).collect()]
    assert ids({"xs": {"$elemMatch": {"n": "a", "v": {"$in": [5, 6]}}}}) == [1] and ids({"xs": {"$elemMatch": {"n": {"$regex": "^b"}, "v": {"$mod": [3, 0]}}}}) == [1]
    assert ids({"xs": {"$elemMatch": {"n": 5}}}) == [] and ids({"xs": {"$size": 1}}) == [2] and ids({"id": {"$size": 1}}) == []
    assert ids({"at": {"$near": [1.0, 1.5]}}) == [2, 1] and ids({"at": {"$within": {"$center": [[1, 1], 0.5]}}}) == [2]


def test_folding_by_column(spark):
    a = spark.createDataFrame([("u", 1, 9, "x", None)], "url string, crawled int, seq int, title string, code int")
    b = spark.createDataFrame([("u", 2, 0, None, 5)], a.schema)
    c = spark.createDataFrame([("u", 1, 10, "y", 4)], a.schema)
    for order in ((a, b, c), (c, a, b), (b, c, a, a)):
        out = None
        for part in order:
            out = store.folded(out, part, "url", ["crawled", "seq"])
        assert rows(store.shown(out)) == [("u", "y", 5)]


def test_frontier_on_ties_and_few_hosts(spark):
    arrivals = spark.createDataFrame([(i, f"http://h{i % 3}/", f"h{i % 3}") for i in range(9)], "seq int, url string, host string")
    placed = frontier.queues(arrivals, 2)
    assert {(r["host"], r["queue"]) for r in placed.collect()} == {("h0", 0), ("h1", 1), ("h2", None)}
    assert rows(frontier.lengths(placed)) == [(-1, 3), (0, 3), (1, 3)] and frontier.wave(placed).count() == 2
    assert rows(frontier.wave(frontier.pop(placed)), "seq") == [(3,), (4,)]
    many = spark.createDataFrame([(i, None, h) for i, h in enumerate(["b", "abc", "ab", "a", "zz", "z", "ac"])], "seq int, queue int, host string")
    assert [r["host"] for r in frontier.waiting_order(many).orderBy("turn").collect()] == ["zz", "z", "b", "ac", "abc", "ab", "a"]


def test_crawl_steps(spark):
    urls = spark.createDataFrame([("http://a/x", "a", "/x"), ("http://b/x", "b", "/x"), ("http://c/x", "c", None)], "url string, host string, path string")
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /x"), ("b", None)], "host string, robots string")
    assert rows(crawl.admitted(urls, robots, "me"), "host", "allowed") == [("a", False), ("b", True), ("c", True)]
    pages = spark.createDataFrame([("http://a/x", b"12345"), ("http://b/x", b"1")], "url string, content binary")
    got = {r["host"]: (r["http_code"], r["fetch_code"], r["content"] and bytes(r["content"])) for r in crawl.fetched(urls, pages, 3).collect()}
    assert got == {"a": (200, 23, None), "b": (200, 0, b"1"), "c": (404, 0, None)}

    def fetch(url, headers):
        if "b" in url:
            raise OSError("down")
        return 200, (url + str(sorted(headers))).encode()

    live = crawl.fetch_with(urls, fetch, ["path"])
    assert {r["host"]: (r["http_code"], bytes(r["content"])) for r in live.collect()} == {"a": (200, b"http://a/x['path']"), "b": (0, b"down"), "c": (200, b"http://c/x[]")}
    files = spark.createDataFrame([("/d/a.pdf", b"%PDF-1.4 text"), ("/d/b.txt", b"text"), ("file:/c", None)], "path string, content binary")
    assert rows(crawl.local_documents(files), "http_code") == [(415,)] * 3
    assert rows(crawl.local_documents(files, lambda b: b[9:].decode()).where("http_code = 200"), "url", "text") == [("file:///d/a.pdf", "text")]
    with pytest.raises(ValueError):
        crawl.hinted(urls, "nope", ["url"])
    assert crawl.hinted(urls, "url", ["url"]) is urls


def test_archive(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "b.jpeg").write_bytes(b"x")
    found = archive.files(spark, f"file://{tmp_path}")
    assert found.count() == 1 and found.select(text.pdf_version(F.decode("content", "ISO-8859-1")).alias("v")).first()["v"]["minor"] == "7"
    blobs = spark.createDataFrame([("a", bytes(range(256)) * 5), ("b", b""), ("c", b"z")], "k string, d binary")
    chunks = archive.chunked(blobs, "k", "d", 100)
    assert rows(archive.listed(chunks, "k")) == [("a", 13, 1280), ("b", 1, 0), ("c", 1, 1)]
    assert {r["k"]: bytes(r["content"]) for r in archive.assembled(chunks, "k").collect()} == {r["k"]: bytes(r["d"]) for r in blobs.collect()}
    assert archive.removed(chunks, blobs.where("k = 'a'"), "k").count() == 2


def test_bytes_and_entities(spark):
    df = spark.createDataFrame([(b"\xff\xfea",), (b"\x00\x00\xfe\xff",), (b"\xef\xbb\xbf",), (b"\xc3\xa9",), (b"abc\x0b",), (b"\xc3",), (None,)], "b binary")
    got = df.select(text.unicode_bom(F.col("b")), text.looks_utf8("b"), text.is_valid_utf8(F.col("b"))).collect()
    assert [r[0] for r in got] == ["UTF-16LE", "UTF-32BE", "UTF-8", None, None, None, None]
    assert got[3][1] is True and got[4][1] is False and got[5][2] is False and got[6][2] is None
    s = spark.createDataFrame([("Straße&eacute;&bogus;&#65;",), (None,)], "s string")
    assert [tuple(r) for r in s.select(text.decode_entities("s"), text.fold_case("s"), text.drop_controls(F.col("s"))).collect()] == [("StraßeéA", "strasse&eacute;&bogus;&#65;", "Straße&eacute;&bogus;&#65;"), (None, None, None)]
    k = spark.createDataFrame([(b"\xd2\xe5\xf1\xf2",)], "b binary")
    assert k.select(text.transcode("windows-1251")("b")).first()[0] == "Тест" and k.select(text.hex_dump(F.col("b"))).first()[0] == "d2 e5 f1 f2"
    n = spark.createDataFrame([(999.0,), (1000.0,), (1001.0,), (2.5e9,), (0.125,), (372405.0,), (None,)], "v double")
    assert [r[0] for r in n.select(text.fmt_bytes(F.col("v"))).collect()] == ["999.00 iB", "1000.00 iB", "1.00 KiB", "2.50 GiB", "0.12 iB", "372.40 KiB", None]


def test_links(spark):
    page = '<body><a href="/a">A</a><a href="b.html">B &amp; C</a>'
    df = links.analysed(spark.createDataFrame([("http://mill.test/d/", page), (None, None), ("http://mill.test/", None)], "url string, html string"))
    out = links.exploded(df)
    assert rows(out, "dst", "txt") == [("http://mill.test/a", "A"), ("http://mill.test/d/b.html", "B & C")]
    assert df.select(links.serialised(F.col("page.links"))).first()[0] == "\x01http://mill.test/a\x02A\x03\x01http://mill.test/d/b.html\x02B & C\x03"


def test_ranked_search_by_brute_force(spark):
    import math
    from collections import Counter

    docs = {1: "the cat sat on the mat", 2: "the dog", 3: "cat cat cat", 4: "", 5: None, 6: "a bird"}
    toks = index.tokens(spark.createDataFrame(list(docs.items()), "doc_id int, text string"))
    asked = spark.createDataFrame([(1, "cat"), (1, "the"), (1, "cat"), (2, "bird"), (3, "none")], "query_id int, term string")
    words = {i: Counter((t or "").split()) for i, t in docs.items() if (t or "").split()}
    n, avg = len(words), sum(sum(c.values()) for c in words.values()) / len(words)
    want = {}
    for q, terms in ((1, {"cat", "the"}), (2, {"bird"})):
        for i, c in words.items():
            score = 0.0
            for t in terms & set(c):
                df = sum(t in x for x in words.values())
                score += math.log1p((n - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
            if score:
                want[q, i] = score
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in index.bm25(toks, asked).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nesting(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `a.c.d` int, e int")
    there = documents.nested(df)
    assert there.select("a.c.d").first()[0] == 2 and documents.dotted(there).columns == df.columns
    assert documents.storable(df) == ["a.b", "a.c.d"] and documents.only_fields(df, "e", but=True).columns == ["a.b", "a.c.d"]


def test_options_and_listing(spark):
    from millrace.sources.options import Options, listing

    assert Options.of({"parallel": "7"}).parallel == 7 and Options.of({}).tick_seconds == 5
    with pytest.raises(ValueError):
        Options.of({"nope": 1})
    spark.conf.set("millrace.agent", "me")
    assert Options.of(spark).agent == "me"
    spark.conf.unset("millrace.agent")
    spark.range(1).createOrReplaceTempView("listed_here")
    assert listing(spark).where("`table` = 'listed_here'").first()["column"] == "id"
