"""What differs or grows on tables that are larger than the test data, on small tables made for it."""

import re

import duckdb
import pytest

from millrace.plans import catalog


@pytest.fixture
def same(spark, tmp_path):
    """Asserts that a query and its SQL give the same rows on the tables handed in; gives the rows."""

    def check(name, **tables):
        c = duckdb.connect()
        c.sql("set threads = 1")  # so any_value() takes the first row
        for t, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        got, want = catalog.queries()[name](spark, str(tmp_path)), c.sql(catalog.oracle_sql()[name])
        at = [want.columns.index(n) for n in got.columns]
        rows = sorted((tuple(r) for r in got.collect()), key=repr)
        assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
        return rows

    return check


def test_of_pages_with_one_url_the_first_is_fetched(spark, same):
    pages = [(1, "http://a/x", "<p>b"), (2, "http://a/x", "<p>c"), (3, "http://a/x", "<p>a"), (4, "http://a/y", None), (6, "http://a/y", "z" * 2001), (7, "http://a/z", None)]
    same("fetch_offline", pages=spark.createDataFrame(pages, "page_id long, url string, html string"))


def test_integers_beyond_four_bytes_come_back(spark, same):
    keys = [0, 1, 2, 3, 271_179, 271_180, 271_181, 300_000, 542_361, 542_362, 9_000_000, 10**12]
    same("integers_big_endian", orders=spark.createDataFrame([(k,) for k in keys], "o_orderkey long"))


def test_memory_of_the_lexer_does_not_grow_with_the_batch():
    import tracemalloc

    import pyarrow as pa

    from millrace.functions.batches import in_slices
    from millrace.functions.html_lex import RESULT
    from millrace.operators.links import page_maker

    def peak(rows):
        page = "<body>" + "<p>some words<a href='/x'>a link</a>" * 20
        batch = pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(["http://a/"] * rows), pa.array([page] * rows)], names=["page_id", "url", "html"])
        tracemalloc.start()
        made = sum(part.num_rows for part in in_slices(page_maker("html", "url", ["page_id"], RESULT.names), 1 << 15)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert made == rows
        return most

    assert peak(640) < 1.3 * peak(160)


def test_only_the_asked_fields_of_pages(spark):
    from millrace.operators import links

    pages = spark.createDataFrame([(1, "http://a/", "<title>A &quot;b&quot;</title><a href='/x'>y</a>"), (2, "http://a/", None), (3, "no base", "<p>z"), (4, None, "<p>z")], "page_id int, url string, html string")
    assert [tuple(r) for r in links.analysed(pages, fields=["title", "warnings"]).orderBy("page_id").select("page_id", "page.*").collect()] == [
        (1, 'A "b"', ""), (2, None, None), (3, None, "base is not absolute"), (4, "", ""),
    ]


ODD = [(1, "The the cats, cats!", "en"), (2, "", "en"), (3, None, "en"), (4, " Kategorien kategorie; the", "de"), (5, "cats word_cats", "xx"), (5, "The cat", "en"), (5, None, None), (None, "the end", "en"), (None, "the cat", "en")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("rows", [ODD, ODD[:4], []])
def test_term_statistics_of_documents_in_several_rows(spark, same, rows):
    same("term_df", documents=docs(spark, rows))


@pytest.mark.parametrize("rows", [ODD, ODD[:4], []])
def test_stems_of_documents_in_several_rows(spark, tmp_path, rows):
    from collections import Counter, defaultdict

    from millrace.functions.stem import LANGUAGES, stem_word

    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    words, langs = defaultdict(set), defaultdict(set)
    for i, text, lang in rows:
        if i is not None:
            words[i] |= {w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()}
            langs[i].add(lang)
    known = {c for codes in LANGUAGES.values() for c in codes.split()}
    want = Counter(x for i in words for lang in langs[i] for x in {(lang, stem_word(w, lang) if lang in known else w) for w in words[i]})
    got = catalog.queries()["stem_documents"](spark, str(tmp_path)).collect()
    assert {(r["lang"], r["stem"]): r["df"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("name", ["term_df", "stem_documents"])
def test_words_are_counted_before_they_shuffle(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id" not in plan and "Join" not in plan


def test_scores_are_summed_where_the_documents_are(spark, monkeypatch):
    from millrace.operators import index

    toks = index.tokens(docs(spark, ODD[:4]))
    asked = spark.createDataFrame([(1, "cats"), (1, "the"), (2, "kategorie"), (2, "none")], "query_id int, term string")
    few = index.bm25(toks, asked)
    assert not re.search(r"hashpartitioning\(query_id#\w+, doc_id#", few._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(index, "_FEW_ASKED", 2)  # more are asked: the same by joins that shuffle
    scores = lambda df: {(r[0], r[1]): round(r[2], 9) for r in df.collect()}
    assert scores(few) == scores(index.bm25(toks, asked)) and len(scores(few)) == 3
