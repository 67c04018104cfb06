"""Exact dedup by ranges of the filter, and the SQL of op6, op7 and op10 on the small tables."""

import random

import duckdb
import pytest

from millrace.llm import bitmap, catalog, exact_dedup

DIR = "/root/testdata/sf0.001"


def test_bitmap(spark):
    keys = spark.range(0, 400, 3).selectExpr("xxhash64(id) as k")
    bits = bitmap.filter_bits(400, 8, 1 << 20)
    table = bitmap.bitmap(keys.select(bitmap.slot(keys["k"], bits).alias("slot")), bits)
    rows = spark.range(400).selectExpr("id", "xxhash64(id) as k").unionAll(spark.sql("select -1L, cast(null as long)"))
    got = {r["id"]: r["maybe"] for r in bitmap.tested(rows, rows["k"], table, bits).collect()}
    assert all(got[i] for i in range(0, 400, 3)) and not got[-1] and sum(got.values()) < 200 and len(got) == 401
    assert bitmap.filter_bits(0, 8, 1 << 20) == bitmap.BUCKET and bitmap.filter_bits(1 << 30, 8, 1 << 20) == 1 << 20


@pytest.mark.parametrize("most", [1 << 15, 1 << 30])
def test_ranges_give_the_same_groups(spark, most):
    rng = random.Random(2)
    rows = [(i, f"text {rng.randrange(9000)}" if i % 4 else f"{i} own", "x") for i in range(9000)] + [(None, " text 1 ", "x"), (None, None, "y"), (9001, "", "y"), (5, "text 1", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i is None, i or 0))
    got = exact_dedup.exact_dedup(docs, max_bits=most).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    want = sorted((len(g), None if min(g)[1] else min(g)[2]) for g in groups.values() for _ in g if not min(g)[1])
    assert sorted((r["group_size"], r["keep_id"]) for r in got if r["keep_id"] is not None) == want
    kept = exact_dedup.keep_first(docs, max_bits=most)
    assert kept.columns == docs.columns and sorted("".join((r["text"] or "").split()) for r in kept.collect()) == sorted(groups)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_of_the_queries(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        duck.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = catalog.queries()[name](spark, DIR)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def shown(x):
        return round(x, 6) if isinstance(x, float) else x

    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([shown(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([shown(r[i]) for i in at]) for r in want.fetchall())
