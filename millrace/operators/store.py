"""The sparse document table: keyed upsert, lookup, removal, and the update modifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bit positions of the flags column (fixed values).
FLAGS = {"EMPTY": 0, "UTF8_OK": 1, "HAS_SYNDICATION": 2, "IS_SYNDICATED": 3, "INDEX": 4, "FOLLOW": 5}
#: The document table (fixed names): fields with null for "not written".
SCHEMA = (
    "url string, eff_url string, http_code int, fetch_code int, fetch_error string, modified long, crawled long, content binary, headers string, etag string, "
    "content_type string, charset string, flags int, title string, rss2 string, rss string, atom string"
)


def upsert(writes: DataFrame, key: str, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: of each column the last non-null value by ``order``.

    ``writes`` are the stored rows and the new ones together.  A null leaves what is stored
    untouched.  One aggregation, combined on the map side.
    """
    columns = columns or [c for c in writes.columns if c != key and c not in order]
    at = F.struct(*order)
    return writes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


_AT = "__written"


def stored(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` as a table that remembers, for each column, the write that gave its value (a map of structs)."""
    columns = [c for c in rows.columns if c != key and c not in order]
    at = F.struct(*order)
    return rows.withColumn(_AT, F.struct(*[F.when(F.col(c).isNotNull(), at).alias(c) for c in columns])).drop(*order)


def folded(table: DataFrame | None, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``table`` (as of ``stored``) after the new ``rows``; each column goes by its own last write."""
    new = stored(rows, key, order)
    every = new if table is None else table.unionByName(new, allowMissingColumns=True)
    columns = [c for c in every.columns if c not in (key, _AT)]
    last = [F.max_by(c, F.col(f"{_AT}.{c}")).alias(c) for c in columns]
    when = F.struct(*[F.max(F.col(f"{_AT}.{c}")).alias(c) for c in columns]).alias(_AT)
    return every.groupBy(key).agg(*last, when)


def shown(table: DataFrame) -> DataFrame:
    """A table of ``folded`` without its memory."""
    return table.drop(_AT)


def lookup(frontier: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return frontier.join(store, key, "left")


def unseen(frontier: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return frontier.join(store.select(key), key, "left_anti")


def _first(df: DataFrame, match: Column, order: Sequence[str]) -> DataFrame:
    """``df`` with boolean __first: is the row the first match by ``order``, nulls first?

    The first match is found by a top-1 over matches, one candidate a task, and found again by
    its order and a number of the row; of rows that are wholly alike one is meant.
    """
    numbered = df.withColumn("__no", F.monotonically_increasing_id())
    best = numbered.where(match).orderBy(*[F.col(c).asc_nulls_first() for c in order], *[F.col(c) for c in df.columns if _sortable(df, c)]).limit(1)
    one = best.select(*[F.col(c).alias(f"__is_{c}") for c in df.columns if _sortable(df, c)]).withColumn("__hit", F.lit(True))
    same = F.lit(True)
    for c in df.columns:
        if _sortable(df, c):
            same = same & F.col(c).eqNullSafe(F.col(f"__is_{c}"))
    # one row is sent
    joined = numbered.join(F.broadcast(one), same & match, "left").drop(*[c for c in one.columns if c != "__hit"])
    alike = joined.where("__hit").agg(F.min("__no").alias("__least"))  # rows that are wholly alike: the least number
    return joined.crossJoin(F.broadcast(alike)).withColumn("__first", F.coalesce(F.col("__hit") & (F.col("__no") == F.col("__least")), F.lit(False))).drop("__no", "__hit", "__least")


def _sortable(df: DataFrame, name: str) -> bool:
    return "map<" not in df.schema[name].dataType.simpleString() and "variant" not in df.schema[name].dataType.simpleString()


def remove(df: DataFrame, condition: Column, just_one: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Rows that do not match; with ``just_one`` only the first match by ``order`` (nulls first) goes."""
    match = F.coalesce(condition, F.lit(False))
    if not just_one:
        return df.where(~match)
    return _first(df, match, order).where("not __first").drop("__first")


def update(df: DataFrame, condition: Column, values: dict[str, Column], multi: bool = True, order: Sequence[str] = (), insert: dict | None = None) -> DataFrame:
    """Matching rows (all, or the first by ``order``) with new ``values``.

    A value None unsets its column.  Where nothing matches, a row of ``insert`` is added (the
    upsert form; columns that it lacks are null).
    """
    match = F.coalesce(condition, F.lit(False))
    kinds = {f.name: f.dataType for f in df.schema}
    rows = df.withColumn("__hit", match) if multi else _first(df, match, order).withColumnRenamed("__first", "__hit")
    new = {c: F.when(F.col("__hit"), F.lit(None).cast(kinds[c]) if v is None else v).otherwise(F.col(c)) for c, v in values.items()}
    out = rows.withColumns(new).drop("__hit")
    if insert is None:
        return out
    one = df.sparkSession.range(1).select(*[F.lit(insert.get(c)).cast(k).alias(c) for c, k in kinds.items()])
    found = df.where(match).limit(1).select(F.lit(1).alias("__found"))  # at most one row is sent
    return out.unionByName(one.join(F.broadcast(found), F.lit(True), "left_anti"))


def replace(df: DataFrame, condition: Column, row: dict, key: str, order: Sequence[str] = ()) -> DataFrame:
    """The first match as ``row``: all columns but ``key`` are replaced, those that it lacks are unset."""
    values = {c: None if row.get(c) is None else F.lit(row[c]).cast(df.schema[c].dataType) for c in df.columns if c != key}
    return update(df, condition, values, multi=False, order=order or [key])


def unset(df: DataFrame, *columns: str) -> DataFrame:
    """All rows without these fields; a dotted name is a field of a struct."""
    for c in columns:
        top, _, rest = c.partition(".")
        df = df.withColumn(top, F.col(top).dropFields(rest)) if rest else df.drop(c)
    return df


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Fields under new names; a field that already has the new name is replaced."""
    return df.drop(*[n for n in names.values() if n in df.columns and n not in names]).withColumnsRenamed(names)


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The table and new rows; fields that either lacks are null."""
    return df.unionByName(rows, allowMissingColumns=True)


def duplicated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that several rows have (an index that is to be unique has none)."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def indexed(df: DataFrame, name: str, *key: str, buckets: int = 64) -> None:
    """Save as a table bucketed and sorted by ``key``, so that joins and lookups on it don't shuffle."""
    df.write.bucketBy(buckets, *key).sortBy(*key).mode("overwrite").saveAsTable(name)


def capped(df: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """The last ``rows`` rows by ``order``: a top-k, not a global sort."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(rows)


def has_flag(flags: Column, name: str) -> Column:
    return F.coalesce(flags.bitwiseAND(1 << FLAGS[name]) != 0, F.lit(False))


# update modifiers, by column


def inc(c: Column, by) -> Column:
    return F.coalesce(c, F.lit(0)) + F.lit(by)


def push(c: Column, *values) -> Column:
    return F.concat(F.coalesce(c, F.array()), F.array(*[F.lit(v) for v in values]))


def pull(c: Column, *values) -> Column:
    return F.filter(c, lambda x: ~x.isin(*values))


def pop_end(c: Column, first: bool = False) -> Column:
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.slice(c, 2, n) if first else F.slice(c, 1, n)


def add_to_set(c: Column, value) -> Column:
    return F.when(F.coalesce(F.array_contains(c, value), F.lit(False)), c).otherwise(push(c, value))


def pull_where(c: Column, test) -> Column:
    """Without the elements for which ``test`` (Column to Column) holds."""
    return F.filter(c, lambda x: ~F.coalesce(test(x), F.lit(False)))


def bit(c: Column, and_: int | None = None, or_: int | None = None) -> Column:
    c = c if and_ is None else c.bitwiseAND(and_)
    return c if or_ is None else c.bitwiseOR(or_)
