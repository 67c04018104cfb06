"""Document queries: a dictionary becomes a Column, so Catalyst plans and pushes it down."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


_FLAGS = {re.I: "i", re.M: "m", re.S: "s", re.X: "x"}


def _regex(c: Column, pattern: str | re.Pattern, options: str = "") -> Column:
    if isinstance(pattern, re.Pattern):
        pattern, options = pattern.pattern, options + "".join(o for f, o in _FLAGS.items() if pattern.flags & f)
    flags = "".join(o for o in "imsx" if o in options)
    test = c.rlike(f"(?{flags})" + pattern if flags else pattern)
    literal = re.match(r"\^([A-Za-z0-9_ #-]+)(?![*?+{|])", pattern)
    if literal and not flags and "|" not in pattern:  # a prefix that the scan can use
        prefix = literal[1] if literal.end() == len(pattern) or pattern[literal.end()] not in "*?+{" else literal[1][:-1]
        return c.startswith(prefix) & test if prefix else test
    return test


#: Type codes of document values, by Spark type (fixed values).
_TYPES = {1: T.DoubleType, 2: T.StringType, 3: T.StructType, 4: T.ArrayType, 5: T.BinaryType, 8: T.BooleanType, 9: T.TimestampType, 16: T.IntegerType, 18: T.LongType}
_COMPARE = {"$lt": "__lt__", "$lte": "__le__", "$gt": "__gt__", "$gte": "__ge__"}


def _class_of(x) -> str:
    """The class of a type or of a literal; values compare within their class only."""
    if isinstance(x, T.DataType):
        names = [(T.NumericType, "number"), (T.StringType, "string"), (T.BooleanType, "bool"), (T.BinaryType, "bytes"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "time")]
        return next((n for k, n in names if isinstance(x, k)), type(x).__name__)
    names = [(bool, "bool"), ((int, float, Decimal), "number"), (str, "string"), ((bytes, bytearray), "bytes"), (date, "time")]
    return next((n for k, n in names if isinstance(x, k)), type(x).__name__)


def _value(x: Column, kind: T.DataType, op: str, v, options: str = "") -> Column | None:
    """A single value ``x`` of type ``kind`` against one operator; None where the operator isn't of values."""
    like = _class_of(v) == _class_of(kind)
    if op == "$eq":
        return x == F.lit(v) if like else F.lit(False)
    if op in _COMPARE:
        return getattr(x, _COMPARE[op])(F.lit(v)) if like else F.lit(False)
    if op == "$in":
        plain = [y for y in v if not isinstance(y, re.Pattern) and y is not None and _class_of(y) == _class_of(kind)]
        p = x.isin(*plain) if plain else F.lit(False)
        if isinstance(kind, T.StringType):
            for r in v:
                p = p | _regex(x, r) if isinstance(r, re.Pattern) else p
        return p
    if op == "$mod":
        return x % F.lit(v[0]) == F.lit(v[1]) if isinstance(kind, T.NumericType) else F.lit(False)
    if op == "$regex":
        return _regex(x, v, options) if isinstance(kind, T.StringType) else F.lit(False)
    return None


def _operators(test) -> bool:
    return isinstance(test, Mapping) and any(k.startswith("$") for k in test)


def _test(c: Column, kind: T.DataType, test) -> Column:
    """``test`` on a column of type ``kind``; an array matches if any element does."""
    array = isinstance(kind, T.ArrayType)
    inner = kind.elementType if array else kind

    def any_(op: str, v, options: str = "") -> Column:
        if array:
            return _sure(F.exists(c, lambda x: _sure(_value(x, inner, op, v, options))))
        return _sure(_value(c, inner, op, v, options))

    if isinstance(test, re.Pattern):
        return any_("$regex", test)
    if not _operators(test):
        return c.isNull() if test is None else any_("$eq", test)
    out = F.lit(True)
    for op, v in test.items():
        if op in ("$options", "$maxDistance"):
            continue
        if op in ("$eq", "$mod", "$regex", *_COMPARE):
            p = any_(op, v, test.get("$options", ""))
        elif op == "$ne":
            p = c.isNotNull() if v is None else ~any_("$eq", v)
        elif op in ("$in", "$nin"):
            p = any_("$in", v) | c.isNull() if None in list(v) else any_("$in", v)
            p = ~p if op == "$nin" else p
        elif op == "$all":
            p = reduce(and_, (any_("$regex" if isinstance(x, re.Pattern) else "$eq", x) for x in v), F.lit(bool(v)))
        elif op == "$size":
            p = _sure(F.size(c) == v) if array else F.lit(False)
        elif op == "$exists":
            p = c.isNotNull() if v else c.isNull()
        elif op == "$type":
            p = c.isNull() if v in (6, 10) else (c.isNotNull() & F.lit(isinstance(kind, _TYPES.get(v, T.NullType))))
        elif op == "$elemMatch":
            p = _sure(F.exists(c, _element_test(inner, v))) if array else F.lit(False)
        elif op == "$not":
            p = ~_test(c, kind, v)
        elif op == "$within":
            p = _sure(_within(c, v))
        elif op == "$near":
            p = _sure(distance(c, v) <= F.lit(float(test["$maxDistance"]))) if "$maxDistance" in test else c.isNotNull()
        else:
            raise ValueError(f"unknown operator {op}")
        out = out & p
    return out


def _element_test(kind: T.DataType, test):
    return lambda x: _element(x, kind, test)


def _element(x: Column, kind: T.DataType, test) -> Column:
    """One array element against a query on its fields, or against operators."""
    if _operators(test) or not isinstance(test, Mapping):
        return _sure(_test(x, kind, test))
    return reduce(and_, (_sure(_test(x[k], kind[k].dataType, v)) for k, v in test.items()), F.lit(True))


def _within(c: Column, shape: Mapping) -> Column:
    if "$center" in shape:
        centre, radius = shape["$center"]
        return distance(c, centre) <= F.lit(float(radius))
    (x0, y0), (x1, y1) = shape["$box"]
    return F.element_at(c, 1).between(x0, x1) & F.element_at(c, 2).between(y0, y1)


def _field(df: DataFrame, name: str, test) -> Column:
    c = F.col(name)
    return _test(c, df.select(c.alias("x")).schema["x"].dataType, test)


def distance(point: Column, to: Sequence[float]) -> Column:
    """Planar distance of an array column (x, y)."""
    return F.sqrt(F.pow(F.element_at(point, 1) - to[0], 2) + F.pow(F.element_at(point, 2) - to[1], 2))


def condition(df: DataFrame, query: Mapping) -> Column:
    """The Column of a query document; missing values count as false before any negation.

    A value and an operand of different type classes (a number and a string) don't match.  Of
    empty lists, $and and $nor match all and $or matches none.
    """
    out = F.lit(True)
    for k, v in query.items():
        if k in ("$and", "$or", "$nor"):
            parts = [condition(df, q) for q in v]
            p = reduce(and_, parts, F.lit(True)) if k == "$and" else reduce(or_, parts, F.lit(False))
            p = ~p if k == "$nor" else p
        elif k == "$where":
            p = _sure(F.expr(v))
        else:
            p = _field(df, k, v)
        out = out & p
    return out


def find(
    df: DataFrame, query: Mapping | None = None, fields: Mapping | None = None, sort: Sequence[tuple[str, int]] = (), skip: int = 0, limit: int = 0, low: Mapping | None = None, high: Mapping | None = None
) -> DataFrame:
    """Filter, bounds (low inclusive, high exclusive), sort (nulls least), skip, limit (0: all; below 0: so many at most), projection.

    A $near without another sort sorts by distance.
    """
    out = df.where(condition(df, query or {})) if query else df
    for k, v in (low or {}).items():
        out = out.where(F.col(k) >= F.lit(v))
    for k, v in (high or {}).items():
        out = out.where(F.col(k) < F.lit(v))
    near = next(((k, v["$near"]) for k, v in (query or {}).items() if isinstance(v, Mapping) and "$near" in v), None)
    if near and not sort:
        out = out.orderBy(distance(F.col(near[0]), near[1]))
    if sort:
        out = out.orderBy(*[F.col(k).asc_nulls_first() if d > 0 else F.col(k).desc_nulls_last() for k, d in sort])
    if skip:
        out = out.offset(skip)
    if limit:
        out = out.limit(abs(limit))
    return project(out, fields) if fields else out


def project(df: DataFrame, fields: Mapping) -> DataFrame:
    """{name: 1} keeps, {name: 0} drops, {name: {"$slice": n or [skip, n]}} cuts an array."""
    sliced = {k: v["$slice"] for k, v in fields.items() if isinstance(v, Mapping)}
    for k, v in sliced.items():
        skip, n = (0, v) if isinstance(v, int) else v
        df = df.withColumn(k, F.slice(k, skip + 1, n) if n >= 0 else F.slice(k, n, -n))
    keep = [k for k, v in fields.items() if not isinstance(v, Mapping) and v]
    drop = [k for k, v in fields.items() if not isinstance(v, Mapping) and not v]
    return df.select(*keep, *[k for k in sliced if k not in keep]) if keep else df.drop(*drop)


def count(df: DataFrame, query: Mapping | None = None, limit: int = 0, skip: int = 0) -> DataFrame:
    return find(df, query, skip=skip, limit=limit).agg(F.count("*").alias("n"))


def map_reduce(df: DataFrame, key: Column, value: Column, reduce: str) -> DataFrame:
    """emit(key, value), then a known reducer (sum, min, max, count, avg) as a built-in aggregate."""
    return df.select(key.alias("_id"), value.alias("value")).groupBy("_id").agg(getattr(F, reduce)("value").alias("value"))


def reduce_into(old: DataFrame, new: DataFrame, reduce: str) -> DataFrame:
    """Results folded into earlier ones with the same reducer (sum, min or max)."""
    return old.unionByName(new).groupBy("_id").agg(getattr(F, reduce)("value").alias("value"))


def histogram(df: DataFrame, value: Column, start: float, width: float, buckets: int, exponential: bool = False) -> DataFrame:
    """(bucket, upper, n): upper bounds are inclusive; the last bucket is open."""
    uppers = [start + width * (2**i if exponential else i + 1) for i in range(buckets - 1)]
    b = F.lit(buckets - 1)
    for i in range(len(uppers) - 1, -1, -1):
        b = F.when(value <= uppers[i], F.lit(i)).otherwise(b)
    return df.where(value.isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
