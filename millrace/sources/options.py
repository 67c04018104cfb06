"""Crawl options from a mapping or the session, and what the session's catalog holds."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Options:
    """Defaults are the documented ones."""

    namespace: str = "crawl"
    parallel: int = 20
    agent: str = "millrace"
    largest_body: int = 1_048_576
    most_redirects: int = 5
    tick_seconds: int = 5

    @classmethod
    def of(cls, values: Mapping[str, object] | SparkSession) -> Options:
        """From a mapping, or from the session's settings named millrace.<option>; unknown names are errors."""
        if isinstance(values, SparkSession):
            values = {f.name: v for f in fields(cls) if (v := values.conf.get(f"millrace.{f.name}", None)) is not None}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := set(values) - set(kinds):
            raise ValueError(f"unknown options {sorted(unknown)}")
        return cls(**{k: kinds[k](v) for k, v in values.items()})


def listing(spark: SparkSession) -> DataFrame:
    """(database, table, column, type) of all tables of the catalog."""
    rows = []
    for db in spark.catalog.listDatabases():
        for t in spark.catalog.listTables(db.name):
            where = f"{db.name}.{t.name}" if t.namespace else t.name
            rows += [(db.name, t.name, c.name, c.dataType) for c in spark.catalog.listColumns(where)]
    return spark.createDataFrame(rows, "database string, `table` string, `column` string, type string")
