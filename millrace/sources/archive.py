"""Blobs in chunks, and keyed blobs sharded by SHA-1, over Spark's own file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.text import shard_path


def files(spark: SparkSession, path: str, extension: str = r"\.\w{3}$") -> DataFrame:
    """Files below ``path`` whose name ends in three word characters after a dot."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(extension))


def chunked(blobs: DataFrame, key: str, content: str, size: int = 262_144) -> DataFrame:
    """(key, n, data): content in slices of ``size`` bytes."""
    last = F.greatest(F.ceil(F.octet_length(content) / size) - 1, F.lit(0))
    rows = blobs.select(key, content, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("n"))
    return rows.select(key, "n", F.expr(f"substring({content}, cast(n * {size} + 1 as int), {size})").alias("data"))


def assembled(chunks: DataFrame, key: str) -> DataFrame:
    """(key, content) of ``chunked`` rows; a blob's chunks meet in one task, as the blob does."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("n", "data"))), lambda x: x["data"])
    return chunks.groupBy(key).agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("content"))


def sharded(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with where each is kept; write with partitionBy("shard")."""
    return rows.withColumn("path", shard_path(F.col(key))).withColumn("shard", F.substring(F.sha1(F.col(key).cast("binary")), 1, 2))


def listed(chunks: DataFrame, key: str) -> DataFrame:
    """(key, chunks, bytes) of every blob, without its content."""
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.sum(F.octet_length("data")).cast("long").alias("bytes"))


def removed(chunks: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The chunks without those of ``keys``."""
    return chunks.join(keys.select(key), key, "left_anti")
