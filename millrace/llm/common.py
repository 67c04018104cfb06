"""Shared pieces: the scratch folder, written tables, reading the inputs; Arrow batches in slices come from ``functions.batches``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.batches import in_slices, release, slices  # noqa: F401

#: White space as the contracts define it, as the inside of a regex class.
SPACES = r"\x20\x09-\x0D"


def scratch(spark: SparkSession) -> str:
    """A fresh folder path under ``spark.checkpoint.dir``.

    The cluster names that folder because the driver and all executors share it.  Only in a
    local session, where one machine is all there is, a temporary folder stands in for an
    unset one; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith(("local[", "local ")) and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def written(df: DataFrame, *done: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; a folder for each value of ``by``.

    This cuts lineage, fixes what is computed once, and survives lost executors.  After that
    the written tables ``done``, which nothing reads any more, are deleted.
    """
    path = scratch(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    dropped(*done)
    return out


def dropped(*done: DataFrame) -> None:
    """Delete the files of tables made by ``written``; others are left alone."""
    for df in done:
        if path := df.__dict__.get("_scratch_path"):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(df: DataFrame) -> int:
    """The session's shuffle partition count, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
