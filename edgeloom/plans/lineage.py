"""Cutting lineage with tables in the cluster's shared checkpoint folder.

Executors may be lost at any time, so nothing here relies on blocks that live on
one machine.  ``cut`` writes a Parquet table below ``spark.checkpoint.dir`` and
reads it back; the plan above it starts from files every executor can see.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; where none is set, the warehouse, which driver and executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/edgeloom-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, what)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._edgeloom_path = path  # type: ignore[attr-defined]
    return out


def discard(what: DataFrame | str | None, spark: SparkSession | None = None) -> None:
    """Delete the files behind a frame made by ``cut``, or a folder of ``new_path``; a frame from elsewhere is left alone."""
    path = what if isinstance(what, str) else getattr(what, "_edgeloom_path", None)
    if path:
        spark = spark or what.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
