"""Graphs drawn from the star-schema tables, for the registered queries and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.model import Graph, from_edges


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to parts of their large lines: sparse and deep.  Weighted by line number."""
    lines = read(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    rows = lines.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.col("l_linenumber").alias("weight"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"))


def raw_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts to suppliers: dense, many repeats."""
    return read(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.col("l_linenumber").alias("weight"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"))


def raw_p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to parts in one id space: directed, with sinks and self loops."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("weight"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"))


def raw_p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the user of an event to that of the next one: directed, with self loops.

    The next event is found within ranges of time; a range's last event takes the first of the ranges after it.
    """
    events = read(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = events.repartitionByRange(parts, "ts", "event_id").withColumn("part", F.spark_partition_id())
    heads = ranged.groupBy("part").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("head"))
    after = heads.select("part", F.lead("head.user_id").over(Window.orderBy("part")).alias("after"))
    within = F.lead("user_id").over(Window.partitionBy("part").orderBy("ts", "event_id"))
    rows = ranged.withColumn("next", within).join(F.broadcast(after), "part").withColumn("dst", F.coalesce("next", "after"))
    return rows.where("dst is not null").select(F.col("user_id").alias("src"), "dst", F.col("event_id").alias("pos"))


def raw_p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to their orders: a forest of stars."""
    return read(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"), F.col("o_orderkey").alias("pos"))


RAW = {"p1": raw_p1, "p2": raw_p2, "p3": raw_p3, "p4": raw_p4, "p5": raw_p5}
DIRECTED = {"p3", "p4"}


def graph(spark: SparkSession, sf_dir: str, name: str, weighted: bool = False) -> Graph:
    return from_edges(RAW[name](spark, sf_dir), directed=name in DIRECTED, weighted=weighted)


#: The same rows in SQL.
RAW_SQL = {
    "p1": "SELECT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst, l_linenumber AS weight, l_orderkey * 100 + l_linenumber AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49",
    "p2": "SELECT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst, l_linenumber AS weight, l_orderkey * 100 + l_linenumber AS pos FROM lineitem",
    "p3": "SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS weight, l_orderkey * 100 + l_linenumber AS pos FROM lineitem",
    "p4": "SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, 1 AS weight, event_id AS pos FROM events) WHERE dst IS NOT NULL",
    "p5": "SELECT o_custkey * 2 AS src, o_orderkey * 2 + 1 AS dst, 1 AS weight, o_orderkey AS pos FROM orders",
}


def ctes(name: str) -> str:
    """raw, both (as stored, repeats included), e (distinct edges), v (id, deg) and cap, as a WITH list."""
    both = "SELECT src, dst, weight, pos, 0 AS side FROM raw"
    if name not in DIRECTED:
        both += " UNION ALL SELECT dst, src, weight, pos, 1 FROM raw"
    return f"""raw AS ({RAW_SQL[name]}),
both_ways AS ({both}),
e AS (SELECT DISTINCT src, dst FROM both_ways),
ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
v AS (SELECT id, count(e.dst) AS deg FROM ids LEFT JOIN e ON e.src = id GROUP BY id),
cap AS (SELECT max(id) + 1 AS capacity FROM ids)"""
