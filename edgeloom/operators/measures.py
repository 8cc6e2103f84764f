"""Hop counts, degree statistics and the degree histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.model import Graph
from edgeloom.operators.access import degrees

#: Degrees to a bucket, and buckets a report shows.
WIDTH, SHOWN = 16, 100


def _out(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("src").agg(F.count("*").alias("degree"))


def one_hop(graph: Graph, ids: DataFrame) -> DataFrame:
    """(n): neighbours of all query vertices, summed."""
    asked = ids.select(F.col("id").alias("src")).distinct()
    return _out(graph).join(asked, "src", "left_semi").agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("n"))


def two_hop(graph: Graph, ids: DataFrame) -> DataFrame:
    """(n): paths of two edges from the query vertices, ways back included.

    A path's second step is counted, not walked: each first edge adds its end's out-degree.
    """
    asked = ids.select(F.col("id").alias("src")).distinct()
    ends = graph.edges.join(asked, "src", "left_semi").groupBy("dst").agg(F.count("*").alias("ways"))
    return ends.join(_out(graph).withColumnRenamed("src", "dst"), "dst").agg(F.coalesce(F.sum(F.col("ways") * F.col("degree")), F.lit(0)).alias("n"))


def two_hop_by_vertex(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id, n): paths of two edges from each query vertex."""
    asked = ids.select(F.col("id").alias("src")).distinct()
    steps = graph.edges.join(asked, "src", "left_semi").join(_out(graph).withColumnRenamed("src", "dst"), "dst")
    counts = steps.groupBy("src").agg(F.sum("degree").alias("n"))
    return asked.join(counts, "src", "left").select(F.col("src").alias("id"), F.coalesce("n", F.lit(0)).alias("n"))


def degree_stats(graph: Graph) -> DataFrame:
    """(max_degree, avg_nonempty, avg_all, num_empty, num_nonempty); averages are whole numbers, rounded down."""
    total = F.coalesce(F.sum("degree"), F.lit(0))
    some = F.count("*")
    row = _out(graph).agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), total.alias("total"), some.alias("num_nonempty"))
    avg = lambda n: F.when(n > 0, F.floor(F.col("total") / n)).otherwise(0).cast("bigint")
    cap = F.lit(graph.capacity)
    return row.select("max_degree", avg(F.col("num_nonempty")).alias("avg_nonempty"), avg(cap).alias("avg_all"), (cap - F.col("num_nonempty")).cast("bigint").alias("num_empty"), "num_nonempty")


def degree_histogram(graph: Graph, shown: int = SHOWN) -> DataFrame:
    """(bucket, low, high, n, cumulative_pct) of non-empty vertices, the first ``shown`` buckets present.

    Bucket b holds degrees 16b+1 to 16(b+1).  The running share starts from the empty vertices and is of the capacity.
    """
    counts = _out(graph).groupBy(F.floor((F.col("degree") - 1) / WIDTH).alias("bucket")).agg(F.count("*").alias("n"))
    some = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("some"))
    running = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = counts.join(F.broadcast(some)).withColumn("seen", running + F.lit(graph.capacity) - F.col("some"))
    pct = F.round(F.col("seen") * 100.0 / F.lit(graph.capacity), 4)
    return rows.select("bucket", (F.col("bucket") * WIDTH + 1).alias("low"), ((F.col("bucket") + 1) * WIDTH).alias("high"), "n", pct.alias("cumulative_pct")).orderBy("bucket").limit(shown)


def neighbor_id_sum(graph: Graph) -> DataFrame:
    """(src, total): the sum of each vertex's neighbour ids."""
    return graph.edges.groupBy("src").agg(F.sum("dst").alias("total"))


def sample_vertices(graph: Graph, k: int, seed: int) -> DataFrame:
    """k distinct vertices with an out-edge (all of them if there are fewer), drawn by the MD5 of id and seed: a top-k, no sort of all."""
    some = graph.edges.select(F.col("src").alias("id")).distinct()
    return some.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(k)


def non_empty(graph: Graph) -> DataFrame:
    return degrees(graph).where("degree > 0").select("id")
