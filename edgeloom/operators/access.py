"""Point and batched lookups on a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.model import Graph


def has_edge(graph: Graph, src: int, dst: int) -> bool:
    """Is the edge stored?  Both ids are pushed to the scan."""
    return not graph.edges.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()


def has_edges(graph: Graph, pairs: DataFrame) -> DataFrame:
    """pairs (src, dst) with ``found``; an unknown endpoint means not found.

    A left join with distinct keys, so a pair asked for very often is never multiplied.
    """
    keys = graph.edges.select("src", "dst").distinct().withColumn("found", F.lit(True))
    return pairs.join(keys, ["src", "dst"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def has_vertex(graph: Graph, vertex: int) -> bool:
    return not graph.vertices.where(F.col("id") == vertex).isEmpty()


def has_vertices(graph: Graph, ids: DataFrame) -> DataFrame:
    """ids (id) with ``found``: is it registered?"""
    known = graph.vertices.select("id").distinct().withColumn("found", F.lit(True))
    return ids.join(known, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def neighbors(graph: Graph, vertex: int) -> DataFrame:
    """(dst[, weight]) of one vertex; none if it is unknown."""
    return graph.edges.where(F.col("src") == vertex).drop("src")


def neighbors_of(graph: Graph, ids: DataFrame) -> DataFrame:
    """Out-edges of a set of vertices (id)."""
    return graph.edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def adjacency_sorted(graph: Graph) -> DataFrame:
    """(src, neighbors): each vertex's distinct neighbours, ascending.

    One row holds all neighbours of a vertex; for vertices of unbounded degree read ``edges_sorted``.
    """
    return graph.edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("neighbors"))


def edges_sorted(graph: Graph) -> DataFrame:
    """All edges, ascending by source and neighbour, range-partitioned."""
    return graph.edges.orderBy("src", "dst")


def edge_weight(graph: Graph, src: int, dst: int) -> int:
    """The stored weight, 1 on an unweighted graph's edge, 0 if the edge is absent."""
    weight = F.col("weight") if graph.weighted else F.lit(1)
    return graph.edges.where((F.col("src") == src) & (F.col("dst") == dst)).agg(F.coalesce(F.max(weight), F.lit(0))).first()[0]


def edge_weights(graph: Graph, pairs: DataFrame) -> DataFrame:
    """pairs (src, dst) with ``weight``: the stored one, 1 on an unweighted graph's edge, 0 if the edge is absent."""
    weight = F.max("weight") if graph.weighted else F.lit(1)
    keys = graph.edges.groupBy("src", "dst").agg(weight.cast("int").alias("weight"))
    return pairs.join(keys, ["src", "dst"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def degrees(graph: Graph) -> DataFrame:
    """(id, degree): the out-degree of every registered vertex, 0 included."""
    out = graph.edges.groupBy("src").agg(F.count("*").alias("degree"))
    return graph.vertices.join(out, F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_of(graph: Graph, vertex: int) -> int:
    return graph.edges.where(F.col("src") == vertex).count()


def capacity_degrees(graph: Graph) -> DataFrame:
    """(id, degree) of every id under the capacity, seen or not."""
    every = graph.edges.sparkSession.range(graph.capacity)
    return every.join(degrees(graph), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
