"""The graph model: a deduplicated directed edge table and its registered vertices.

Ids are bigint and external throughout; no dense renumbering is needed.  An
undirected graph stores each edge in both directions.  ``capacity`` is the number
of ids that could exist: ids never seen still count as components, as empty vertices
and in the PageRank checksum.  A capacity that is given is fixed, and inserting an id
beyond it fails; else it is the largest id + 1, counted when it is first asked for,
and so grows with every insert.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
WEIGHTED_EDGES = T.StructType([*EDGES.fields, T.StructField("weight", T.IntegerType())])
VERTICES = T.StructType([T.StructField("id", T.LongType())])


@dataclass(frozen=True)
class GraphSpec:
    """How an edge source is read: its direction, weights, first id and capacity."""

    name: str
    directed: bool = False
    weighted: bool = False
    id_base: int = 0
    capacity: int | None = None


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    vertices: DataFrame
    given: int | None = None
    directed: bool = True
    weighted: bool = False

    @cached_property
    def capacity(self) -> int:
        if self.given is not None:
            return self.given
        largest = self.vertices.agg(F.max("id")).first()[0]
        return 0 if largest is None else largest + 1

    def with_edges(self, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        return replace(self, edges=edges, vertices=self.vertices if vertices is None else vertices)

    def count_vertices(self) -> int:
        return self.vertices.count()

    def persist(self, partitions: int | None = None) -> Graph:
        """Edges hash-partitioned by source and kept, for supersteps; lost blocks are recomputed."""
        by = [F.col("src")] if partitions is None else [partitions, F.col("src")]
        return replace(self, edges=self.edges.repartition(*by).persist(), vertices=self.vertices.persist())

    def unpersist(self) -> None:
        self.edges.unpersist()
        self.vertices.unpersist()


def edge_columns(weighted: bool) -> list[str]:
    return ["src", "dst", "weight"] if weighted else ["src", "dst"]


def mirror(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, from one scan; other columns go with both."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    both = F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("d"), F.lit(0).alias("side")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"), F.lit(1).alias("side")))
    out = edges.select(F.explode(both).alias("e"), *others)
    return out.select(F.col("e.s").alias("src"), F.col("e.d").alias("dst"), *others, F.col("e.side").alias("side"))


def distinct_edges(edges: DataFrame, weighted: bool, order: list[str]) -> DataFrame:
    """Set semantics: one row per (src, dst); of weighted rows the first in ``order`` wins.

    An aggregate, not a window: a pair that comes very often is reduced map-side.
    """
    if not weighted:
        return edges.select("src", "dst").distinct()
    return edges.groupBy("src", "dst").agg(F.min_by("weight", F.struct(*order)).alias("weight"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def from_edges(raw: DataFrame, directed: bool = True, weighted: bool = False, capacity: int | None = None, dedup: bool = True) -> Graph:
    """A graph from (src, dst[, weight][, pos]) rows; ``pos`` is the arrival order that decides which weight is first.

    Rows with a null endpoint are dropped.  Without ``pos`` equal pairs keep their least weight.
    """
    rows = raw.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    order = ["pos"] if "pos" in raw.columns else ["weight"]
    rows = rows.select(*edge_columns(weighted), *(["pos"] if weighted and "pos" in raw.columns else []))
    if not directed:
        rows = mirror(rows)
        order = [*order, "side"]
    elif weighted:
        rows = rows.withColumn("side", F.lit(0))
    edges = distinct_edges(rows, weighted, order) if dedup else rows.select(*edge_columns(weighted))
    return Graph(edges, endpoints(edges), capacity, directed, weighted)


def within(rows: DataFrame, capacity: int | None) -> DataFrame:
    """The same (src, dst, ...) rows; reading one with an id that a given capacity has no room for fails."""
    if capacity is None:
        return rows
    fault = lambda c: F.raise_error(F.concat(F.lit("id "), F.col(c).cast("string"), F.lit(f" is outside the capacity of {capacity}"))).cast("bigint")
    return rows.withColumns({c: F.when(F.col(c).between(0, capacity - 1), F.col(c)).otherwise(fault(c)) for c in ("src", "dst")})


def check_capacity(graph: Graph) -> Graph:
    """The graph itself; raises if an id does not fit its capacity."""
    low, high = graph.vertices.agg(F.min("id"), F.max("id")).first()
    if high is not None and (high >= graph.capacity or low < 0):
        raise ValueError(f"ids run from {low} to {high}; the capacity is {graph.capacity}")
    return graph


def dense_ids(first_seen: DataFrame) -> DataFrame:
    """(id, dense) numbered from 0 in order of first appearance.  first_seen: (id, first_pos).

    Ranges of first_pos are numbered apart and offset by the sizes of the ranges
    before, so no single task sorts all vertices.
    """
    spark = first_seen.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = first_seen.repartitionByRange(parts, "first_pos", "id").withColumn("part", F.spark_partition_id())
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    ahead = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("first_pos", "id"))
    return ranged.withColumn("k", local).join(F.broadcast(ahead), "part").select("id", (F.col("ahead") + F.col("k") - 1).alias("dense"))


def first_seen(raw: DataFrame) -> DataFrame:
    """(id, first_pos): where an id first appears; of one row the destination is registered before the source."""
    ends = raw.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), (F.col("pos") * 2).alias("p")), F.struct(F.col("src").alias("id"), (F.col("pos") * 2 + 1).alias("p")))).alias("x"))
    return ends.groupBy(F.col("x.id").alias("id")).agg(F.min("x.p").alias("first_pos"))


def empty_graph(spark: SparkSession, capacity: int | None = None, directed: bool = True, weighted: bool = False) -> Graph:
    return Graph(spark.createDataFrame([], WEIGHTED_EDGES if weighted else EDGES), spark.createDataFrame([], VERTICES), capacity, directed, weighted)
