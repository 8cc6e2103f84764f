"""Breadth-first search and shortest paths, as supersteps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.model import Graph
from edgeloom.operators.access import has_vertex
from edgeloom.plans.lineage import cut, discard
from edgeloom.plans.superstep import Steps, edge_map, supersteps

#: Distances from this on count as unreached.
FAR = 1_000_000


def bfs(graph: Graph, source: int) -> DataFrame:
    """(id, depth, parent) of every vertex reached; the source has depth 0 and is its own parent.

    Of several possible parents the least id is taken.
    """
    if not has_vertex(graph, source):
        raise ValueError(f"vertex {source} is not in the graph")
    spark = graph.edges.sparkSession
    first = spark.createDataFrame([(source, 0, source)], "id bigint, depth int, parent bigint")

    def step(now: DataFrame, steps: Steps) -> DataFrame:
        found = edge_map(graph, now.select("id", "depth"), {"depth": F.min("depth") + 1, "parent": F.min("src")}, settled=steps.all())
        return found.select("id", F.col("depth").cast("int").alias("depth"), "parent")

    steps, _ = supersteps(first, step, "bfs")
    return steps.all()


def frontier_sizes(graph: Graph, source: int) -> DataFrame:
    """(depth, n): how many vertices each step of the search reaches."""
    return bfs(graph, source).groupBy("depth").agg(F.count("*").alias("n"))


def bfs_depth_sum(graph: Graph, sources: list[int]) -> DataFrame:
    """(source, depth_sum, reached) of a search from each source."""
    spark = graph.edges.sparkSession
    rows = [(s, *bfs(graph, s).agg(F.sum("depth"), F.count("*")).first()) for s in sources]
    return spark.createDataFrame(rows, "source bigint, depth_sum bigint, reached bigint")


def sssp(graph: Graph, source: int, unit: bool = False) -> tuple[DataFrame, bool]:
    """((id, dist) of every vertex reached, is there a negative cycle).

    Frontier Bellman-Ford: only vertices whose distance fell send messages.  Each keeps
    the vertex its distance came from; among these links there is a cycle only where
    the graph has a negative one, and they are looked at after 8, 16, 32, ... rounds.
    Distances that still fall after as many rounds as there are vertices tell of one too.
    With a negative cycle distances are meaningless.  An unweighted graph's edges weigh 1.
    """
    if not has_vertex(graph, source):
        raise ValueError(f"vertex {source} is not in the graph")
    spark = graph.edges.sparkSession
    weighted = graph.weighted and not unit
    weight = F.coalesce("weight", F.lit(1)) if weighted else F.lit(1)
    first = spark.createDataFrame([(source, 0, None)], "id bigint, dist bigint, via bigint")
    sent = F.min(F.struct((F.col("dist") + weight).alias("dist"), F.col("src").alias("via"))).alias("sent")

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.min(F.struct("dist", "via")).alias("low")).select("id", "low.dist", "low.via")

    def step(now: DataFrame, steps: Steps) -> DataFrame:
        known = least(steps.all()).select("id", F.col("dist").alias("known"))
        found = edge_map(graph, now.select("id", "dist"), {"sent": sent}).select("id", "sent.*")
        return found.join(known, "id", "left").where(F.col("known").isNull() | (F.col("dist") < F.col("known"))).select("id", "dist", "via")

    most = graph.count_vertices() if weighted else 0

    def cyclic(steps: Steps) -> bool:
        return steps.n > most or (steps.n >= 8 and steps.n & (steps.n - 1) == 0 and has_cycle(least(steps.all()).select("id", "via")))

    steps, settled = supersteps(first, step, "sssp", stop=cyclic if weighted else None, merge=least)
    return least(steps.all()).select("id", "dist"), not settled


def has_cycle(links: DataFrame) -> bool:
    """Do any of the links (id, via), one for each id, lead back to where they start?

    Every link is made twice as long in each round, and those that have come to an end
    go: a link that is left when it is longer than there are ids is in or before a cycle.
    """
    now, length = cut(links.where("via is not null"), "links"), 1
    ids = left = now.count()
    while left and length <= ids:
        ahead = now.select(F.col("id").alias("via"), F.col("via").alias("far"))
        then = cut(now.join(ahead, "via").select("id", F.col("far").alias("via")), "links")
        discard(now)
        now, left, length = then, then.count(), 2 * length
    discard(now)
    return left > 0


def sssp_dist_sum(graph: Graph, source: int) -> DataFrame:
    """(dist_sum, negative_cycle): the sum of distances under FAR, -1 with a negative cycle."""
    dist, cycle = sssp(graph, source)
    near = dist.where(F.col("dist") < FAR).agg(F.coalesce(F.sum("dist"), F.lit(0)).alias("s"))
    return near.select(F.when(F.lit(cycle), -1).otherwise(F.col("s")).cast("bigint").alias("dist_sum"), F.lit(cycle).alias("negative_cycle"))


def dijkstra(graph: Graph, source: int) -> DataFrame:
    """(id, dist); same distances as ``sssp`` and refused where a weight is negative."""
    if graph.weighted and not graph.edges.where("weight < 0").isEmpty():
        raise ValueError("Dijkstra needs weights that are not negative")
    return sssp(graph, source)[0]
