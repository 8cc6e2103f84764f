"""Weakly connected components and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.model import Graph
from edgeloom.operators.access import degrees
from edgeloom.operators.stars import components
from edgeloom.plans.lineage import cut, discard

BASE, DAMPING = 0.15, 0.85
#: PageRank iterations between lineage cuts.
EVERY = 5


def cc_labels(graph: Graph) -> DataFrame:
    """(id, component) of every registered vertex; the label is the least id reachable, directions ignored."""
    found = components(graph.edges.select("src", "dst"))
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cc_count(graph: Graph) -> DataFrame:
    """(components, components_with_empty): among registered vertices, and with each id never seen as one more."""
    labels = cc_labels(graph).agg(F.count_distinct("component").alias("components"), F.count("*").alias("n"))
    return labels.select("components", (F.col("components") + F.lit(graph.capacity) - F.col("n")).alias("components_with_empty"))


def pagerank(graph: Graph, iterations: int = 10) -> DataFrame:
    """(id, rank, degree) of every registered vertex.

    Ranks are not normalised; what sinks hold is not handed on; the first push of a
    vertex is BASE undivided, later ones its rank over its out-degree.
    """
    if iterations < 1:
        raise ValueError("at least one iteration")
    nodes = cut(degrees(graph), "degrees")
    state, held = nodes.select("id", "degree", F.when(F.col("degree") > 0, BASE).otherwise(0.0).alias("push")), None
    for k in range(iterations):
        got = graph.edges.join(state.select(F.col("id").alias("src"), "push").where("push <> 0"), "src").groupBy("dst").agg(F.sum("push").alias("got"))
        rank = F.lit(BASE) + F.lit(DAMPING) * F.coalesce("got", F.lit(0.0))
        every = nodes.join(got, F.col("id") == F.col("dst"), "left")
        if k == iterations - 1:
            return every.select("id", rank.alias("rank"), "degree")
        state = every.select("id", "degree", F.when(F.col("degree") > 0, rank / F.col("degree")).otherwise(0.0).alias("push"))
        if k % EVERY == EVERY - 1:
            now = cut(state, "ranks")
            discard(held)
            state = held = now
    raise AssertionError("unreachable")


def pagerank_checksum(graph: Graph, iterations: int = 10) -> DataFrame:
    """(checksum): all ranks, and BASE more for each sink and each id never seen."""
    extra = F.count_if(F.col("degree") == 0) + F.lit(graph.capacity) - F.count("*")
    return pagerank(graph, iterations).agg((F.coalesce(F.sum("rank"), F.lit(0.0)) + BASE * extra).alias("checksum"))
