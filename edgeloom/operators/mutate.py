"""Inserting, deleting and verifying batches of edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.model import Graph, distinct_edges, edge_columns, endpoints, mirror, within

KEY = ["src", "dst"]


def stored_form(graph: Graph, batch: DataFrame) -> DataFrame:
    """The batch as the graph stores it: both directions if undirected, with an order of arrival."""
    rows = batch.where("src is not null and dst is not null")
    if "pos" not in rows.columns:
        rows = rows.withColumn("pos", F.lit(0).cast("bigint"))
    rows = rows.select(*edge_columns(graph.weighted), "pos")
    return rows.withColumn("side", F.lit(0)) if graph.directed else mirror(rows)


def batch_edges(graph: Graph, batch: DataFrame) -> DataFrame:
    """The distinct edges of a batch, of weighted ones the first by ``pos``."""
    return distinct_edges(within(stored_form(graph, batch), graph.given), graph.weighted, ["pos", "side"] + ["weight"] * graph.weighted)


def insert_edges(graph: Graph, batch: DataFrame, dedup: bool = True) -> Graph:
    """The graph with the batch's edges; a stored edge keeps its weight, in a batch the first ``pos`` wins.

    With dedup=False parallel edges are allowed.  Endpoints are registered; an id
    outside a given capacity fails, a capacity that isn't given grows.
    """
    rows = within(stored_form(graph, batch), graph.given)
    columns = edge_columns(graph.weighted)
    if dedup:
        new = batch_edges(graph, batch)
        new = new.join(graph.edges.select(*KEY), KEY, "left_anti").select(*columns)
    else:
        new = rows.select(*columns)
    return graph.with_edges(graph.edges.select(*columns).unionByName(new), register(graph.vertices, endpoints(rows)))


def upsert_edges(graph: Graph, batch: DataFrame) -> Graph:
    """As ``insert_edges``, but the last weight wins, over stored ones too."""
    rows = within(stored_form(graph, batch), graph.given)
    new = rows.groupBy(*KEY).agg(F.max_by("weight", F.struct("pos", "side", "weight")).alias("weight"))
    kept = graph.edges.join(new.select(*KEY), KEY, "left_anti")
    return graph.with_edges(kept.select("src", "dst", "weight").unionByName(new), register(graph.vertices, endpoints(rows)))


def batch_keys(graph: Graph, batch: DataFrame) -> DataFrame:
    """The distinct (src, dst) of a batch, as stored."""
    return stored_form(Graph(graph.edges, graph.vertices, graph.given, graph.directed), batch).select(*KEY).distinct()


def delete_edges(graph: Graph, victims: DataFrame) -> Graph:
    """The graph without the victims; vertices stay, unknown victims change nothing."""
    rows = batch_keys(graph, victims)
    return graph.with_edges(graph.edges.join(rows, KEY, "left_anti").select(*edge_columns(graph.weighted)))


def register(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    """Get-or-create: all ids of both, once."""
    return vertices.select("id").unionByName(ids.select("id")).distinct()


def missing_after_ingest(graph: Graph, batch: DataFrame) -> DataFrame:
    """Edges of an ingested batch that cannot be found; empty if the ingest is right."""
    return batch_keys(graph, batch).join(graph.edges, KEY, "left_anti")


def present_after_delete(graph: Graph, batch: DataFrame) -> DataFrame:
    """Edges of a deleted batch that can still be found; empty if the deletion is right."""
    return batch_keys(graph, batch).join(graph.edges, KEY, "left_semi")


@dataclass(frozen=True)
class BatchStats:
    """What a batch asked for, what it changed, and its seconds."""

    batch: int
    attempted: int
    changed: int
    seconds: float


@dataclass(frozen=True)
class Throughput:
    batches: int
    attempted: int
    changed: int
    seconds: float
    edges_per_second: float


def throughput(stats: list[BatchStats]) -> Throughput:
    """Totals over all batches; edges per second counts the attempted ones."""
    tried, seconds = sum(x.attempted for x in stats), sum(x.seconds for x in stats)
    return Throughput(len(stats), tried, sum(x.changed for x in stats), seconds, tried / seconds if seconds else 0.0)


def batch_ids(raw: DataFrame, batch_size: int, directed: bool, num_batches: int | None = None) -> DataFrame:
    """Adds ``batch_id``: consecutive rows that store at least ``batch_size`` edges together; the last of ``num_batches`` takes all that is left.

    raw has gapless pos from 0.
    """
    per_row = 1 if directed else 2
    number = F.floor(F.col("pos") / max(1, -(-batch_size // per_row)))
    return raw.withColumn("batch_id", number if num_batches is None else F.least(number, F.lit(num_batches - 1).cast("bigint")))


def batch_stats(raw: DataFrame, batch_size: int, directed: bool, num_batches: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(batch_id, attempted, inserted) of ingesting ``raw`` batch by batch, in one pass.

    An edge is inserted by the batch that brings it first, unless it is ``stored`` (src, dst) before.
    """
    rows = batch_ids(raw, batch_size, directed, num_batches)
    rows = rows.select("src", "dst", "batch_id") if directed else mirror(rows.select("src", "dst", "batch_id")).drop("side")
    firsts = rows.groupBy(*KEY).agg(F.min("batch_id").alias("batch_id"))
    if stored is not None:
        firsts = firsts.join(stored, KEY, "left_anti")
    return _per_batch(rows, firsts).withColumnRenamed("changed", "inserted")


def batch_removals(raw: DataFrame, batch_size: int, directed: bool, stored: DataFrame, num_batches: int | None = None) -> DataFrame:
    """(batch_id, attempted, removed) of deleting ``raw`` batch by batch from the ``stored`` edges, in one pass."""
    rows = batch_ids(raw, batch_size, directed, num_batches)
    rows = rows.select("src", "dst", "batch_id") if directed else mirror(rows.select("src", "dst", "batch_id")).drop("side")
    firsts = rows.groupBy(*KEY).agg(F.min("batch_id").alias("batch_id")).join(stored, KEY, "left_semi")
    return _per_batch(rows, firsts).withColumnRenamed("changed", "removed")


def _per_batch(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    changed = firsts.groupBy("batch_id").agg(F.count("*").alias("changed"))
    tried = rows.groupBy("batch_id").agg(F.count("*").alias("attempted"))
    return tried.join(changed, "batch_id", "left").select("batch_id", "attempted", F.coalesce("changed", F.lit(0)).alias("changed"))
