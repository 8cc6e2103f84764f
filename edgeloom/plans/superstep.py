"""Frontier-style supersteps: edge_map, vertex_map and the loop around them.

A frontier is a DataFrame of ids, with whatever state its messages need.  The
driver loop issues one job per superstep: the step's new rows are written below
the shared checkpoint folder and counted while they are written, so lineage stays
one step long and a lost executor costs no more than the step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from edgeloom.model import Graph
from edgeloom.plans.lineage import new_path


def edge_map(graph: Graph, frontier: DataFrame, combine: dict[str, Column], settled: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """Messages along the edges that leave the frontier, combined by receiver.

    frontier: (id, ...); combine: result columns as aggregates over its columns,
    ``src``, ``dst`` and ``weight``.  Receivers in ``settled`` (id) are left out
    before the aggregate (the ``cond`` of a functor).  Returns (id, ...).  Whether
    the frontier is broadcast or both sides are shuffled is AQE's choice, by size.
    """
    source, target = ("dst", "src") if reverse else ("src", "dst")
    sent = graph.edges.join(frontier.withColumnRenamed("id", source), source)
    if settled is not None:
        sent = sent.join(settled.select(F.col("id").alias(target)), target, "left_anti")
    return sent.groupBy(F.col(target).alias("id")).agg(*[c.alias(k) for k, c in combine.items()])


def vertex_map(vertices: DataFrame, columns: dict[str, Column] | None = None, keep: Column | None = None) -> DataFrame:
    """New columns on a vertex set, and the rows of it for which ``keep`` holds."""
    out = vertices.withColumns(columns) if columns else vertices
    return out if keep is None else out.where(keep)


def frontier_of(spark: SparkSession, ids: Iterable[int]) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id bigint")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both frontiers' ids, once."""
    return a.select("id").unionByName(b.select("id")).distinct()


#: Steps whose rows are kept apart before they are written together.
APART = 12


class Steps:
    """The rows each superstep added, kept as a growing table of the shared folder.

    A step's rows are listed once, when they are written; after APART steps the
    older ones are written together, through ``merge``, so plans stay short and rows
    that later ones supersede can go.
    """

    def __init__(self, spark: SparkSession, name: str, merge: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.n, self.frames, self.merge = spark, new_path(spark, name), 0, [], merge or (lambda rows: rows)

    def _write(self, rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        seen = Observation()
        rows.observe(seen, F.count("*").alias("n")).write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}"), seen.get["n"]

    def add(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """Write a step's rows; returns them read back, and their number."""
        made, count = self._write(rows, f"{self.n}")
        self.n += 1
        if len(self.frames) == APART:
            self.frames = [self._write(self.merge(self.all()), f"to-{self.n}")[0]]
        self.frames.append(made)
        return made, count

    def all(self) -> DataFrame:
        """The rows of all steps so far."""
        return reduce(DataFrame.unionAll, self.frames)


def supersteps(first: DataFrame, step: Callable[[DataFrame, Steps], DataFrame], name: str, stop: Callable[[Steps], bool] | None = None, merge: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Steps, bool]:
    """Run ``step`` on the newest rows until it adds none (True) or ``stop`` says so (False)."""
    steps = Steps(first.sparkSession, name, merge)
    now, n = steps.add(first)
    while n:
        if stop is not None and stop(steps):
            return steps, False
        now, n = steps.add(step(now, steps))
    return steps, True
