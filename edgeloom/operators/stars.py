"""Connected components by alternating large-star and small-star rounds.

Works on an edge frame (a, b) of bigint ids.  Every round is a grouped minimum
and an equi-join, so work spreads over the cluster: minima are combined map-side and
come back to the rows by node and a salt of the row, so a hub's rows spread over
``SALTS`` tasks whatever its degree.  The joins are merges at every size: a broadcast
for each of them, however small, piles up in the driver over the rounds.  The number of
rounds grows with the logarithm of the component diameter.  Every round's plan and jobs
cost the driver memory too, so up to ``FEW`` edges are joined by one task instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.plans.lineage import cut, discard


SALTS = 64
#: Edges (4 MB) up to which one task joins them.
FEW = 1 << 18


def _least_beside(rows: DataFrame) -> DataFrame:
    """``rows`` (a, b) with ``m``, the least b of all rows with the same a, without gathering these rows."""
    salted = rows.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    part = salted.groupBy("a", "s").agg(F.min("b").alias("least"))
    low = part.groupBy("a").agg(F.min("least").alias("m"))
    return salted.join(part.select("a", "s").join(low.hint("merge"), "a").hint("merge"), ["a", "s"]).drop("s")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _least_beside(both).withColumn("m", F.least("a", "m"))
    return low.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # A row with the least b stands for its node, every other one hangs its b below that.
    return _least_beside(down).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    """The edges from each node to the least one reachable, by one task.  Its function is a closure of libraries alone, so workers need no path to this package."""

    def run(rows: pa.Table) -> pa.Table:
        ids, ends = np.unique(np.concatenate([rows["a"].to_numpy(), rows["b"].to_numpy()]), return_inverse=True)
        x, y = np.split(ends, 2)
        label = np.arange(len(ids))
        while True:
            p, q = label[x], label[y]
            apart = p != q
            if not apart.any():
                break
            p, q = np.maximum(p[apart], q[apart]), np.minimum(p[apart], q[apart])
            np.minimum.at(label, p, q)
            while (label[label] != label).any():
                label = label[label]
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[moved], "b": ids[label[moved]]})

    return edges.groupBy().applyInArrow(run, "a bigint, b bigint")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node that has an edge; component is the least id reachable.

    Self loops and repeated edges are harmless; null endpoints are ignored.
    """
    clean = edges.select(F.col(edges.columns[0]).cast("bigint").alias("a"), F.col(edges.columns[1]).cast("bigint").alias("b"))
    loops = clean.where("a is not null and b is not null")
    now = cut(loops.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = _state(now)
    if 0 < before[0] <= FEW:
        then = cut(_at_once(now), "stars")
        discard(now)
        now, before = then, (0,)
    for _ in range(max_rounds):
        if not before[0]:
            break
        then = cut(_small_star(_large_star(now)), "stars")
        after = _state(then)
        discard(now)
        now, done, before = then, after == before, after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # The table behind the answer stays until the caller's plan has run.
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def component_least(nodes: DataFrame, labels: DataFrame, node: str, value: str, least: str, salts: int = 64) -> DataFrame:
    """``nodes`` with the least ``value`` of each one's component; a node without a label is alone.

    labels: (id, component) of ``components``.  The answer goes back by component
    and a salt of the node, so a component of very many nodes spreads over tasks.
    """
    met = nodes.join(labels.select(F.col("id").alias(node), "component").hint("merge"), node, "left")
    tied = met.where("component is not null").withColumn("salt", F.pmod(F.xxhash64(node), F.lit(salts)))
    lows = tied.groupBy("component").agg(F.min(value).alias(least))
    spread = tied.select("component", "salt").distinct().join(lows.hint("merge"), "component")
    back = tied.join(spread.hint("merge"), ["component", "salt"]).drop("component", "salt")
    return back.unionByName(met.where("component is null").drop("component").withColumn(least, F.col(value)))
