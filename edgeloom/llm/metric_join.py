"""Embedding near-dedup: an exact metric range join over pivot cells.

Vectors are compared when they have the same (not null) label and the same length,
by cosine in double precision; on unit vectors cosine >= c is the metric range
query d <= r with r = sqrt(2 - 2c).  Equal vectors of a label are first made one,
with a count.  Of each label some vectors, drawn by hash, are pivots; every vector
lives in the cell of its nearest pivot p.  If d(x, y) <= r and y lives with q, then
d(x, q) <= d(y, q) + r <= d(y, p) + r <= d(x, p) + 2r: x is copied to all cells q
with d(x, q) - d(x, p) <= 2r, and as the metric is Euclidean only where x is within
r of the bisector of p and q.  So each cell holds all partners of the vectors that
live in it, and cells join independently of one another.

A cell is cut into blocks of bounded size (``HOME`` residents by ``RIGHT``
candidates), so neither a label with a third of all rows nor a dense cluster ends
up in one task.  A block counts the partners of its residents with matrix products
and sends no pairs: one count per resident and one edge per linked vector to the
root of its group within the block.  Star rounds join these edges into components.

In many dimensions most vectors lie near some bisector and cells overlap a lot;
the join is still exact, and its cost then tends to that of comparing all pairs of
a label, in blocks.

Vectors that are null, empty, zero or hold a null or non-finite component, and
vectors with a null label, link with nothing.  Rows that repeat a vec_id are
vectors of their own and link like others.  A null vec_id has a null component_id.
An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import ROWS, shipped
from edgeloom.operators.stars import SALTS, component_least, components
from edgeloom.plans.lineage import cut

#: Residents and candidates of a block; rows of a block compared at once.
HOME, RIGHT, STRIP = 2048, 8192, 256
#: Allowed for rounding: of a distance (a root, so that 1e-16 in its square is 1e-8 near 0), and of a cosine.
SLACK, CLOSE = 1e-7, 1e-9
#: Vectors that are placed into cells together, with one copy of their label's pivots.
PLACED = 1 << 15


def unit(vectors: list) -> np.ndarray:
    """Rows scaled to length one, in double precision and safe from overflow."""
    x = np.array(vectors, float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and whether the row is copied to each pivot's cell."""
    d2 = np.maximum(2 - 2 * x @ pivots.T, 0)
    home = d2.argmin(axis=1)
    near2, d = d2[np.arange(len(x)), home][:, None], np.sqrt(d2)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    copied = (d - np.sqrt(near2) <= 2 * r + SLACK) & (d2 - near2 <= 2 * apart * r + SLACK)
    copied[np.arange(len(x)), home] = False
    return home, copied


def _assign(r: float):
    """Vectors of one label with the cells they live in and those they are copied to."""

    def parts(rows: pa.Table, centres: pa.Table) -> Iterator[pa.Table]:
        pivots = unit(centres["centre"].to_pylist()) if centres.num_rows else None
        for k in range(0, rows.num_rows, ROWS):
            part = rows.slice(k, ROWS)
            n = part.num_rows
            if pivots is None:
                at, copied = np.zeros(n, int), np.zeros((n, 1), bool)
            else:
                at, copied = cells_of(unit(part["vec"].to_pylist()), pivots, r)
            out, to = np.nonzero(copied)
            took = pa.array(np.concatenate([np.arange(n), out]))
            yield pa.table({c: part[c].take(took) for c in ("grp", "node", "n", "vec")} | {"cell": pa.array(np.concatenate([at, to]), pa.int32()), "home": pa.array(np.arange(n + len(out)) < n)})

    def run(key: tuple, rows: pa.Table, centres: pa.Table) -> pa.Table:
        made = list(parts(rows, centres))
        empty = pa.table({"grp": pa.array([], pa.string()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float64())), "cell": pa.array([], pa.int32()), "home": pa.array([], pa.bool_())})
        return pa.concat_tables(made) if made else empty

    return run


def _roots(near: list[np.ndarray], left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Least place reachable for each of n places; near: packed rows of the left-by-right hit matrix."""
    label, width = np.arange(n), len(right)
    while True:
        before = label.copy()
        for k, packed in enumerate(near):
            hit = np.unpackbits(packed, axis=1, count=width).astype(bool)
            own = left[k * STRIP : k * STRIP + len(hit)]
            low = np.minimum(label[own], np.where(hit, label[right], n).min(axis=1, initial=n))
            np.minimum.at(label, own, low)
            np.minimum.at(label, right, np.where(hit, low[:, None], n).min(axis=0, initial=n))
        label = label[label]
        if (label == before).all():
            return label


def _join(least: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        is_home = rows["left"].to_numpy()
        x, node, n = unit(rows["vec"].to_pylist()), rows["node"].to_numpy(), rows["n"].to_numpy()
        left, right = np.flatnonzero(is_home), np.flatnonzero(~is_home)
        _, place = np.unique(node, return_inverse=True)
        count, linked, near = np.zeros(len(left), np.int64), np.zeros(place.max() + 1, bool), []
        for low in range(0, len(left), STRIP):
            own = left[low : low + STRIP]
            cosine = x[own] @ x[right].T
            hit = cosine >= least
            for i, j in zip(*np.nonzero(np.abs(cosine - least) < CLOSE)):  # sums in another order might fall on the other side
                a, b = (np.array(rows["vec"][int(k)].as_py(), float) for k in (own[i], right[j]))
                hit[i, j] = float(a @ b) / (float(np.sqrt(a @ a)) * float(np.sqrt(b @ b))) >= least
            hit[node[own][:, None] == node[right][None, :]] = False
            count[low : low + STRIP] = hit @ n[right]
            linked[place[own[hit.any(axis=1)]]] = True
            linked[place[right[hit.any(axis=0)]]] = True
            near.append(np.packbits(hit, axis=1))
        some = np.flatnonzero(linked)
        nodes = np.unique(node)
        root = nodes[_roots(near, place[left], place[right], len(nodes))] if len(some) else nodes
        ids = np.concatenate([node[left], nodes[some]])
        return pa.table({"node": pa.array(ids), "links": pa.array(np.concatenate([count, np.zeros(len(some), np.int64)])), "root": pa.array([*[None] * len(left), *root[some].tolist()], pa.int64())})

    return run


def metric_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, cell_rows: int = 4096) -> DataFrame:
    """One row per row of ``vectors``: its id, n_links, component_id and kept.

    A label has about one pivot to ``cell_rows`` distinct vectors.
    """
    r = float(np.sqrt(2 - 2 * least))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("grp", F.concat_ws(":", F.size("vec"), F.col("label")))
    distinct = rows.where("ok").groupBy("grp", "vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    # A node is a distinct vector, numbered by its place and not by its ids, which may repeat or be null; written down to stay the same.
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("size"), F.ceil(F.count("*") / PLACED).alias("lots"))
    wanted = F.ceil(F.col("size") / cell_rows)
    draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    sized = nodes.join(sizes, "grp")
    lot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("lots"))
    pivots = sized.where((wanted > 1) & (draw < wanted / F.col("size"))).select(F.col("grp").alias("g"), F.col("vec").alias("centre"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1)).alias("lot"))
    dealt = shipped(sized.select("grp", "node", "n", "vec", lot.alias("lot"))).groupBy("grp", "lot").cogroup(pivots.groupBy("g", "lot"))
    placed = cut(dealt.applyInArrow(_assign(r), "grp string, node bigint, n bigint, vec array<double>, cell int, home boolean"), "cells")
    blocks = placed.groupBy("grp", "cell").agg(F.ceil(F.count_if("home") / HOME).alias("lefts"), F.ceil(F.count("*") / RIGHT).alias("rights"))
    sized = placed.join(blocks, ["grp", "cell"])
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    names = ["grp", "cell", "node", "n", "vec"]
    lefts = sized.where("home").select(*names, F.lit(True).alias("left"), own("lefts").alias("a"), every("rights").alias("b"))
    rights = sized.where("lefts > 0").select(*names, F.lit(False).alias("left"), every("lefts").alias("a"), own("rights").alias("b"))
    met = cut(lefts.unionByName(rights).repartition("grp", "cell", "a", "b").groupBy("grp", "cell", "a", "b").applyInArrow(_join(least), "node bigint, links bigint, root bigint"), "met")
    links = met.where("root is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(met.where("root is not null").select("node", "root"))
    known = component_least(nodes.join(links, "node", "left"), joined, "node", "first_id", "component_id")
    known = known.select("grp", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    # By vector and a salt of the id, so that a vector with a third of all rows spreads over tasks.
    own_rows = rows.where("ok").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    told = own_rows.select("grp", "vec", "salt").distinct().join(known, ["grp", "vec"])
    linked = own_rows.join(told, ["grp", "vec", "salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
