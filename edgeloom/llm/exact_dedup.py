"""Exact dedup with a minimal perfect hash over historical distinct digests.

Rows are reduced to SHA-256 digests of their normalised texts; texts never move.
The digests of the *history* (by default the lower half of the id range, as an
earlier crawl would have been) are made distinct and dealt into shards.  Each
shard gets a minimal perfect hash built by levels of collision-free bits; slot i
holds the full digest and the locator of its winner (its least id) and its count.
Incoming distinct digests are probed shard by shard: the slot's digest must equal
the probed one byte for byte, so a member is a proven repeat and a nonmember is
proven new; nonmembers are grouped among themselves.

Hot groups: digests are aggregated map-side before they move, and the verdicts
return to rows by (digest, scan partition), so a text shared by a third of all
rows is one row per scan partition at most wherever it is joined.

Nulls: a null text is empty.  A null id never wins over an id that is not null;
if a group has only null ids, keep_id is null and every row of it is kept.
Repeated rows (same id, same text) share one verdict.  An empty table gives an
empty result.  Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import SPACES, ship
from edgeloom.plans.lineage import cut

INDEX = "shard bigint, sizes binary, bits binary, rest binary, digests binary, winners binary, counts binary"
LEVELS = 40
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _spread(words: np.ndarray, level: int) -> np.ndarray:
    x = words[:, 0] * _MIX[0] + words[:, 1] * _MIX[1] + words[:, 2] * _MIX[2] + words[:, 3] * _MIX[3] + np.uint64((level + 1) * int(_MIX[4]) & (1 << 64) - 1)
    x ^= x >> np.uint64(31)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(29))


class PerfectHash:
    """n distinct 32-byte keys to slots 0..n-1.

    Level by level, a key that lands alone on its bit of the level takes it; the
    others go on to the next level.  A slot is the rank of its bit.  Keys that no
    level settles (none, in practice) get the last slots and are compared directly.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        left, sizes, bits = words, [], []
        while len(left) and len(sizes) < LEVELS:
            m = max(64, 2 * len(left))
            at = (_spread(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            bits.append(alone)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool), left)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that is no member, some slot or -1."""
        out = np.full(len(words), -1, np.int64)
        left, base = np.arange(len(words)), 0
        for level, m in enumerate(self.sizes):
            at = base + (_spread(words[left], level) % np.uint64(m)).astype(np.int64)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + int(m)
        for k, key in enumerate(self.rest):
            out[left[(words[left] == key).all(axis=1)]] = int(self.rank[-1]) + k
        return out


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    words = _words(rows["digest"])
    mph = PerfectHash.build(words)
    slot = mph.slots(words)
    digests, winners, counts = np.empty_like(words), np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    digests[slot], winners[slot], counts[slot] = words, rows["first_id"].to_numpy(), rows["n"].to_numpy()
    one = [key[0].as_py(), mph.sizes, np.packbits(mph.bits), mph.rest, digests, winners, counts]
    names = ["shard", "sizes", "bits", "rest", "digests", "winners", "counts"]
    return pa.table({k: pa.array([v if k == "shard" else v.tobytes()], pa.int64() if k == "shard" else pa.binary()) for k, v in zip(names, one, strict=True)})


def _probe(key: tuple, incoming: pa.Table, index: pa.Table) -> pa.Table:
    """Verdicts on all digests of a shard: every slot of the index, and the nonmembers."""
    words = _words(incoming["digest"]) if incoming.num_rows else np.zeros((0, 4), np.uint64)
    n = incoming["n"].to_numpy() if incoming.num_rows else np.zeros(0, np.int64)
    member = np.zeros(len(words), bool)
    out = []
    if index.num_rows:
        got = {k: index[k][0].as_py() for k in index.column_names}
        sizes = np.frombuffer(got["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(got["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        mph = PerfectHash(sizes, bits, np.frombuffer(got["rest"], np.uint64).reshape(-1, 4))
        digests, winners = np.frombuffer(got["digests"], np.uint64).reshape(-1, 4), np.frombuffer(got["winners"], np.int64)
        counts = np.frombuffer(got["counts"], np.int64).copy()
        slot = mph.slots(words)
        member = (slot >= 0) & (digests[slot] == words).all(axis=1)  # the whole digest decides
        counts[slot[member]] += n[member]
        out.append((digests, pa.array(winners), counts))
    if (~member).any():
        out.append((words[~member], incoming["first_id"].combine_chunks().filter(pa.array(~member)), n[~member]))
    made = [pa.table({"digest": pa.array([d[i].tobytes() for i in range(len(d))], pa.binary()), "keep_id": w.cast(pa.int64()), "group_size": pa.array(c, pa.int64())}) for d, w, c in out]
    return pa.concat_tables(made) if made else pa.table({"digest": pa.array([], pa.binary()), "keep_id": pa.array([], pa.int64()), "group_size": pa.array([], pa.int64())})


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash and its slots.  history: (digest, first_id, n), digests distinct, ids not null."""
    dealt = history.select("digest", "first_id", "n", F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(_build, INDEX)


def lookup(incoming: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, keep_id, group_size) of all distinct digests, historical or new."""
    dealt = incoming.select("digest", "first_id", "n", F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, "digest binary, keep_id bigint, group_size bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history_below: int | None = None, digests_each: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept and text_sha256.

    history_below: ids under it are the history; by default the middle of the id
    range.  The result does not depend on it.  digests_each: distinct digests a
    shard of the index holds, which bounds a task's memory.
    """
    text = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"), F.spark_partition_id().cast("bigint").alias("part"))
    ship(docs.sparkSession)
    rows = cut(text, "digests")
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    middle = history_below if history_below is not None else 0 if low is None else (low + high + 1) // 2
    shards = max(1, -(-n // digests_each))
    old = F.coalesce(F.col("doc_id") < F.lit(middle), F.lit(False))
    distinct = lambda df: df.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    verdicts = lookup(distinct(rows.where(~old)), build_index(distinct(rows.where(old)), shards), shards)
    spread = rows.select("digest", "part").distinct().join(verdicts, "digest")
    out = rows.join(spread, ["digest", "part"])
    return out.select(F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
