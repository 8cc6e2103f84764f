"""Line dedup: a segment-partition edit join over distinct lines.

Lines are what newlines separate; blank ones (white space only) always stay.  Two
lines of at least ``min_bytes`` bytes are linked at an edit distance of at most
``edits`` (in UTF-8 bytes), shorter ones only if they are equal, as a few edits make
any short line of another.  Of each group of linked lines the first occurrence, in
(doc_id, line) order over the whole table, stays and all others are removed from their
documents.

Documents are dealt into chunks once; the rounds share that shuffle and answer
chunk by chunk, so that texts do not move again.

1. *Equal lines.*  A chunk sends the 128-bit hash and first place of each distinct
   line to a shard, which answers whether it is the first of all.
2. *Filter.*  Each first line of length n is split into edits + 1 segments; a line
   within reach must hold one of them unchanged, at a place that the multi-match
   bounds of its own length allow.  Index keys (length, segment number, segment) and
   the probe keys of lengths n - edits .. n go to the shard that owns the key, which
   answers which of them meet.
3. *Candidates.*  Lines with keys that met are written out under those keys.
   Key groups are cut into blocks of bounded size and verified by a banded
   bit-parallel edit distance, after equal starts and ends are set aside; a block
   gives edges to the roots of its groups, not pairs.
4. *Removal.*  Star rounds join the edges; chunks get the lines that lost and write
   the documents without them.

Hot lines cost one entry per chunk.  Nulls: null and empty texts have no lines.  A
null doc_id sorts last.  Where rows repeat a doc_id (or have none) and hold a line at
the same place, the chunk they are dealt to, a hash of id and text, and then their
text decide which is first; one of them keeps it.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.llm.common import bytes_of, chunked, text_bytes
from edgeloom.operators.stars import components
from edgeloom.plans.lineage import cut

#: Text bytes to a shard, and lines to a side of a verified block.
SHARD_BYTES, BLOCK = 8 << 20, 256
LAST = np.iinfo(np.int64).max
HASHES = "shard bigint, chunk bigint, h1 binary, h2 binary, docs binary, lines binary"
KEYS = "shard bigint, chunk bigint, index binary, probe binary"
ANSWER = "kind int, shard bigint, chunk bigint, bits binary"
LIVE = "chunk bigint, key bigint, index boolean, node bigint, doc_id bigint, line bigint, text binary, bits binary"


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 even segments of a line of n bytes; the last ones take what is over."""
    size, over = divmod(n, edits + 1)
    out, at = [], 0
    for k in range(edits + 1):
        length = size + (k > edits - over)
        out.append((at, length))
        at += length
    return out


def _key(piece: bytes, n: int, k: int) -> int:
    return xxhash.xxh3_64_intdigest(piece, n * 16 + k)


def index_keys(line: bytes, edits: int) -> list[int]:
    return [_key(line[at : at + size], len(line), k) for k, (at, size) in enumerate(segments(len(line), edits))]


def probe_keys(line: bytes, edits: int, least: int) -> list[int]:
    """Keys under which lines of the same length or up to ``edits`` shorter may be indexed.

    Its own index keys stand for the probes at unmoved places of its own length.
    """
    out, have = [], len(line)
    for n in range(max(least, have - edits), have + 1):
        shift = have - n
        for k, (at, size) in enumerate(segments(n, edits)):
            low = max(at - k, at + shift - (edits - k), 0)
            high = min(at + k, at + shift + (edits - k), have - size)
            out += [_key(line[p : p + size], n, k) for p in range(low, high + 1) if shift or p != at]
    return out


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """The edit distance if it is at most ``most``, else most + 1.

    Equal starts and ends are set aside; on the rest a bit vector holds the vertical
    differences of the 2 * most + 1 diagonals around the main one and moves one row
    down with each byte, so a step costs a few operations on one small integer.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    if a == b:
        return 0
    low, end = 0, len(b)
    while low < end:  # the longest equal start, by halving
        half = (low + end + 1) // 2
        if a[:half] == b[:half]:
            low = half
        else:
            end = half - 1
    a, b = a[low:], b[low:]
    low, end = 0, len(b)
    while low < end:
        half = (low + end + 1) // 2
        if a[len(a) - half :] == b[len(b) - half :]:
            low = half
        else:
            end = half - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not b:
        return len(a)
    # Column j of the band covers rows j - most .. j + most of a; bit i is row j - most + i.
    width = 2 * most + 1
    full = (1 << width) - 1
    up = full & ~((1 << most) - 1)  # rows from 0 on: each step down costs one
    down, score = 0, most  # score: the value on the lowest diagonal, at row j + most
    n, m = len(a), len(b)
    for j in range(m):
        equal = 0
        for i in range(width):
            row = j - most + i
            if 0 <= row < n and a[row] == b[j]:
                equal |= 1 << i
        same = ((((equal & up) + up) ^ up) | equal | down) & full  # no cost along the diagonal
        plus = (down | ~(same | up)) & full
        minus = same & up
        if not same >> (width - 1) & 1:
            score += 1
        moved = same >> 1
        up = (minus | ~(moved | plus)) & full
        down = moved & plus
        if j & 3 == 3 and j >= most and _least(score, up, down, width) > most:
            return most + 1
    # The lowest diagonal ended at row m + most; walk up its last column to row n.
    for i in range(width - 1, n - m + most, -1):
        bit = 1 << (i - 1)
        score += bool(down & bit) - bool(up & bit)
    return min(score, most + 1)


def _least(score: int, up: int, down: int, width: int) -> int:
    """The least value in a column of the band, from the one on its lowest diagonal up."""
    least = score
    for i in range(width - 2, -1, -1):
        score += (down >> i & 1) - (up >> i & 1)
        least = min(least, score)
    return least


class Chunk:
    """A chunk's documents in order, their lines, and the distinct ones that are not blank with their first places."""

    def __init__(self, rows: pa.Table):
        self.rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.split = [t.split(b"\n") if t else [] for t in bytes_of(self.rows["text"])]
        self.ids = self.rows["doc_id"].fill_null(LAST).to_numpy()
        place: dict[bytes, tuple[int, int]] = {}
        for k, lines in enumerate(self.split):
            for i, line in enumerate(lines):
                first = place.get(line)
                if first is None:
                    if line.strip():
                        place[line] = (k, i)
                elif i < first[1] and self.ids[k] == self.ids[first[0]]:
                    place[line] = (k, i)
        self.place, self.lines = place, list(place)
        whole = [xxhash.xxh3_128_intdigest(x) for x in self.lines]
        self.h1 = np.fromiter((x & (1 << 64) - 1 for x in whole), np.uint64, len(whole))
        self.h2 = np.fromiter((x >> 64 for x in whole), np.uint64, len(whole))
        where = np.array(list(place.values()), np.int64).reshape(-1, 2)
        self.docs, self.at = self.ids[where[:, 0]] if len(where) else np.zeros(0, np.int64), where[:, 1]


def _shards(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """Each shard with the places of its keys."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    distinct, at = np.unique(shard[order], return_index=True)
    return list(zip(distinct.tolist(), np.split(order, at[1:])))


def _table(key: tuple, shards: list[int], **blobs: list[bytes]) -> pa.Table:
    return pa.table({"shard": pa.array(shards, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(shards), pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in blobs.items()})


def _hashes(shards: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        made = Chunk(rows)
        out = [(s, *(x[own].tobytes() for x in (made.h1, made.h2, made.docs, made.at))) for s, own in _shards(made.h1, shards)]
        s, h1, h2, docs, lines = zip(*out) if out else [()] * 5
        return _table(key, list(s), h1=h1, h2=h2, docs=docs, lines=lines)

    return run


def _said(kind: int, shard: int, chunks: list[int], bits: list[np.ndarray]) -> pa.Table:
    n = len(chunks)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int64()), "chunk": pa.array(chunks, pa.int64()), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _firsts(key: tuple, rows: pa.Table) -> pa.Table:
    blobs = [[np.frombuffer(x, t) for x in rows[k].to_pylist()] for k, t in (("h1", np.uint64), ("h2", np.uint64), ("docs", np.int64), ("lines", np.int64))]
    h1, h2, docs, lines = (np.concatenate(b) for b in blobs)
    chunk = np.repeat(rows["chunk"].to_numpy(), [len(x) for x in blobs[0]])
    order = np.lexsort((chunk, lines, docs, h2, h1))
    first = np.ones(len(h1), bool)
    first[order[1:]] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    return _said(0, key[0].as_py(), rows["chunk"].to_pylist(), np.split(first, np.cumsum([len(x) for x in blobs[0]])[:-1]))


def _bits(answers: pa.Table, kind: int) -> dict[int, bytes]:
    return {s: b for k, s, b in zip(answers["kind"].to_pylist(), answers["shard"].to_pylist(), answers["bits"].to_pylist()) if k == kind}


def _first_lines(made: Chunk, answers: pa.Table, shards: int) -> np.ndarray:
    first, said = np.zeros(len(made.lines), bool), _bits(answers, 0)
    for s, own in _shards(made.h1, shards):
        first[own] = np.unpackbits(np.frombuffer(said[s], np.uint8), count=len(own))
    return first


def _keys_of(made: Chunk, first: np.ndarray, edits: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index and probe keys of the first lines long enough for edits: (keys, line of each)."""
    out = []
    for keys_of in (lambda x: index_keys(x, edits), lambda x: probe_keys(x, edits, least)):
        keys, line = [], []
        for k in np.flatnonzero(first).tolist():
            own = keys_of(made.lines[k]) if len(made.lines[k]) >= least else []
            keys += own
            line += [k] * len(own)
        out.append((np.array(keys, np.uint64), np.array(line, np.int64)))
    return out


def _ask(least: int, shards: int, edits: int):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(key, [], index=[], probe=[])
        made = Chunk(rows)
        index: dict[int, bytes] = {}
        probe: dict[int, bytes] = {}
        for part, (keys, _) in zip((index, probe), _keys_of(made, _first_lines(made, answers, shards), edits, least)):
            for s, own in _shards(keys, shards):
                part[s] = keys[own].tobytes()
        both = sorted(index.keys() | probe.keys())
        return _table(key, both, index=[index.get(s, b"") for s in both], probe=[probe.get(s, b"") for s in both])

    return run


def _meet(key: tuple, rows: pa.Table) -> pa.Table:
    """Of each index key: does another line's index or any probe have it?  Of each probe key: is it indexed?"""
    index, probe = ([np.frombuffer(x, np.uint64) for x in rows[k].to_pylist()] for k in ("index", "probe"))
    stored, at, number = np.unique(np.concatenate(index), return_inverse=True, return_counts=True)
    asked = np.concatenate(probe)
    found = np.isin(asked, stored)
    live = (number > 1) | np.isin(stored, asked[found])
    one = np.split(live[at], np.cumsum([len(x) for x in index])[:-1])
    two = np.split(found, np.cumsum([len(x) for x in probe])[:-1])
    return _said(1, key[0].as_py(), rows["chunk"].to_pylist(), [np.concatenate(x) for x in zip(one, two)])


def _live(least: int, shards: int, edits: int):
    """Lines under their live keys; and one row with the chunk's first lines, for the removal."""

    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("chunk", "key", "index", "node", "doc_id", "line", "text", "bits")}
        if rows.num_rows:
            made = Chunk(rows)
            first, said = _first_lines(made, answers, shards), _bits(answers, 1)
            parts = _keys_of(made, first, edits, least)
            lives = [np.zeros(len(keys), bool) for keys, _ in parts]
            dealt = [dict(_shards(keys, shards)) for keys, _ in parts]
            for s in dealt[0].keys() | dealt[1].keys():
                own = [d.get(s, np.zeros(0, np.int64)) for d in dealt]
                bits = np.unpackbits(np.frombuffer(said[s], np.uint8), count=len(own[0]) + len(own[1])).astype(bool)
                lives[0][own[0]], lives[1][own[1]] = bits[: len(own[0])], bits[len(own[0]) :]
            node = made.h1.view(np.int64)
            for is_index, (keys, line), live in zip((True, False), parts, lives):
                chosen = dict.fromkeys(zip(keys[live].view(np.int64).tolist(), line[live].tolist()))
                for k, at in chosen:
                    for name, value in (("key", k), ("index", is_index), ("node", int(node[at])), ("doc_id", int(made.docs[at])), ("line", int(made.at[at])), ("text", made.lines[at]), ("bits", None)):
                        out[name].append(value)
            for name in out:
                out[name].append(np.packbits(first).tobytes() if name == "bits" else None)
            out["chunk"] = [key[0].as_py()] * len(out["key"])
        kinds = {"index": pa.bool_(), "text": pa.binary(), "bits": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def _verify(edits: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        node, text, is_left = rows["node"].to_pylist(), rows["text"].to_pylist(), rows["left"].to_pylist()
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        left, right = ([k for k, x in enumerate(is_left) if x is side] for side in (True, False))
        for i in left:
            for j in right:
                if node[i] != node[j] and root(node[i]) != root(node[j]) and edit_distance(text[i], text[j], edits) <= edits:
                    a, b = sorted((root(node[i]), root(node[j])))
                    up[b] = a
        pairs = [(x, root(x)) for x in up if root(x) != x]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return run


def _remove(texts: bool, carried: list[str]):
    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        made = Chunk(rows)
        bits = next((b for b in told["bits"].to_pylist() if b is not None), b"")
        first = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(made.lines)).astype(bool)
        lost = np.isin(made.h1.view(np.int64), np.array([x for x in told["node"].to_pylist() if x is not None], np.int64))
        stays = dict(zip(made.lines, (first & ~lost).tolist()))
        kept, n_lines, n_removed = [], [], []
        for k, lines in enumerate(made.split):
            own = [x for i, x in enumerate(lines) if (s := stays.get(x)) is None or (s and made.place[x] == (k, i))]
            kept.append(b"\n".join(own))
            n_lines.append(len(lines))
            n_removed.append(len(lines) - len(own))
        out = {c: made.rows[c] for c in carried}
        out |= {"doc_id": made.rows["doc_id"], "n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        return pa.table(out | ({"kept_text": pa.array(kept, pa.binary()).cast(pa.string())} if texts else {}))

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, min_bytes: int = 12, chunk_bytes: int = 8 << 20, texts: bool = False, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, n_lines, n_removed, kept_sha256.

    min_bytes: the length from which lines are linked by edits; shorter ones are by equality.
    With ``texts`` also kept_text; with ``carry`` also ``doc``, a struct of the row's other columns.
    """
    if min_bytes <= edits:
        raise ValueError("a line must have a byte for each of its edits + 1 segments")
    size = text_bytes(docs, text_col)
    shards = max(1, -(-size // SHARD_BYTES))
    dealt, _ = chunked(docs, id_col, text_col, chunk_bytes, size, carry)
    by_chunk = lambda df: df.groupBy("chunk")
    firsts = by_chunk(dealt).applyInArrow(_hashes(shards), HASHES).groupBy("shard").applyInArrow(_firsts, ANSWER)
    asked = by_chunk(dealt).cogroup(by_chunk(firsts)).applyInArrow(_ask(min_bytes, shards, edits), KEYS)
    met = asked.groupBy("shard").applyInArrow(_meet, ANSWER)
    live = cut(by_chunk(dealt).cogroup(by_chunk(firsts.unionByName(met))).applyInArrow(_live(min_bytes, shards, edits), LIVE), "lines")
    found = live.where("key is not null")
    counts = found.groupBy("key").agg(F.ceil(F.count_if("index") / BLOCK).alias("lefts"), F.ceil(F.count("*") / BLOCK).alias("rights"))
    sized = found.select("key", "index", "node", "text").join(counts.where("lefts > 0"), "key")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    lefts = sized.where("index").select("key", "node", "text", F.lit(True).alias("left"), own("lefts").alias("a"), every("rights").alias("b"))
    rights = sized.select("key", "node", "text", F.lit(False).alias("left"), every("lefts").alias("a"), own("rights").alias("b"))
    # Dealt by block: what is joined by key already would else stay with its key, all blocks of a hot one in one task.
    edges = lefts.unionByName(rights).repartition("key", "a", "b").groupBy("key", "a", "b").applyInArrow(_verify(edits), "a bigint, b bigint")
    joined = components(edges)
    places = found.select("node", "chunk", "doc_id", "line").distinct().join(joined.withColumnRenamed("id", "node"), "node")
    winner = places.groupBy("component").agg(F.min_by("node", F.struct("doc_id", "line", "node")).alias("winner"))
    lost = places.join(winner, "component").where("node <> winner").select("chunk", "node", F.lit(None).cast("binary").alias("bits"))
    told = live.where("key is null").select("chunk", F.lit(None).cast("bigint").alias("node"), "bits").unionByName(lost)
    kinds = ["doc"] if carry else []
    out = T.StructType([dealt.schema[k] for k in kinds])
    for name, kind in [("doc_id", T.LongType()), ("n_lines", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())] + [("kept_text", T.StringType())] * texts:
        out = out.add(name, kind)
    return by_chunk(dealt).cogroup(by_chunk(told)).applyInArrow(_remove(texts, kinds), out).withColumnRenamed("doc_id", id_col)
