"""Substring dedup: a count-min prefilter, then exact grouping of what it lets through.

A window is ``window`` consecutive words of one document; it is a repeat when the
same words also start earlier (smaller doc_id, or the same document and an earlier
start).  Words covered by a repeat are removed.

Documents are dealt into chunks once; three steps share that shuffle.

1. *Sketch.*  Every window is counted under its anchor, the ``anchor``-word shingle
   of least hash within it.  Two places with the same window have the same anchor
   at the same offset, so the count of an anchor's places is never below that of
   the window.  A chunk builds a count-min sketch of two rows over its anchors and
   sends the touched cells, each to the shard that owns its range; shards add the
   partition sketches up and answer, cell by cell, whether the sum reaches two.
   The sketch grows with the corpus, a shard does not, and nothing is broadcast.
2. *Exact pass.*  A chunk looks at the windows whose anchor both rows call repeated,
   settles repeats within itself, and sends one 128-bit window hash with its first
   place per distinct window.  Shards group equal hashes and answer whether a place
   is the first of all.  A window shared by a third of all documents costs one row
   per chunk.
3. *Removal.*  Chunks cover the words of all repeats and hash what is kept.

Nulls: a null text has no words.  A null doc_id sorts after all others.  Rows that
repeat a doc_id count as the same document: places with the same doc_id and start
do not remove each other.  An empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from edgeloom.llm.common import bytes_of, chunked, runs_of, text_bytes

#: Odd multipliers of the rolling hashes.
ROLL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SALT = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Cells of a sketch shard, and text bytes to a shard of the exact pass.
CELLS, EXACT_BYTES = 1 << 21, 8 << 20
LAST = np.iinfo(np.int64).max
MESSAGE = "shard bigint, chunk bigint, cells binary, counts binary"
ANSWER = "kind int, shard bigint, chunk bigint, bits binary"
PLACES = "shard bigint, chunk bigint, h1 binary, h2 binary, docs binary, starts binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, n: int, m: int) -> np.ndarray:
    """Polynomial hash of every n consecutive values, by doubling."""
    out, have, power, at = None, 0, h, 1
    while n:
        if n & 1:
            if out is None:
                out, have = power, at
            else:
                size = len(h) - have - at + 1
                out = out[:size] * np.uint64(pow(m, at, 1 << 64)) + power[have : have + size]
                have += at
        n >>= 1
        if n:
            size = len(h) - 2 * at + 1
            power = power[:size] * np.uint64(pow(m, at, 1 << 64)) + power[at : at + size]
            at *= 2
    return out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n consecutive values."""
    at = 1
    while 2 * at <= n:
        x = np.minimum(x[:-at], x[at:])
        at *= 2
    return x if at == n else np.minimum(x[: -(n - at)], x[n - at :])


class Chunk:
    """The words of a chunk's documents, in (doc_id, start) order, and what the steps derive from them."""

    def __init__(self, rows: pa.Table, window: int, anchor: int):
        rows = rows.sort_by([("doc_id", "ascending")])
        self.ids = rows["doc_id"]
        split = [(t or b"").split() for t in bytes_of(rows["text"])]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.words = [w for words in split for w in words]
        self.window = window
        n = len(self.words)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.at = np.zeros(0, np.int64)
        if n < window:
            return
        self.h = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, n))
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        count = n - window + 1
        inside = self.doc[:count] == self.doc[window - 1 :]
        self.at = np.flatnonzero(inside)
        shingles = mix(rolled(self.h, anchor, ROLL[0]))
        span = window - anchor + 1
        self.least = sliding_min(shingles, span)
        chosen = np.zeros(len(shingles), bool)
        for k in range(span):
            chosen[k : k + count] |= inside & (shingles[k : k + count] == self.least)
        self.keys, number = np.unique(shingles[chosen], return_counts=True)
        self.number = np.minimum(number, 2).astype(np.uint8)

    def cells(self, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each sketch row: distinct cells, their saturated counts, and the place of each key's cell."""
        out = []
        for salt in SALT:
            cell, where = np.unique(mix(self.keys ^ np.uint64(salt)) % np.uint64(width), return_inverse=True)
            out.append((cell.astype(np.int64), np.minimum(np.bincount(where, self.number, len(cell)), 2).astype(np.uint8), where))
        return out

    def repeated(self, width: int, answers: dict[int, bytes]) -> np.ndarray:
        """Starts of the windows that both rows of the merged sketch call repeated."""
        if not len(self.at):
            return self.at
        live = np.ones(len(self.keys), bool)
        for r, (cell, _, where) in enumerate(self.cells(width)):
            shard = cell // CELLS
            hot = np.zeros(len(cell), bool)
            for s, own in runs_of(shard):
                hot[own] = np.unpackbits(np.frombuffer(answers[s * 2 + r], np.uint8), count=len(own))
            live &= hot[where]
        return self.at[live[np.searchsorted(self.keys, self.least[self.at])]]

    def groups(self, starts: np.ndarray) -> tuple:
        """Distinct windows among ``starts``: hashes and first place of each, and the group of every start."""
        h1, h2 = (rolled(self.h, self.window, m)[starts] for m in ROLL)
        order = np.lexsort((h2, h1))  # stable, so the first of a group is the earliest
        a, b = h1[order], h2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.empty(len(a), np.int64)
        group[order] = np.cumsum(new) - 1
        return a[new], b[new], order[new], group

    def places(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids.fill_null(LAST).to_numpy()
        doc = self.doc[starts]
        return ids[doc], starts - self.bounds[doc]


def _sketch(window: int, anchor: int, width: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        made, out = Chunk(rows, window, anchor), []
        if len(made.at):
            for r, (cell, number, _) in enumerate(made.cells(width)):
                shard = cell // CELLS
                for s, own in runs_of(shard):
                    out.append((s * 2 + r, (cell[own] % CELLS).astype(np.uint32).tobytes(), number[own].tobytes()))
        shards, cells, counts = zip(*out) if out else ((), (), ())
        return pa.table({"shard": pa.array(shards, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(out), pa.int64()), "cells": pa.array(cells, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _answers(kind: int, shard: int, chunks: list[int], bits: list[np.ndarray]) -> pa.Table:
    n = len(chunks)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int64()), "chunk": pa.array(chunks, pa.int64()), "bits": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())})


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.zeros(CELLS, np.uint8)
    cells = [np.frombuffer(x, np.uint32) for x in rows["cells"].to_pylist()]
    for cell, number in zip(cells, rows["counts"].to_pylist()):
        total[cell] = np.minimum(total[cell] + np.frombuffer(number, np.uint8), 2)
    return _answers(0, key[0].as_py(), rows["chunk"].to_pylist(), [total[c] >= 2 for c in cells])


def _by_shard(answers: pa.Table, kind: int) -> dict[int, bytes]:
    return {s: b for k, s, b in zip(answers["kind"].to_pylist(), answers["shard"].to_pylist(), answers["bits"].to_pylist()) if k == kind}


def _exact(window: int, anchor: int, width: int, shards: int):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            made = Chunk(rows, window, anchor)
            starts = made.repeated(width, _by_shard(answers, 0))
            if len(starts):
                h1, h2, first, _ = made.groups(starts)
                docs, begin = made.places(starts[first])
                shard = (h1 % np.uint64(shards)).astype(np.int64)
                for s, own in runs_of(shard):
                    out.append((s, *(x[own].tobytes() for x in (h1, h2, docs, begin.astype(np.int32)))))
        columns = list(zip(*out)) if out else [()] * 5
        table = {"shard": pa.array(columns[0], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(out), pa.int64())}
        return pa.table(table | {k: pa.array(c, pa.binary()) for k, c in zip(("h1", "h2", "docs", "starts"), columns[1:])})

    return run


def _first_of_all(key: tuple, rows: pa.Table) -> pa.Table:
    blobs = [[np.frombuffer(x, t) for x in rows[k].to_pylist()] for k, t in (("h1", np.uint64), ("h2", np.uint64), ("docs", np.int64), ("starts", np.int32))]
    h1, h2, docs, starts = (np.concatenate(b) for b in blobs)
    order = np.lexsort((starts, docs, h2, h1))
    a, b, d, s = h1[order], h2[order], docs[order], starts[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    late = np.empty(len(a), bool)
    late[order] = (d != d[head]) | (s != s[head])
    sizes = np.cumsum([len(x) for x in blobs[0]])[:-1]
    return _answers(1, key[0].as_py(), rows["chunk"].to_pylist(), np.split(late, sizes))


def _remove(window: int, anchor: int, width: int, shards: int, texts: bool):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        made = Chunk(rows, window, anchor)
        n = len(made.words)
        covered = np.zeros(n, bool)
        starts = made.repeated(width, _by_shard(answers, 0))
        if len(starts):
            h1, _, first, group = made.groups(starts)
            late, said = np.zeros(len(h1), bool), _by_shard(answers, 1)
            shard = (h1 % np.uint64(shards)).astype(np.int64)
            for s, own in runs_of(shard):
                late[own] = np.unpackbits(np.frombuffer(said[s], np.uint8), count=len(own))
            docs, begin = made.places(starts)
            repeat = late[group] | (docs != docs[first][group]) | (begin != begin[first][group])
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts[repeat], 1)
            np.add.at(edge, starts[repeat] + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
        keep, kept = ~covered, []
        for low, high in zip(made.bounds[:-1].tolist(), made.bounds[1:].tolist()):
            kept.append(b" ".join(compress(made.words[low:high], keep[low:high].tolist())))
        gone = np.concatenate([[0], np.cumsum(covered)])
        removed = gone[made.bounds[1:]] - gone[made.bounds[:-1]]
        out = {"doc_id": made.ids, "n_words": pa.array(made.sizes), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        return pa.table(out | ({"kept_text": pa.array(kept, pa.binary()).cast(pa.string())} if texts else {}))

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, anchor: int = 10, chunk_bytes: int = 8 << 20, texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    chunk_bytes bounds a task's memory.  The sketch has about four cells to an anchor.
    """
    size = text_bytes(docs, text_col)
    width = CELLS * max(1, -(-size // (9 * CELLS)))
    shards = max(1, -(-size // EXACT_BYTES))
    dealt, _ = chunked(docs, id_col, text_col, chunk_bytes, size)
    by_chunk = lambda df: df.groupBy("chunk")
    merged = by_chunk(dealt).applyInArrow(_sketch(window, anchor, width), MESSAGE).groupBy("shard").applyInArrow(_merge, ANSWER)
    places = by_chunk(dealt).cogroup(by_chunk(merged)).applyInArrow(_exact(window, anchor, width, shards), PLACES)
    firsts = places.groupBy("shard").applyInArrow(_first_of_all, ANSWER)
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts
    done = by_chunk(dealt).cogroup(by_chunk(merged.unionByName(firsts))).applyInArrow(_remove(window, anchor, width, shards, texts), out)
    return done.withColumnRenamed("doc_id", id_col)
