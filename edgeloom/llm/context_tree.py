"""Language-model scoring by context-tree weighting over bytes.

Each of the 255 inner nodes of a byte's binary decomposition has a context tree of
its own over the preceding bytes, ``depth`` deep.  A tree node with n0 zeros and n1
ones has the Krichevsky-Trofimov probability Pe(n0, n1); its weighted probability is
Pe at full depth and (Pe + product over children) / 2 above.  The predictive
probability of a bit mixes the KT estimates along its context path with the
posterior weights Pe / (2 Pw); a path that leaves what training has seen goes on
with 1/2.  Texts are lower-cased (A-Z), preceded by 0xFF bytes as context and
followed by one 0xFF as end, which UTF-8 never holds.

Everything is counted over all training documents, and nothing is broadcast but
the two upper levels (at most 255 + 65,280 nodes).  Documents are dealt into chunks
once.  A chunk sends the distinct words and (depth+1)-byte strings of all its
documents with their training counts, each to the shard that owns it; a shard owns
whole subtrees below a pair of preceding bytes, and all chunks' counts of a word.
Shards sum the counts, weight their subtrees, get the upper levels' nodes back, and
answer each chunk with just the values it asked about; the chunk adds them up along
its documents.  All messages are pre-aggregated: a string or word used in a third
of all documents is one entry per chunk.

Nulls: a null text is empty (its score is that of the end).  A null id counts as
empty text when the fold is drawn.  Rows that repeat are counted and scored each.
Without training rows N is 0: base_score is then the sum of log10(0.5 / 0.5).
An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import bytes_of, chunked, runs_of
from edgeloom.llm.substring_dedup import mix
from edgeloom.plans.lineage import cut

#: Bytes of context; with the byte itself and the inner node, six is what a 64-bit key holds.
DEPTH = 6
#: Levels above the shards' subtrees: contexts of 0 and of 1 byte.
EDGE = 0xFF
#: Bytes whose strings are laid out at once.
BLOCK = 1 << 20
MESSAGE = "shard bigint, chunk bigint, items binary, counts binary"
TOP = "shard bigint, top binary"
ANSWER = "chunk bigint, shard bigint, values binary, total bigint, distinct bigint"
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, total bigint, distinct bigint"


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: the recurrence up to x + 8, then Stirling's series."""
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    big = x > 1e9
    z = np.where(big, x, x + 8)
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return series - np.where(big, 0.0, np.log(np.where(big, 1.0, low)))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the KT probability of a sequence with n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def kt_one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1.0)


class Level:
    """Nodes of one depth in the order of their keys: counts and weighting.

    A key is the inner node and then the context, newest byte first, so that the keys
    below a node of the level above lie side by side.
    """

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        kt = log_kt(n0, n1)
        self.log_w = kt if below is None else np.logaddexp(kt, below) - np.log(2)
        self.stop = np.ones(len(keys)) if below is None else np.exp(kt - np.log(2) - self.log_w)
        self.one, self.seen = kt_one(n0, n1), n0 + n1 > 0

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the nodes one byte of context up: keys, n0, n1, what is below; and the place there of each node here."""
        up = self.keys >> 8
        new = np.ones(len(up), bool)
        new[1:] = up[1:] != up[:-1]
        start = np.flatnonzero(new)
        return up[start], *(np.add.reduceat(x, start) for x in (self.n0, self.n1, self.log_w)), np.cumsum(new) - 1

    def mixed(self, at: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """P(1) at this level for each path through the nodes ``at``; a node training never saw predicts 1/2."""
        return np.where(self.seen[at], self.stop[at] * self.one[at] + (1 - self.stop[at]) * deeper, 0.5)

    def find(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)


class Subtrees:
    """The nodes of whole subtrees below pairs of preceding bytes, from their ascending strings and counts; depth ``depth`` to 2."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray, depth: int):
        symbol, context = strings & 255, strings >> 8
        keys, totals, ones, where, have = [], [], [], [], 0
        for b in range(8):  # strings with equal context and first b bits lie side by side
            head = strings >> (8 - b)
            new = np.ones(len(head), bool)
            new[1:] = head[1:] != head[:-1]
            start = np.flatnonzero(new)
            keys.append((1 << b | symbol[start] >> (8 - b)) << 8 * depth | context[start])
            totals.append(np.add.reduceat(counts, start))
            ones.append(np.add.reduceat(counts * (symbol >> (7 - b) & 1), start))
            where.append(have + np.cumsum(new) - 1)
            have += len(start)
        key = np.concatenate(keys)
        order = np.argsort(key)
        rank = np.empty(have, np.int64)
        rank[order] = np.arange(have)
        n, n1 = np.concatenate(totals)[order].astype(float), np.concatenate(ones)[order].astype(float)
        self.symbol, self.path = symbol, [rank[w] for w in where]
        self.levels, self.up = [Level(key[order], n - n1, n1, None)], []
        for _ in range(depth - 2):
            *node, up = self.levels[-1].sums()
            self.levels.append(Level(*node))
            self.up.append(up)

    def log10_p(self, one: Level, zero: Level) -> np.ndarray:
        """log10 P(symbol | context) of each string, given the two levels above."""
        first = self.levels[0]
        p, at = np.where(first.seen, first.one, 0.5), np.arange(len(first.keys))
        for level, up in zip(self.levels[1:], self.up):
            at = up[at]
            p = level.mixed(at, p)
        key = self.levels[-1].keys
        p = one.mixed(one.find(key >> 8)[at], p)
        p = zero.mixed(zero.find(key >> 16)[at], p)
        total = np.zeros(len(self.symbol))
        for b, path in enumerate(self.path):
            own = p[path]
            total += np.log10(np.where(self.symbol >> (7 - b) & 1, own, 1 - own))
        return total


#: Strings whose subtrees are laid out at once (a pair with more has all of its own).
PART = 1 << 16


def parts(strings: np.ndarray, depth: int):
    """Ranges of ascending strings, whole pairs of preceding bytes, of about PART strings."""
    pair = strings >> 8 * (depth - 1)
    ends = np.append(np.flatnonzero(pair[1:] != pair[:-1]) + 1, len(pair))
    low = 0
    while low < len(pair):
        high = int(ends[max(np.searchsorted(ends, low, side="right"), np.searchsorted(ends, low + PART, side="right") - 1)])
        yield low, high
        low = high


def upper_sums(strings: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, n0, n1, what is below) of the nodes under one preceding byte, as far as these strings make them up."""
    got = [Subtrees(strings[a:b], counts[a:b], depth).levels[-1].sums()[:4] for a, b in parts(strings, depth)]
    if not got:
        return np.zeros(0, np.int64), *np.zeros((3, 0))
    keys, at = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
    return keys, *(np.bincount(at, np.concatenate([x[k] for x in got]), len(keys)) for k in (1, 2, 3))


def top_levels(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[Level, Level]:
    """The levels of one and of no preceding byte, from the summed nodes of the former."""
    one = Level(keys, n0, n1, below)
    return one, Level(*one.sums()[:4])


def log10_p(strings: np.ndarray, counts: np.ndarray, one: Level, zero: Level, depth: int) -> np.ndarray:
    """log10 P(symbol | context) of ascending strings, of which training has ``counts``."""
    out = np.empty(len(strings))
    for a, b in parts(strings, depth):
        out[a:b] = Subtrees(strings[a:b], counts[a:b], depth).log10_p(one, zero)
    return out


def layout(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all strings of the texts in order, and how many each text has.

    A code holds the preceding bytes, newest first, then the byte itself.
    """
    pad = bytes([EDGE]) * depth
    raw = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    code = raw[depth:].astype(np.int64)
    for k in range(depth):
        code |= raw[depth - 1 - k : len(raw) - 1 - k].astype(np.int64) << (8 * (depth - k))
    starts = np.cumsum(sizes + depth) - (sizes + depth)
    wanted = np.zeros(len(code) + 1, np.int64)
    wanted[starts] += 1
    np.add.at(wanted, starts + sizes, -1)
    return code[np.cumsum(wanted[:-1]) > 0], sizes


def _blocks(texts: list[bytes]):
    """Runs of texts of about BLOCK bytes together."""
    low, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield low, k + 1
            low, size = k + 1, 0
    if low < len(texts):
        yield low, len(texts)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Ascending and without repeats, by a sort, which numpy does faster than by a table."""
    x = np.sort(x)
    return x[np.flatnonzero(np.append(True, x[1:] != x[:-1]))] if len(x) else x


class Chunk:
    """A chunk's documents with the distinct words and strings in them."""

    def __init__(self, rows: pa.Table, folds: int, held: int, depth: int = DEPTH):
        self.depth = depth
        self.ids = rows["doc_id"]
        self.texts = [(t or b"").lower() for t in bytes_of(rows["text"])]
        names = [b"" if i is None else str(i).encode() for i in self.ids.to_pylist()]
        self.held = np.array([zlib.crc32(x) % folds == held for x in names], bool)

    def words(self) -> tuple[list[bytes], np.ndarray]:
        """Distinct words in order (the end of a text is the empty one) and their training counts."""
        count, others = Counter(), {b""}
        for t, held in zip(self.texts, self.held.tolist()):
            words = t.split()
            if held:
                others.update(words)
            else:
                count.update(words)
        count[b""] = int((~self.held).sum())
        distinct = sorted(others.union(count))
        return distinct, np.fromiter(map(count.__getitem__, distinct), np.int64, len(distinct))

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct strings, ascending, and their training counts."""
        codes: list[list[np.ndarray]] = [[], []]
        for low, high in _blocks(self.texts):
            code, sizes = layout(self.texts[low:high], self.depth)
            held = np.repeat(self.held[low:high], sizes)
            codes[0].append(code[~held])
            codes[1].append(code[held])
        none = [np.zeros(0, np.int64)]
        known, n = np.unique(np.concatenate(codes[0] or none), return_counts=True)
        distinct = _distinct(np.concatenate([known, *codes[1]]))
        counts = np.zeros(len(distinct), np.int64)
        counts[np.searchsorted(distinct, known)] = n
        return distinct, counts


def _string_shard(strings: np.ndarray, shards: int, depth: int) -> np.ndarray:
    return (mix((strings >> 8 * (depth - 1)).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _word_shard(words: list[bytes], shards: int) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(shards)).astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Counts in the smallest unsigned type that holds them, named by a first byte."""
    kind = "BHIQ"[int(np.searchsorted([1 << 8, 1 << 16, 1 << 32], x.max(initial=0), side="right"))]
    return kind.encode() + x.astype(kind).tobytes()


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, raw[:1].decode(), offset=1).astype(np.int64)


def _send(shards: int, folds: int, held: int, depth: int):
    """String shards are numbered from 0, word shards from ``shards``."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        made, out = Chunk(rows, folds, held, depth), []
        strings, counts = made.strings()
        for s, own in runs_of(_string_shard(strings, shards, depth)):
            out.append((s, _packed(strings[own]), _small(counts[own])))
        words, counts = made.words()
        for s, own in runs_of(_word_shard(words, shards)):
            out.append((shards + s, b"\n".join([words[k] for k in own.tolist()]), _small(counts[own])))
        a, b, c = zip(*out)
        return pa.table({"shard": pa.array(a, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(out), pa.int64()), "items": pa.array(b, pa.binary()), "counts": pa.array(c, pa.binary())})

    return run


def _packed(codes: np.ndarray) -> bytes:
    """Ascending codes as the bytes of their differences, after the number of bytes each takes."""
    steps = np.diff(codes.astype("<i8"), prepend=0).view(np.uint64)
    sizes = np.ones(len(steps), np.uint8)
    for k in range(1, 8):
        sizes += steps >= np.uint64(1 << 8 * k)
    taken = np.arange(8) < sizes[:, None]
    return len(codes).to_bytes(4, "little") + sizes.tobytes() + steps.view(np.uint8).reshape(-1, 8)[taken].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    sizes = np.frombuffer(raw, np.uint8, n, 4)
    steps = np.zeros((n, 8), np.uint8)
    steps[np.arange(8) < sizes[:, None]] = np.frombuffer(raw, np.uint8, offset=4 + n)
    return np.cumsum(steps.view("<i8").ravel())


def _shard_strings(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    codes = [_unpacked(x) for x in rows["items"].to_pylist()]
    strings = _distinct(np.concatenate(codes))
    counts = np.zeros(len(strings), np.int64)
    for own, n in zip(codes, rows["counts"].to_pylist()):
        counts[np.searchsorted(strings, own)] += _large(n)
    return codes, strings, counts


def _upper(shards: int, depth: int):
    """The depth-1 nodes as far as one shard's depth-2 nodes make them up."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        keys = n0 = n1 = log_w = np.zeros(0)
        if key[0].as_py() < shards:
            keys, n0, n1, log_w = upper_sums(*_shard_strings(rows)[1:], depth)
        return pa.table({"node": pa.array(keys.astype(np.int64)), "n0": pa.array(n0, pa.float64()), "n1": pa.array(n1, pa.float64()), "log_w": pa.array(log_w, pa.float64())})

    return run


def _pack_top(key: tuple, rows: pa.Table) -> pa.Table:
    """Both upper levels, as every shard will get them: at most 255 * 257 nodes of three numbers."""
    rows = rows.sort_by("node")
    packed = np.stack([rows[c].to_numpy().astype(float) for c in ("node", "n0", "n1", "log_w")])
    return pa.table({"top": pa.array([packed.tobytes()], pa.binary())})


def _answer(shards: int, depth: int):
    def run(key: tuple, rows: pa.Table, top: pa.Table) -> pa.Table:
        out, shard, chunks = [], key[0].as_py(), rows["chunk"].to_pylist() if rows.num_rows else []
        total = distinct = 0
        if chunks and shard < shards:
            codes, strings, counts = _shard_strings(rows)
            node, n0, n1, below = np.frombuffer(top["top"][0].as_py(), float).reshape(4, -1)
            p = log10_p(strings, counts, *top_levels(node.astype(np.int64), n0, n1, below), depth)
            out = [p[np.searchsorted(strings, c)].astype(np.float32).tobytes() for c in codes]
        elif chunks:
            asked = [x.split(b"\n") for x in rows["items"].to_pylist()]
            count: Counter = Counter()
            for words, n in zip(asked, rows["counts"].to_pylist()):
                for w, c in zip(words, _large(n).tolist()):
                    count[w] += c
            total, distinct = sum(count.values()), sum(c > 0 for c in count.values())
            out = [_small(np.fromiter(map(count.__getitem__, w), np.int64, len(w))) for w in asked]
            chunks, out = [*chunks, -1], [*out, b""]
        n = len(out)
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "shard": pa.array([shard] * n, pa.int64()), "values": pa.array(out, pa.binary()), "total": pa.array([0] * (n - 1) + [total] if n else [], pa.int64()), "distinct": pa.array([0] * (n - 1) + [distinct] if n else [], pa.int64())})

    return run


class Finder:
    """Places of codes in a sorted array: a table by hash, and a search for the few that share a slot."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.shift = np.uint64(64 - max(10, int(len(known)).bit_length() + 3))
        self.table = np.zeros(1 << int(64 - self.shift), np.int32)
        self.table[self._slot(known)] = np.arange(len(known), dtype=np.int32)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(codes)]
        missed = np.flatnonzero(self.known[at] != codes)
        at[missed] = np.searchsorted(self.known, codes[missed])
        return at


def _score(shards: int, folds: int, held: int, depth: int):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        got = dict(zip(answers["shard"].to_pylist(), answers["values"].to_pylist())) if answers.num_rows else {}
        if not rows.num_rows:  # the shards' totals pass through
            n = answers.num_rows
            empty = {c: pa.nulls(n, t) for c, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()))}
            return pa.table(empty | {"total": answers["total"], "distinct": answers["distinct"]})
        made = Chunk(rows, folds, held, depth)
        strings = _distinct(np.concatenate([layout(made.texts[a:b], depth)[0] for a, b in _blocks(made.texts)]))
        shard, value = _string_shard(strings, shards, depth), np.zeros(len(strings))
        for s, own in runs_of(shard):
            value[own] = np.frombuffer(got[s], np.float32)
        find, score = Finder(strings), np.zeros(len(made.texts))
        for low, high in _blocks(made.texts):
            code, sizes = layout(made.texts[low:high], depth)
            score[low:high] = np.add.reduceat(value[find(code)], np.cumsum(sizes) - sizes)
        words = sorted({b""}.union(*map(bytes.split, made.texts)))
        shard, counts = _word_shard(words, shards), np.zeros(len(words), np.int64)
        for s, own in runs_of(shard):
            counts[own] = _large(got[shards + s])
        seen, n_tokens, n_known, base = dict(zip(words, counts.tolist())), [], [], []
        for t in made.texts:
            c = np.array([*map(seen.__getitem__, t.split()), seen[b""]], float)
            n_tokens.append(len(c))
            n_known.append(int(np.count_nonzero(c)))
            base.append(float(np.log10(c + 0.5).sum()))
        n = len(base)
        return pa.table({"doc_id": made.ids, "held_out": pa.array(made.held), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base": pa.array(base, pa.float64()), "score": pa.array(score), "total": pa.nulls(n, pa.int64()), "distinct": pa.nulls(n, pa.int64())})

    return run


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, chunk_bytes: int = 8 << 20, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: its id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    score is the model's log10 probability of the lower-cased text with its end;
    code_length is the same in bits.  chunk_bytes bounds a task's memory; depth, 2 to 6,
    is the bytes of context.
    """
    if not 2 <= depth <= 6:
        raise ValueError("a context has 2 to 6 bytes")
    dealt, chunks = chunked(docs, id_col, text_col, chunk_bytes)
    shards = max(1, min(1 << 16, -(-chunks // 4)))
    spark = docs.sparkSession
    sent = dealt.groupBy("chunk").applyInArrow(_send(shards, folds, held, depth), MESSAGE).repartition(2 * shards, "shard")
    upper = sent.groupBy("shard").applyInArrow(_upper(shards, depth), "node bigint, n0 double, n1 double, log_w double")
    nodes = upper.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("log_w"))
    top = nodes.groupBy(F.lit(0).alias("all")).applyInArrow(_pack_top, "top binary")
    tops = spark.range(shards).select(F.col("id").alias("shard"), F.lit(0).alias("all")).join(F.broadcast(top.withColumn("all", F.lit(0))), "all").select("shard", "top")
    answers = sent.groupBy("shard").cogroup(tops.groupBy("shard")).applyInArrow(_answer(shards, depth), ANSWER)
    rows = cut(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(shards, folds, held, depth), SCORED), "scored")
    total, distinct = rows.where("held_out is null").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total)) + 0.5 * (F.lit(float(distinct)) + 1))
    bits = -F.col("score") / F.log10(F.lit(2.0))
    out = rows.where("held_out is not null").select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("code_length"))
    return out
