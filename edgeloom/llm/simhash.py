"""SimHash near-dedup with multi-index hashing.

Fingerprints are 64 sign bits over the XXH64 values of a document's word shingles.
Documents are first grouped by fingerprint (map-side aggregated, so a copied text
is one row).  Distinct fingerprints within ``max_bits`` are then found exactly:
of ``segments`` equal slices two such fingerprints agree on at least one slice up
to floor(max_bits / segments) bits, so each fingerprint enumerates the small
Hamming ball around each of its slices, fetches the table entries for every
member of the ball, and the complete distance is verified inside the join.  With
the default of two slices of 32 bits, a ball has 33 members and a table key
stands for 2^32 values, so unrelated fingerprints seldom meet even in a very
large corpus.  Linked fingerprints are joined into components by star rounds.

``similar_dedup`` is for looser copies.  Where word shingles agree at a Jaccard
similarity of 0.8, about 15 % of the bits differ, too many for 64 bits to tell apart
from chance, and any table whose keys survive that many flips is met by chance as the
corpus grows.  So the fingerprint is longer (further words are mixed from the same
shingle hashes), and its tables stand apart by *anchor*: a document is entered under
the shingles of least hash by ``anchors`` orders, and two documents meet only where
they share one, which a similarity of 0.8 does for at least one of four orders in all
but 0.2 % of cases.  An anchor that only one text has ends there.  Under the others a
text is entered by ``SLICES`` slices of its fingerprint and asks for the Hamming ball of
radius one around each, as many rows for every anchor however many texts share it; at
the distance of a similarity of 0.8 a slice of 8 bits differs in more than one with a
probability of 0.34, all four in 1.3 % of cases, for each anchor.

What these tables and bits leave out is found in an exact way.  Where two sets have a
similarity of ``least``, their first shingles in any one order, ``n - least * n + 1`` of n,
have one in common (and half as many are enough on the side of the smaller set).  So each
text is also entered and asked for under all of these, in an order of hashes in which the
shingles of many texts come last.  (Which are those is told by a bounded draw of texts; the
order decides how many texts meet, not which pairs are found.)  Texts that meet there are
candidates unless their sizes or the parities of their shingles' buckets prove them less
similar: each shingle that only one set has changes one parity.

Keys are dealt to shards and blocks of bounded size, and a block sends no pairs: only
an edge per linked text to the root of its group, so a group of thousands of near copies
costs no more than its rows.  These groups only say which texts to look at: those of
groups of two and more are fetched, and two of them are linked where the Jaccard
similarity of their shingle sets is at least ``least``.  Groups are compared in blocks of
bounded size, so a group larger than a block's side sends each text once per side.

Nulls and empty texts have no shingles: their fingerprint is zero and they link
like any other.  Rows with a null id take part but never name a component unless
they are alone in it.  Repeated rows give repeated result rows.  An empty table
gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import answered, bytes_of, over_batches, shipped, whole
from edgeloom.llm.substring_dedup import mix
from edgeloom.operators.stars import SALTS, component_least, components
from edgeloom.plans.lineage import cut

SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Makes the families of shingle hashes differ.
SALT = np.random.default_rng(SEED).integers(1, 1 << 63, 16, dtype=np.uint64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of one text; A-Z count as lower case."""
    return long_fingerprint(text, width, 1, 0)[0][0]


def _shingles(text: bytes | None, width: int) -> list[bytes]:
    """The runs of ``width`` words; a shorter text is one shingle, a text without words has none."""
    words = (text or b"").lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)))))


def long_fingerprint(text: bytes | None, width: int, words: int, anchors: int) -> tuple[list[int], list[int]]:
    """The sign bits of ``words`` families of shingle hashes, and the least hash of ``anchors`` others.

    The first family is XXH64 itself, the others are mixed from it.
    """
    return _signs(_hashes(text, width), words, anchors)


def _hashes(text: bytes | None, width: int) -> np.ndarray:
    shingles = _shingles(text, width)
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def _signs(hashes: np.ndarray, words: int, anchors: int) -> tuple[list[int], list[int]]:
    if not len(hashes):
        return [0] * words, [0] * anchors
    n, ones, least = len(hashes), np.zeros((words, 64), np.int64), np.full(anchors, (1 << 64) - 1, np.uint64)
    for at in range(0, n, BLOCK):
        h = hashes[at : at + BLOCK]
        for k in range(words):
            own = h if k == 0 else mix(h ^ SALT[k])
            ones[k] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        for k in range(anchors):
            least[k] = min(least[k], mix(h ^ SALT[-1 - k]).min())
    return [int(np.packbits(x * 2 > n, bitorder="little").view("<u8")[0]) for x in ones], least.tolist()


def first_shingles(kinds: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, int]:
    """Those of a set's hashes that every set of a similarity of ``least`` shares one of, and how many a smaller set needs.

    kinds: distinct, ascending; frequent: hashes that come last, ascending, and their ranks.  An empty set is entered as 0.
    """
    n = len(kinds)
    if not n:
        return np.zeros(1, np.uint64), 1
    known, ranks = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, kinds), len(known) - 1)
        late = known[at] == kinds
        kinds = np.concatenate([kinds[~late], kinds[late][np.argsort(ranks[at[late]])]])
    asked, stored = n - math.ceil(least * n - 1e-9) + 1, n - math.ceil(2 * least / (1 + least) * n - 1e-9) + 1
    return kinds[:asked], stored


def parities(kinds: np.ndarray) -> bytes:
    """A bit for each of about as many buckets as there are hashes: is their number in it odd?"""
    buckets = min(PARITIES, max(64, 1 << (len(kinds) - 1).bit_length() if len(kinds) else 0))
    at = (mix(kinds ^ SALT[7]) & np.uint64(buckets - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=buckets) & 1).astype(np.uint8), bitorder="little").tobytes()


def _fingerprints(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t, width) for t in bytes_of(batch.column("text"))], np.uint64).view(np.int64)
        return pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(got)})

    return over_batches(run)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp bigint) of every row, fp as the signed reading of its 64 bits."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return shipped(rows).mapInArrow(_fingerprints(width), "doc_id bigint, fp bigint")


def balls(segments: int, max_bits: int) -> list[tuple[int, int, list[int]]]:
    """Of each slice: its lowest bit, its mask, and the masks whose XOR gives its Hamming ball."""
    out, radius = [], max_bits // segments
    edges = [64 * k // segments for k in range(segments + 1)]
    for low, high in zip(edges, edges[1:]):
        width = high - low
        flips = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]
        out.append((low, (1 << width) - 1, flips))
    return out


def _ball(piece: Column, k: int, flips: list[int]) -> Column:
    return F.transform(F.lit(flips).cast("array<bigint>"), lambda x: F.struct(F.lit(k).alias("seg"), piece.bitwiseXOR(x).alias("val")))


def links(fps: DataFrame, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """Distinct pairs (a, b), a < b, of different fingerprints at most ``max_bits`` apart.  fps: distinct fp."""
    keys, probes = [], []
    for k, (low, mask, flips) in enumerate(balls(segments, max_bits)):
        piece = F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit(mask))
        keys.append(F.struct(F.lit(k).alias("seg"), piece.alias("val")))
        probes.append(_ball(piece, k, flips))
    stored = fps.select(F.col("fp").alias("b"), F.explode(F.array(*keys)).alias("key")).select("b", "key.seg", "key.val")
    asked = fps.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*probes))).alias("key")).select("a", "key.seg", "key.val")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    met = asked.join(stored, (asked.seg == stored.seg) & (asked.val == stored.val) & near)
    return met.select("a", "b").distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (16 hex digits), component_id and kept.

    component_id is the least id reachable over links of at most ``max_bits``
    differing bits; one row of each component is kept (rows repeating its id share that).
    """
    rows = cut(fingerprints(docs, id_col, text_col, width).withColumn("part", F.spark_partition_id()), "fps")
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fpgroups")
    joined = components(links(groups.select("fp"), max_bits, segments))
    by_fp = component_least(groups, joined, "fp", "first_id", "component_id").select("fp", "component_id")
    # By fingerprint and scan partition, so that a fingerprint of a third of all rows spreads over tasks.
    told = rows.select("fp", "part").distinct().join(by_fp, "fp")
    out = rows.join(told, ["fp", "part"])
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("doc_id").alias(id_col), hexed.alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Slices that a text is entered and asked for by under an anchor, and their bits.
SLICES, SLICE = 4, 8
#: Rows of a shard of the search by slices and of that by shingles, and on the sides of their blocks.
SHARD, SHINGLES, STORED, ASKED = 1 << 17, 1 << 15, 1 << 14, 1 << 18
#: Texts, and bytes of text, on the sides of a block of the comparison by shingles.
SIDE, SIDE_BYTES = 512, 4 << 20
#: Pairs compared at once, and bytes of their parities.
STRIP, STRIP_BYTES = 1 << 18, 4 << 20
#: Most parities of a text.
PARITIES = 1 << 12
#: Texts drawn to see which shingles are frequent, of how many bytes at most, in how many of them such a one is, and how many are told apart.
DRAWN, DRAWN_BYTES, OFTEN, FREQUENT = 1024, 1 << 16, 4, 1 << 14


def _long_fingerprints(width: int, words: int, anchors: int, frequent: tuple[np.ndarray, np.ndarray], least: float):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {"fp": [], "anchors": [], "n": [], "parities": [], "shingles": [], "stored": []}
        for text in bytes_of(batch.column("text")):
            hashes = _hashes(text, width)
            fp, anchor = _signs(hashes, words, anchors)
            kinds = np.unique(hashes)
            asked, stored = first_shingles(kinds, frequent, least)
            for name, x in zip(out, (np.array(fp, "<u8").tobytes(), np.array(anchor, np.uint64).view(np.int64), len(kinds), parities(kinds), asked.view(np.int64), stored)):
                out[name].append(x)
        types = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32()]
        return pa.record_batch({"doc_id": batch.column("doc_id")} | {name: pa.array(x, kind) for (name, x), kind in zip(out.items(), types)})

    return over_batches(run)


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that are often met in a draw of about ``DRAWN`` texts, ascending, and their ranks, the rarest first.  texts: (doc_id, text)."""
    one_of = max(1, texts.count() // DRAWN)
    drawn = texts.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_of)) == 0) & (F.octet_length("text") <= DRAWN_BYTES)).select("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"val": np.concatenate([np.unique(_hashes(t, width)) for t in bytes_of(batch.column("text"))]).view(np.int64)})

    counts = shipped(drawn).mapInArrow(over_batches(run), "val bigint").groupBy("val").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "val").limit(FREQUENT).collect()
    known = np.array([r["val"] for r in reversed(top)], np.int64).view(np.uint64)
    return np.sort(known), np.argsort(known)


def _tied(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place reachable from each of n places over edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _near_bits(words: int, max_bits: int):
    """Which pairs of places of a table have fingerprints within ``max_bits``?"""

    def of(rows: pa.Table):
        fp = np.frombuffer(b"".join(rows["fp"].to_pylist()), "<u8").reshape(-1, words)
        return lambda x, y: np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1) <= max_bits

    return of


def _near_sets(least: float):
    """Which pairs of places of a table do sizes and parities not prove less similar than ``least``?"""

    def of(rows: pa.Table):
        n, bits = rows["n"].to_numpy(), rows["parities"].to_pylist()
        sizes = np.array([len(x) for x in bits])
        folded, at = {}, {}
        for size in np.unique(sizes).tolist():  # those of this size, and of twice the size folded to it
            own, twice = np.flatnonzero(sizes == size), np.flatnonzero(sizes == 2 * size)
            made = np.frombuffer(b"".join(bits[k] for k in own.tolist()), "<u8").reshape(len(own), -1)
            wide = np.frombuffer(b"".join(bits[k] for k in twice.tolist()), "<u8").reshape(len(twice), 2, -1) if len(twice) else np.zeros((0, 2, size // 8), np.uint64)
            folded[size], at[size] = np.concatenate([made, wide[:, 0] ^ wide[:, 1]]), np.zeros(len(n), np.int32)
            at[size][own], at[size][twice] = np.arange(len(own)), len(own) + np.arange(len(twice))

        def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            ok = np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - 1e-9
            most, common = (n[x] + n[y]) * ((1 - least) / (1 + least)) + 1e-9, np.minimum(sizes[x], sizes[y])
            apart = np.maximum(sizes[x], sizes[y]) > 2 * common  # a low ``least``: nothing is proved
            for size in np.unique(common[ok & ~apart]).tolist():
                pairs = np.flatnonzero(ok & ~apart & (common == size))
                for k in range(0, len(pairs), max(1, STRIP_BYTES // size)):
                    part = pairs[k : k + max(1, STRIP_BYTES // size)]
                    odd = np.bitwise_count(folded[size][at[size][x[part]]] ^ folded[size][at[size][y[part]]]).sum(axis=1)
                    ok[part] = odd <= most[part]
            return ok

        return close

    return of


def _meet(near):
    """Edges that connect the texts of a block which share a key and are near each other."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        close = near(rows)
        node, place = np.unique(rows["node"].to_numpy(), return_inverse=True)
        value, stored = rows["val"].to_numpy(), rows["stored"].to_numpy(zero_copy_only=False)
        s, a = np.flatnonzero(stored), np.flatnonzero(~stored)
        s = s[np.argsort(value[s], kind="stable")]
        low, high = np.searchsorted(value[s], value[a], "left"), np.searchsorted(value[s], value[a], "right")
        ends, label, done = np.cumsum(high - low), np.arange(len(node)), 0
        while done < len(a):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + STRIP)))
            for x, y in _strips(s, a[done:upto], low[done:upto], high[done:upto]):
                apart = label[place[x]] != label[place[y]]  # what is joined already adds nothing
                x, y = x[apart], y[apart]
                met = close(x, y)
                if met.any():
                    tied = _tied(label[place[x[met]]], label[place[y[met]]], len(node))
                    label = tied[label]
            done = upto
        moved = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": pa.array(node[moved]), "b": pa.array(node[label[moved]])})

    return run


def _strips(s: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(stored row, asking row) of all matches, at most about STRIP at a time."""
    sizes = high - low
    total = int(sizes.sum())
    if total <= 2 * STRIP or len(a) > 1:
        first = np.cumsum(sizes) - sizes
        at = np.arange(total) - np.repeat(first - low, sizes)
        yield s[at], np.repeat(a, sizes)
        return
    for k in range(int(low[0]), int(high[0]), STRIP):
        own = s[k : min(k + STRIP, int(high[0]))]
        yield own, np.repeat(a, len(own))


def jaccard(sizes: np.ndarray, size: int, shared: np.ndarray) -> np.ndarray:
    """Similarity of sets of these sizes to one of ``size`` with so many shared members; two empty ones are equal."""
    union = sizes + size - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def _alike(width: int, least: float):
    """Edges between the texts of a block, component by component, that are as similar as ``least``."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        node, at = np.unique(rows["node"].to_numpy(), return_index=True)
        rows = rows.take(at)
        sets = [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, x), np.uint64, len(x))) for x in (_shingles(t, width) for t in bytes_of(rows["text"]))]
        sizes = np.array([len(x) for x in sets])
        kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(flat, np.cumsum(sizes)[:-1])
        component, left = rows["component"].to_numpy(), rows["left"].to_numpy(zero_copy_only=False)
        own, label, diagonal = np.zeros(len(kinds), bool), np.arange(len(node)), key[1].as_py() == key[2].as_py()
        order = np.argsort(component, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            asking = group[left[group]]
            for k, x in enumerate(asking.tolist()):
                y = asking[k + 1 :] if diagonal else group[~left[group]]
                y = y[label[y] != label[x]]  # what is joined already adds nothing
                y = y[np.minimum(sizes[y], sizes[x]) >= (least - 1e-9) * np.maximum(sizes[y], sizes[x])]
                if not len(y):
                    continue
                own[sets[x]] = True
                shared = np.array([np.count_nonzero(own[sets[z]]) for z in y.tolist()])
                own[sets[x]] = False
                y = y[jaccard(sizes[y], int(sizes[x]), shared) >= least]
                if len(y):
                    tied = np.append(label[y], label[x])
                    label[group[np.isin(label[group], tied)]] = tied.min()
        moved = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": pa.array(node[moved]), "b": pa.array(node[label[moved]])})

    return run


def _verified(docs: DataFrame, groups: DataFrame, labels: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    """Edges (a, b) whose components are those of the pairs of a similarity of ``least``.

    labels: (id, component) such that no such pair lies across components.
    """
    tied = cut(groups.join(labels.select(F.col("id").alias("node"), "component"), "node"), "tied")
    buckets = max(1, -(-(tied.agg(F.sum("size")).first()[0] or 0) // SIDE_BYTES))
    sides = F.greatest(F.ceil(F.count("*") / SIDE), F.ceil(F.sum("size") / SIDE_BYTES))
    large = tied.groupBy("component").agg(sides.alias("sides")).where("sides > 1")
    # The list of large ones grows with the corpus: it comes back by component and a salt of the node.
    sized = answered(tied, large, ["component"], F.pmod(F.xxhash64("node"), F.lit(SALTS)), "left").withColumn("sides", F.coalesce("sides", F.lit(1)))
    bucket = F.when(F.col("sides") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(buckets)))
    # Written down, so that the join with the texts knows its size: texts move only if these are many.
    dealt = cut(sized.select("node", "component", "twice", "first.doc_id", "first.draw", "sides", bucket.alias("bucket")), "asked")
    texts = docs.select(F.col(id_col).cast("bigint").alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), F.col(text_col).cast("string").alias("text"))
    # The list grows with the corpus: it is merged with the texts at every size, in one shuffle of them.
    met = texts.hint("merge").join(dealt, F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("mark") == F.col("draw")))
    columns = ["node", "component", "sides", "bucket", "text"]
    if dealt.where("twice").isEmpty():
        once = met.select(*columns)
    else:  # rows that repeat id and text
        repeated = met.where("twice").groupBy("node").agg(F.first(F.struct(*columns[1:])).alias("row")).select("node", "row.*")
        once = met.where("not twice").select(*columns).unionByName(repeated)
    side = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("sides"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sides") - 1))
    paired = once.withColumn("own", side).withColumn("other", every)
    block = paired.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "component", "node", "text", (F.col("own") <= F.col("other")).alias("left"))
    return block.groupBy("bucket", "a", "b").applyInArrow(_alike(width, least), "a bigint, b bigint")


def _candidates(groups: DataFrame, words: int, max_bits: int) -> DataFrame:
    """Edges (a, b) of nodes, such that texts which share an anchor and a slice's ball within ``max_bits`` are connected.

    groups: (node, fp, anchors), distinct nodes.
    """
    entered = groups.select("node", "fp", F.explode(F.array_distinct("anchors")).alias("anchor"))
    met = entered.groupBy("anchor").agg(F.count("*").alias("texts")).where("texts > 1").hint("merge")
    # By anchor and a salt of the node, so that an anchor of very many texts spreads over tasks.
    salted = entered.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    told = salted.select("anchor", "salt").distinct().join(met, "anchor")
    shared = cut(salted.join(told, ["anchor", "salt"]).drop("salt", "texts"), "anchors")
    # Another slice for each anchor's place, so that several shared anchors try different slices.
    turn = F.pmod(F.col("anchor"), F.lit(64 * words // SLICE)).cast("int")
    place = lambda k: F.pmod(turn + k * (64 * words // SLICE // SLICES), F.lit(64 * words // SLICE))
    piece = lambda k: F.conv(F.hex(F.substring(F.col("fp"), place(k) + 1, F.lit(1))), 16, 10).cast("bigint")
    flips = [0, *(1 << b for b in range(SLICE))]
    stored = F.array(*[F.struct(F.lit(k).alias("seg"), piece(k).alias("val")) for k in range(SLICES)])
    asked = F.flatten(F.array(*[_ball(piece(k), k, flips) for k in range(SLICES)]))
    split = lambda what: shared.select("node", "fp", "anchor", F.explode(what).alias("key")).select("node", "fp", F.xxhash64("anchor", "key.seg", "key.val").alias("val"))
    return _met(split(stored), split(asked), shared.count() * SLICES * (SLICE + 1), SHARD, _near_bits(words, max_bits))


def _met(stored: DataFrame, asked: DataFrame, rows: int, shard_rows: int, near, beside: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that connect what is stored and what is asked for under the same ``val`` and is ``near``.

    Both: (node, val) and what ``near`` looks at, unless that stands in ``beside`` (by node) and
    is large: it then moves only once its blocks are known.  rows: about how many are asked for.
    """
    shard = F.pmod(F.xxhash64("val"), F.lit(max(1, -(-rows // shard_rows))))
    number = lambda df, name: df.groupBy(shard.alias("part")).agg(F.count("*").alias(name))
    sizes = number(stored, "s").join(number(asked, "q").hint("merge"), "part").select("part", F.ceil(F.col("s") / STORED).alias("lefts"), F.ceil(F.col("q") / ASKED).alias("rights"))
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    sized = lambda df, flag: df.withColumn("stored", F.lit(flag)).withColumn("part", shard).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(spread.hint("merge"), ["part", "salt"])
    columns = ["part", *stored.columns, "stored"]
    lefts = sized(stored, True).select(*columns, own("lefts").alias("a"), every("rights").alias("b"))
    rights = sized(asked, False).select(*columns, every("lefts").alias("a"), own("rights").alias("b"))
    dealt = lefts.unionByName(rights)
    dealt = dealt if beside is None else dealt.join(beside.hint("merge"), "node")
    return dealt.groupBy("part", "a", "b").applyInArrow(_meet(near), "a bigint, b bigint")


def _rest(rows: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of nodes, such that all texts of a similarity of ``least`` are connected.

    rows: (draw, shingles, stored), the first shingles of a text and how many of them a
    smaller one needs; rows may repeat.  groups: (node, n, parities), distinct nodes.
    """
    entered = rows.select(F.col("draw").alias("node"), "stored", F.posexplode("shingles").alias("at", "val")).select("node", "val", (F.col("at") < F.col("stored")).alias("needed"))
    met = entered.groupBy("val").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("needed").alias("needed")).where("low < high and needed").select("val")
    shared = cut(entered.join(met.hint("merge"), "val", "left_semi").distinct(), "shingles")
    return _met(shared.where("needed").drop("needed"), shared.drop("needed"), shared.count(), SHINGLES, _near_sets(least), groups.select("node", "n", "parities"))


def _similar(docs: DataFrame, id_col: str, text_col: str, width: int, words: int, max_bits: int, anchors: int, least: float) -> DataFrame:
    """(doc_id, draw, component_id, kept) of every row; draw is a hash of the text.

    kept marks the rows whose (doc_id, draw) is the least of its component, ids that are not null first.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequent = _frequent(texts, width)
    rows = texts.select(F.struct("doc_id", F.xxhash64("text").alias("draw"), F.octet_length("text").alias("size")).alias("doc_id"), "text")
    columns = "doc_id struct<doc_id bigint, draw bigint, size int>, fp binary, anchors array<bigint>, n bigint, parities binary, shingles array<bigint>, stored int"
    made = shipped(rows).mapInArrow(_long_fingerprints(width, words, anchors, frequent, least), columns)
    rows = cut(made.select("doc_id.doc_id", "doc_id.draw", "doc_id.size", "fp", "anchors", "n", "parities", "shingles", "stored", F.spark_partition_id().alias("part")), "fps")
    # A node is a text: equal fingerprints say no more of their texts than near ones.  first: its least id; twice: do rows repeat that?
    of_text = ["fp", "anchors", "n", "parities"]
    ids = rows.groupBy("draw", *of_text, "doc_id").agg(F.count("*").alias("m"), F.max("size").cast("bigint").alias("size"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "draw", (F.col("m") > 1).alias("twice"))).alias("first")
    kinds = ids.groupBy(F.col("draw").alias("node"), *of_text).agg(first, F.max("size").alias("size"))
    kinds = kinds.select("node", *of_text, F.col("first").dropFields("twice").alias("first"), F.col("first.twice").alias("twice"), "size")
    groups = cut(kinds, "fpgroups")
    edges = _candidates(groups.select("node", "fp", "anchors"), words, max_bits).unionAll(_rest(rows, groups, least))
    alike = _verified(docs, groups, components(edges), id_col, text_col, width, least)
    led = component_least(groups, components(alike), "node", "first", "least").select(F.col("node").alias("draw"), F.col("least").alias("lead"))
    told = rows.select("draw", "part").distinct().join(led, "draw")
    out = rows.join(told, ["draw", "part"])
    kept = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("draw") == F.col("lead.draw"))
    return out.select("doc_id", "draw", F.col("lead.doc_id").alias("component_id"), kept.alias("kept"))


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, words: int = 3, max_bits: int = 40, anchors: int = 4, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: its id, component_id and kept, for copies of a similarity of ``least`` or more.

    words: 64-bit fingerprints taken together, max_bits: the distance within which the tables
    by fingerprint give candidates; pairs beyond it are found by their first shingles.  Of rows
    repeating the least id, those with the least hash of their text are kept.
    """
    return _similar(docs, id_col, text_col, width, words, max_bits, anchors, least).select(F.col("doc_id").alias(id_col), "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, words: int = 3, max_bits: int = 40, anchors: int = 4, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component of ``similar_dedup``.

    It is the row of the component's least id, of rows repeating that id the one with
    the least hash of its text, and of rows that repeat both the one whose other
    columns have the least hash.  What comes back to the rows is the (id, text hash) of
    those that go, and of those that repeat both; documents move only where these are many.
    """
    verdicts = _similar(docs, id_col, text_col, width, words, max_bits, anchors, least)
    told = cut(verdicts.groupBy("doc_id", "draw").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "told")
    rows = docs.select(whole(docs).alias("doc"), F.col(id_col).cast("bigint").alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"))
    same = F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("mark") == F.col("draw"))
    stays = rows.join(told, same, "left_anti").select("doc.*")
    if told.where("kept").isEmpty():
        return stays
    repeated = rows.join(told.where("kept"), same).groupBy("key", "mark").agg(F.min_by("doc", F.xxhash64(F.to_json("doc"))).alias("doc"))
    return stays.unionByName(repeated.select("doc.*"))
