"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than ``chunk_chars`` is cut into overlapping chunks that different
tasks pre-tokenise.  Pre-token matching from a position depends only on what
follows, so two chunks that both have a boundary at one place of their overlap
agree from there on: that place is a seam.  The stitch walks the chunks of a
document from its start, takes a seam in each overlap, and where an overlap holds
none it leaves the neighbours (and all after them that no seam certifies) in one
piece, which is slower but exact.  The pieces between seams are encoded in
parallel and their ids concatenated.  Shorter texts are one piece.  Chunks and pieces
are sliced off a text one after another, in time proportional to its length.

Within a piece the encoder works on segments, white space and the run after it:
a match of the pattern never runs from other characters into white space, so a
segment's ids depend on the segment alone and are remembered for the next time.
Decoding looks every id's bytes up and concatenates them.

Nulls and empty texts give no ids.  Rows with a null or repeated id are encoded
as rows of their own.  An empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import shipped, sliced
from edgeloom.plans.lineage import cut

#: The characters with Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Segments a worker remembers before it starts afresh, and the longest one (in characters) it does.
REMEMBERED, LONGEST = 300_000, 64
#: Characters beyond its end that a match may depend on: an apostrophe is a match of its own unless two more make a contraction.
AHEAD = 2
#: Slices of a long text that a batch holds.
SLICES = 64


class _Codec(dict):
    """Ids (packed little-endian) by segment."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        super().__init__()
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.lengths = np.array([len(x) for x in self.pieces], np.int64)
        self.segments = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

    def __missing__(self, segment: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(segment), "<u4").tobytes()
        if len(segment) <= LONGEST:
            self[segment] = ids
        return ids

    def _learn(self, segments: set[str]) -> None:
        """Encode new segments in one call: as each begins with white space and ends without, they stay apart when set end to end."""
        new = [s for s in segments if s not in self and s[0] in WHITE and s[-1] not in WHITE and len(s) <= LONGEST]
        if not new:
            return
        ids = np.array(self.encoding.encode_ordinary("".join(new)), "<u4")
        ends = np.cumsum(self.lengths[ids])
        last = np.searchsorted(ends, np.cumsum([len(s.encode()) for s in new]))
        raw, at = ids.tobytes(), 0
        for s, k in zip(new, (last + 1).tolist()):
            self[s] = raw[4 * at : 4 * k]
            at = k

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        split = [self.segments.findall(t) if t else [] for t in texts]
        distinct: set[str] = set()
        for s in split:
            distinct.update(s)
        if len(self) + len(distinct) > REMEMBERED:
            self.clear()
        self._learn(distinct)
        return [b"".join(map(self.__getitem__, s)) for s in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> _Codec:
    """The codec of a rank file that lies at ``path`` on every executor."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _Codec(ranks, pattern)


def boundaries(chunk: str, pattern: str, last: bool) -> list[int]:
    """Where matches of a chunk end, as far as a text may be cut there.

    Left out are ends that the chunk's own end leaves open (AHEAD characters must
    follow) and those after white space, as a run of it matches differently where a
    text ends.
    """
    import regex

    ends = [m.end() for m in regex.finditer(pattern, chunk)]
    return [e for e in ends if (last or e <= len(chunk) - AHEAD) and chunk[e - 1] not in WHITE]


def seams(found: list[tuple[int, list[int]]]) -> list[int]:
    """Where to cut a document: found has (start, boundaries in the whole text) of each chunk in order.

    A chunk counts once a true boundary is known in it; the first one's start is true.
    After an overlap without a common boundary no later one is certified, so the rest stays whole.
    """
    cuts, true_from = [0], 0
    for (_, own), (start, following) in zip(found, found[1:]):
        later = set(following)
        at = next((p for p in own[bisect.bisect_left(own, max(start, true_from)) :] if p in later), None)
        if at is None:
            break
        cuts.append(at)
        true_from = at
    return cuts


def _digest(ids: bytes, path: str, pattern: str) -> tuple:
    raw = codec(path, pattern).decode(ids)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()


def _encode(path: str, pattern: str, digests: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            use = codec(path, pattern)
            ids = use.encode_all(batch.column("text").to_pylist())
            rest = {k: batch.column(k) for k in batch.schema.names if k != "text"}
            if digests:
                n, a, b = zip(*(_digest(x, path, pattern) for x in ids)) if ids else ((), (), ())
                yield pa.record_batch(rest | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})
            else:
                yield pa.record_batch(rest | {"ids": pa.array(ids, pa.binary())})

    return run


def _in_batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, SLICES)):
        yield pa.record_batch({k: pa.array(v, t) for k, t, v in zip(names, kinds, zip(*part), strict=True)})


def _chunks(size: int, overlap: int):
    """(row, start, last, text) of the overlapping chunks of each text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it, 1):
            row, text = batch.column("row")[0].as_py(), batch.column("text")[0].as_py()
            rows = ((row, k, k + size + overlap >= len(text), text[k : k + size + overlap]) for k in range(0, len(text), size))
            yield from _in_batches(rows, ["row", "start", "last", "text"], [pa.string(), pa.int64(), pa.bool_(), pa.string()])

    return run


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, at, text) of the pieces between the cuts of each text."""
    for batch in sliced(it, 1):
        row, doc_id, text, cuts = (batch.column(c)[0].as_py() for c in ("row", "doc_id", "text", "cuts"))
        rows = ((row, doc_id, at, text[at:end]) for at, end in zip(cuts, [*cuts[1:], len(text)]))
        yield from _in_batches(rows, ["row", "doc_id", "at", "text"], [pa.string(), pa.int64(), pa.int64(), pa.string()])


def _ends(pattern: str, overlap: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            starts, lasts, out = batch.column("start").to_pylist(), batch.column("last").to_pylist(), []
            for start, last, text in zip(starts, lasts, batch.column("text").to_pylist()):
                own = boundaries(text, pattern, last)
                out.append([start + p for p in own if p < overlap or p >= len(text) - overlap])
            yield pa.record_batch({"row": batch.column("row"), "start": batch.column("start"), "near": pa.array(out, pa.list_(pa.int64()))})

    return run


def _stitch(key: tuple, rows: pa.Table) -> pa.Table:
    found = sorted(zip(rows["start"].to_pylist(), rows["near"].to_pylist()))
    return pa.table({"row": pa.array([key[0].as_py()], pa.string()), "cuts": pa.array([seams(found)], pa.list_(pa.int64()))})


def _join_pieces(path: str, pattern: str, digests: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        parts = sorted(zip(rows["at"].to_pylist(), rows["ids"].to_pylist()))
        ids = b"".join(x for _, x in parts)
        out = {"doc_id": pa.array([rows["doc_id"][0].as_py()], pa.int64())}
        if digests:
            n, a, b = _digest(ids, path, pattern)
            return pa.table(out | {"n_tokens": pa.array([n], pa.int64()), "ids_sha256": [a], "decoded_sha256": [b]})
        return pa.table(out | {"ids": pa.array([ids], pa.binary())})

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 1 << 15, overlap: int = 1 << 9, digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id and its ids as packed little-endian u32.

    With ``digests``, n_tokens, ids_sha256 and decoded_sha256 (of the ids decoded
    again) stand in place of the ids.  path: rank file, on every executor.
    """
    out = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    short = shipped(rows).where(~is_long).mapInArrow(_encode(path, pattern, digests), f"doc_id bigint, {out}")
    # Long texts are few; each gets a name of its own, written down so that it is the same in all that follows.
    long = cut(rows.where(is_long).withColumn("row", F.concat_ws(":", F.spark_partition_id(), F.monotonically_increasing_id())), "long-texts")
    chunks = long.select("row", "text").mapInArrow(_chunks(chunk_chars, overlap), "row string, start bigint, last boolean, text string")
    near = chunks.repartition("row", "start").mapInArrow(_ends(pattern, overlap), "row string, start bigint, near array<bigint>")
    cuts = near.groupBy("row").applyInArrow(_stitch, "row string, cuts array<bigint>")
    pieces = long.join(cuts, "row").select("row", "doc_id", "text", "cuts").mapInArrow(_pieces, "row string, doc_id bigint, at bigint, text string")
    coded = pieces.repartition("row", "at").mapInArrow(_encode(path, pattern, False), "row string, doc_id bigint, at bigint, ids binary")
    joined = coded.groupBy("row").applyInArrow(_join_pieces(path, pattern, digests), f"doc_id bigint, {out}")
    return short.unionByName(joined).withColumnRenamed("doc_id", id_col)


def _decode(path: str, pattern: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            use = codec(path, pattern)
            raw = [None if x is None else use.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "bytes": pa.array(raw, pa.binary())})

    return run


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes) of each row of packed ids; the bytes of all ids, concatenated."""
    rows = shipped(encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), "ids"))
    return rows.mapInArrow(_decode(path, pattern), "doc_id bigint, bytes binary").withColumnRenamed("doc_id", id_col)
