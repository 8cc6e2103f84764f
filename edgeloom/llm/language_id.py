"""Language ID: a bidirectional gated recurrent network over bytes.

Two GRUs read a text's bytes (ASCII letters folded to lower case), one from either
end, across words and white space, and a softmax over both states labels every byte
position.  A document pools the positions of its whole text: the mean log
probability of each language, made to sum to one.

So that very long texts neither wait on themselves nor stay in one piece, a text is
cut into cores of ``CORE`` bytes, and each core is read together with the ``MARGIN``
bytes before and after it: a state starts from zero that far outside the core (or at
the text's end).  What a position sees depends on its text alone, so labels are the
same whatever rows are read with it.

The network is trained in numpy by backpropagation through time, with Adam, on a
bounded sample of labelled rows: of each language at most ``docs_per_lang`` whole
texts, distinct, of the least hashes, and no more once they hold ``bytes_per_lang``
bytes; texts over ``longest`` bytes are drawn only where a language has no others.
Training always takes the same number of steps.  Only distinct texts per language
are counted (approximately) over the whole table.

Nulls: a text that is null or has no letter is ``und`` with score 0.  Rows with a
null lang are never learnt from, and neither are rows of the held-out fold; with no
training row every text is ``und``.  A null id counts as empty text when the fold is
drawn; rows that repeat are one in the sample.  Ties between languages go to the
first in order.  Repeated rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import bytes_of, fold, shipped, sliced, whole

HIDDEN, CORE, MARGIN = 16, 112, 16
#: Windows that are read at once, in use and in training, and the steps of training.
STRIP, BATCH, TURNS = 1024, 64, 700
UNKNOWN = "und"


class Direction:
    """One GRU.  Parameters: input table by byte (z, r, n), recurrent matrix, biases of the recurrent part."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.x = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b]

    def run(self, seen: np.ndarray, inside: np.ndarray, keep: list) -> np.ndarray:
        """States (time, row, hidden) over bytes seen (time, row), and in ``keep`` what ``back`` needs; a state outside its text is zero."""
        size = self.u.shape[0]
        h, out = np.zeros((seen.shape[1], size), np.float32), np.empty((*seen.shape, size), np.float32)
        for t, column in enumerate(seen):
            a, g = self.x[column], h @ self.u + self.b
            gates = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * size] + g[:, : 2 * size]))  # a logistic function is a scaled tanh
            z, r, inner = gates[:, :size], gates[:, size:], g[:, 2 * size :]
            n = np.tanh(a[:, 2 * size :] + r * inner)
            keep.append((h, z, r, inner, n))
            h = (n + z * (h - n)) * inside[t][:, None]
            out[t] = h
        return out

    def read(self, seen: np.ndarray, inside: np.ndarray, v: np.ndarray, raw: np.ndarray) -> None:
        """As ``run``, but only adds each state's part of the output, times ``v``, to ``raw`` (time, label, row).

        The unit's place comes before the row's, so that every step works on whole rows of memory, in place.
        """
        size, rows = self.u.shape[0], seen.shape[1]
        # Halved beforehand, the gates need no scaling: logistic(x) = (1 + tanh(x / 2)) / 2.
        half = np.repeat(np.float32([0.5, 1]), [2 * size, size])
        x, u = np.ascontiguousarray((self.x + np.concatenate([self.b[: 2 * size], np.zeros(size, np.float32)])) * half).T.copy(), np.ascontiguousarray((self.u * half).T)
        inner_b = self.b[2 * size :, None]
        h, a, g = np.zeros((size, rows), np.float32), np.empty((3 * size, rows), np.float32), np.empty((3 * size, rows), np.float32)
        part, all_in = np.empty((v.shape[1], rows), np.float32), inside.all(axis=1)
        vt = np.ascontiguousarray(v.T)
        for t, column in enumerate(seen):
            np.take(x, column, axis=1, out=a, mode="clip")
            np.matmul(u, h, out=g)
            gates, n, inner = a[: 2 * size], a[2 * size :], g[2 * size :]
            gates += g[: 2 * size]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            inner += inner_b
            inner *= gates[size:]
            n += inner
            np.tanh(n, out=n)
            h -= n
            h *= gates[:size]
            h += n
            if not all_in[t]:
                h *= inside[t]
            np.matmul(vt, h, out=part)
            raw[t] += part

    def back(self, seen: np.ndarray, inside: np.ndarray, kept: list, grads: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, from those of the states, back through time."""
        dx, du, db = (np.zeros_like(p) for p in self.parameters())
        carry, steps = np.zeros_like(grads[0]), []
        for t in range(len(seen) - 1, -1, -1):
            h, z, r, inner, n = kept[t]
            d = (grads[t] + carry) * inside[t][:, None]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            steps.append(np.concatenate([dz, dr, dn], axis=1))
            du += h.T @ dg
            db += dg.sum(axis=0)
            carry = d * z + dg @ self.u.T
        # One sum per byte value.
        flat = seen[::-1].ravel()
        order = np.argsort(flat, kind="stable")
        kinds, at = np.unique(flat[order], return_index=True)
        dx[kinds] = np.add.reduceat(np.concatenate(steps)[order], at, axis=0)
        return [dx, du, db]


@dataclass
class Network:
    """Both directions and the output layer; labels are its languages in order."""

    labels: list[str]
    hidden: int = HIDDEN
    seed: int = 7
    parts: list[Direction] = field(init=False)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.parts = [Direction(rng, self.hidden), Direction(rng, self.hidden)]
        self.v = (rng.standard_normal((2 * self.hidden, len(self.labels))) / np.sqrt(2 * self.hidden)).astype(np.float32)
        self.c = np.zeros(len(self.labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [p for d in self.parts for p in d.parameters()] + [self.v, self.c]

    def states(self, seen: np.ndarray, inside: np.ndarray, keep: list) -> np.ndarray:
        keep.extend(([], []))
        ahead = self.parts[0].run(seen, inside, keep[0])
        behind = self.parts[1].run(seen[::-1], inside[::-1], keep[1])[::-1]
        return np.concatenate([ahead, behind], axis=2)

    def log_p(self, states: np.ndarray) -> np.ndarray:
        raw = states @ self.v + self.c
        raw -= raw.max(axis=-1, keepdims=True)
        raw -= np.log(np.exp(raw).sum(axis=-1, keepdims=True))
        return raw

    def label(self, seen: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Log probabilities (time, label, row) of every position of windows (time, row)."""
        raw = np.empty((len(seen), len(self.labels), seen.shape[1]), np.float32)
        raw[:] = self.c[:, None]
        self.parts[0].read(seen, inside, self.v[: self.hidden], raw)
        self.parts[1].read(seen[::-1], inside[::-1], self.v[self.hidden :], raw[::-1])
        raw -= raw.max(axis=1, keepdims=True)
        raw -= np.log(np.exp(raw).sum(axis=1, keepdims=True))
        return raw

    def gradients(self, seen: np.ndarray, inside: np.ndarray, counted: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over the positions counted."""
        keep: list = []
        states = self.states(seen, inside, keep)
        d = np.exp(self.log_p(states))
        d[:, np.arange(len(targets)), targets] -= 1
        d *= counted[:, :, None] / max(1, counted.sum())
        d = d.astype(np.float32)
        ds, h = d @ self.v.T, self.hidden
        first = self.parts[0].back(seen, inside, keep[0], ds[..., :h])
        second = self.parts[1].back(seen[::-1], inside[::-1], keep[1], ds[::-1, :, h:])
        return [*first, *second, np.einsum("tbi,tbj->ij", states, d), d.sum(axis=(0, 1))]

    def fit(self, texts: list[bytes], targets: np.ndarray, rate: float = 0.01) -> None:
        """Adam for ``TURNS`` steps of ``BATCH`` windows, which go round over all windows of the texts."""
        rng = np.random.default_rng(self.seed)
        made = Windows(texts)
        target = targets[made.doc]
        parameters = self.parameters()
        one, two = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        queue = np.zeros(0, np.int64)
        for step in range(1, TURNS + 1):
            while len(queue) < BATCH:
                queue = np.concatenate([queue, rng.permutation(len(target))])
            own, queue = queue[:BATCH], queue[BATCH:]
            pace = rate * 0.03 ** (step / TURNS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, a, b, g in zip(parameters, one, two, self.gradients(*made.rows(own), target[own]), strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= pace * a / (np.sqrt(b) + 1e-8)


class Windows:
    """The windows of texts: each core with its margins.  doc: the text of each window."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        cores = -(-sizes // CORE)
        self.raw = np.frombuffer(b"".join(texts).lower(), np.uint8)
        first = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(texts)), cores)
        k = np.arange(int(cores.sum())) - np.repeat(np.cumsum(cores) - cores, cores)
        begin, end = first[self.doc], (first + sizes)[self.doc]
        self.core = begin + k * CORE
        self.stop = np.minimum(self.core + CORE, end)
        self.low, self.high = np.maximum(self.core - MARGIN, begin), np.minimum(self.stop + MARGIN, end)

    def rows(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, is it in the window, is it in the core) of windows, each (time, row)."""
        at = self.low[own] + np.arange(int((self.high - self.low)[own].max(initial=0)))[:, None]
        inside = at < self.high[own]
        counted = inside & (at >= self.core[own]) & (at < self.stop[own])
        return self.raw[np.minimum(at, len(self.raw) - 1)], inside, counted

    def strips(self) -> Iterator[np.ndarray]:
        """All windows, those of like length together."""
        order = np.argsort(self.high - self.low, kind="stable")
        for k in range(0, len(order), STRIP):
            yield order[k : k + STRIP]


def pool(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probabilities (text, language); texts without bytes get equal ones."""
    total, made = np.zeros((len(texts), len(net.labels))), Windows(texts)
    for own in made.strips():
        seen, inside, counted = made.rows(own)
        labels = net.label(seen, inside)
        labels *= counted[:, None, :]
        np.add.at(total, made.doc[own], labels.sum(axis=0, dtype=float).T)
    mean = total / np.maximum([[len(t)] for t in texts], 1) if texts else total
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


#: Bytes of text that are laid out at once.
HELD = 2 << 20


def _answers(net: Network | None, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """(lang_pred, score) of a batch's texts."""
    column = batch.column("text")
    lettered = np.array([t is not None and has_letter(t) for t in column.to_pylist()], bool)
    if net is None or not len(lettered):
        return [UNKNOWN] * len(lettered), np.zeros(len(lettered))
    texts = [t if x else b"" for t, x in zip(bytes_of(column), lettered.tolist())]
    parts, low, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= HELD or k == len(texts) - 1:
            parts.append(pool(net, texts[low : k + 1]))
            low, size = k + 1, 0
    p = np.concatenate(parts)
    best = p.argmax(axis=1)
    return [net.labels[k] if x else UNKNOWN for k, x in zip(best.tolist(), lettered.tolist())], np.where(lettered, p[np.arange(len(p)), best], 0.0)


def _predict(net: Network | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            names, score = _answers(net, batch)
            yield pa.record_batch({k: batch.column(k) for k in batch.schema.names if k != "text"} | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())})

    return run


def _keep(net: Network | None, least: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            names, score = _answers(net, batch)
            yield batch.select(["row"]).filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, score.tolist())], pa.bool_()))

    return run


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held: int, docs_per_lang: int, bytes_per_lang: int, longest: int) -> Network | None:
    """The network learnt from the training fold, or None if it has no labelled row.

    The network has an output for each language, so languages are few by nature; the driver
    holds one row of figures for each and about three times ``docs_per_lang`` texts.
    """
    draws = 1 << 40
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("bigint").alias("doc_id"))
    rows = rows.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0) & (fold(F.col("doc_id"), folds) != held))
    rows = rows.select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(draws)).alias("draw"), (F.octet_length("text") > longest).alias("is_long"))
    short, long = F.approx_count_distinct(F.when(~F.col("is_long"), F.col("draw"))), F.approx_count_distinct(F.when(F.col("is_long"), F.col("draw")))
    counts = {r["lang"]: (r["short"], r["long"]) for r in rows.groupBy("lang").agg(short.alias("short"), long.alias("long")).collect()}
    if not counts:
        return None
    # Two to three times the bound of each language, by hash; the driver takes the least of them.
    bound = lambda n: min(draws, draws * (2 * docs_per_lang + 40) // max(1, n))
    of = F.create_map(*[F.lit(x) for lang, (short, long) in counts.items() for x in (lang, bound(short or long))])
    wanted = F.create_map(*[F.lit(x) for lang, (short, _) in counts.items() for x in (lang, short == 0)])
    drawn = rows.where((F.col("draw") < of[F.col("lang")]) & (F.col("is_long") == wanted[F.col("lang")]))
    got = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text")).collect()
    labels, texts, targets = sorted(counts), [], []
    for k, lang in enumerate(labels):
        size = 0
        for r in sorted((r for r in got if r["lang"] == lang), key=lambda r: r["draw"])[:docs_per_lang]:
            if size >= bytes_per_lang:
                break
            texts.append(r["text"].encode())
            targets.append(k)
            size += len(texts[-1])
    net = Network(labels)
    net.fit(texts, np.array(targets))
    return net


#: The bounds of the training sample: rows and bytes of a language, and the longest text that is drawn where there are others.
SAMPLE = {"docs_per_lang": 300, "bytes_per_lang": 1 << 19, "longest": 1 << 16}


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, **sample: int) -> DataFrame:
    """One row per row of ``docs``: its id, held_out, lang_pred and score (the pooled probability of lang_pred).

    sample: other bounds than those of ``SAMPLE``.
    """
    net = train(docs, id_col, text_col, lang_col, folds, held, **(SAMPLE | sample))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    out = shipped(rows).mapInArrow(_predict(net), "doc_id bigint, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("doc_id", id_col)


def keep_known(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, **sample: int) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``least`` or more; all columns as they are.

    The rows are labelled in place, so texts do not move and repeated ids need no
    join.  Without a labelled row to learn from nothing can be rejected: texts with a letter stay.
    """
    net = train(docs, id_col, text_col, lang_col, folds, held, **(SAMPLE | sample))
    if net is None:
        return docs.where(F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    packed = docs.select(whole(docs).alias("row"), F.col(text_col).cast("string").alias("text"))
    return shipped(packed).mapInArrow(_keep(net, least), packed.select("row").schema).select("row.*")
