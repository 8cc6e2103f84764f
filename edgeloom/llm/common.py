"""What the corpus operators share: reading tables, word rules and chunked text."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: The white space of every contract here: space and tab to carriage return.  bytes.split() has the same six.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a batch that a Python worker takes up at once.
ROWS = 256
#: Bytes of an Arrow batch, unless the session asks for less.
BATCH_BYTES = 8 << 20
#: Partitions that chunks are dealt over at most; beyond it a partition holds several chunks, taken up one by one.
PARTITIONS = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no path to it."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _shipped or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="edgeloom-")) / "edgeloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shipped(df: DataFrame) -> DataFrame:
    """The same frame, after seeing to it that Python workers have this package and get at most ``BATCH_BYTES`` at once.

    Spark reads that bound when a plan runs, so it stays set for the session; it changes no result.
    """
    ship(df.sparkSession)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession.conf.get(bound).rstrip("b")) > BATCH_BYTES:
        df.sparkSession.conf.set(bound, str(BATCH_BYTES))
    return df


def sliced(it: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches (Spark bounds their bytes) in parts of at most ``rows`` rows, without copying."""
    for batch in it:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def runs_of(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each distinct key, ascending, with its places in order; one sort, however many keys there are."""
    order = np.argsort(keys, kind="stable")
    distinct, at = np.unique(keys[order], return_index=True)
    return list(zip(distinct.tolist(), np.split(order, at[1:]))) if len(keys) else []


def whole(df: DataFrame, leave: str | None = None) -> Column:
    """All columns of a frame, but one to ``leave``, as a struct; their names may hold anything."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c != leave])


def bytes_of(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def fold(key: Column, n: int) -> Column:
    """crc32 of the key written as text, modulo n; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def answered(rows: DataFrame, answers: DataFrame, keys: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """``rows`` with what ``answers`` has on their keys; a key of very many rows is dealt over tasks by ``salt``."""
    salted = rows.withColumn("salt", salt)
    spread = salted.select(*keys, "salt").distinct().join(answers, keys)
    return salted.join(spread, [*keys, "salt"], how).drop("salt")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one aggregate that reads only the text column."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def chunked(docs: DataFrame, id_col: str, text_col: str, bytes_each: int, size: int | None = None, carry: bool = False) -> tuple[DataFrame, int]:
    """Deal documents into chunks of about ``bytes_each`` bytes of text, by a hash of id and text.

    Rows that repeat an id, or have none, thus spread over chunks by their texts; only
    rows that repeat both stay together.  The hash is of values alone, so that every
    step, retry and lost executor deals alike.
    Returns (chunk, doc_id, text), and with ``carry`` a struct ``doc`` of all other
    columns, hash-partitioned by chunk, and the number of chunks.  Steps that refer
    to it in one plan share its single text shuffle.
    """
    ship(docs.sparkSession)
    size = text_bytes(docs, text_col) if size is None else size
    n = max(1, -(-size // bytes_each))
    others = [whole(docs, text_col).alias("doc")] if carry else []
    dealt = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *others)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("bigint"))
    return dealt.select("chunk", "doc_id", "text", *["doc"] * carry).repartition(min(n, PARTITIONS), "chunk"), n


def over_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that takes a batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(it):
            if (out := fn(batch)) is not None:
                yield out

    return run
