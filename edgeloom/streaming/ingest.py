"""Ingest drivers: edge files, frames or streams into a versioned graph store, batch by batch.

Each batch commits one small version, tagged with its stream and batch id; a batch
that is replayed after a failure finds its id among those of its own stream and does
nothing.  Any number of streams may share a store.  Queries read the latest finished
version.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgeloom.operators.mutate import BatchStats, batch_ids, batch_removals, batch_stats, missing_after_ingest, present_after_delete
from edgeloom.plans.lineage import discard, new_path
from edgeloom.sources.edge_list import read_edge_list
from edgeloom.sources.store import change, last_batch, load


def edge_stream(spark: SparkSession, path: str, weighted: bool = False, id_base: int = 0, files_per_batch: int = 1) -> DataFrame:
    """(src, dst[, weight]) rows of the text files that arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    parts = F.split(F.trim("value"), r"\s+")
    item = lambda k, kind: F.try_element_at(parts, F.lit(k)).try_cast(kind)
    out = lines.select((item(1, "bigint") - id_base).alias("src"), (item(2, "bigint") - id_base).alias("dst"), *([item(3, "int").alias("weight")] if weighted else []))
    return out.where("src is not null and dst is not null")


def apply_once(store: str, stream: str, delete: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that changes the store, and does nothing with a batch its stream has committed."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if last_batch(batch.sparkSession, store, stream) < batch_id:
            change(store, batch, delete, stream, batch_id)

    return run


def ingest(stream: DataFrame, store: str, checkpoint: str, delete: bool = False) -> StreamingQuery:
    """Start inserting (or deleting) a stream's edges in the store; ends when what has arrived is done.

    The checkpoint folder names the stream: started again with it, it goes on where it was.
    """
    writer = stream.writeStream.foreachBatch(apply_once(store, checkpoint, delete)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and milliseconds of each batch so far."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["durationMs"].get("triggerExecution")} for p in query.recentProgress]


def ingest_in_batches(raw: DataFrame, store: str, batch_size: int = 1_000_000, delete: bool = False, verify: bool = False, num_batches: int | None = None) -> list[BatchStats]:
    """Insert (or delete) the edges of ``raw`` batch by batch, a version each.

    raw: (pos, src, dst[, weight]) with gapless pos from 0, as ``read_edge_list``
    gives.  A batch stores about ``batch_size`` edges; the last of ``num_batches``
    takes the rest.  Batches are dealt into folders once and their figures counted
    in one pass, so a batch reads and writes its own rows only; the driver keeps one
    row of figures per batch.  With ``verify`` a batch that isn't fully in (or out
    of) the graph raises.
    """
    spark, out = raw.sparkSession, []
    graph = load(spark, store)
    path = new_path(spark, "batches")
    batch_ids(raw, batch_size, graph.directed, num_batches).write.partitionBy("batch_id").parquet(path)
    schema = raw.schema
    stored = graph.edges.select("src", "dst")
    made = batch_removals(raw, batch_size, graph.directed, stored, num_batches) if delete else batch_stats(raw, batch_size, graph.directed, num_batches, stored)
    for k, attempted, changed in sorted(tuple(r) for r in made.collect()):
        began = time.perf_counter()
        batch = spark.read.schema(schema).parquet(f"{path}/batch_id={k}")
        change(store, batch, delete)
        took = time.perf_counter() - began
        if verify and not (present_after_delete if delete else missing_after_ingest)(load(spark, store), batch).isEmpty():
            raise RuntimeError(f"batch {k} is not fully {'deleted' if delete else 'stored'}")
        out.append(BatchStats(k, attempted, changed, took))
    discard(path, spark)
    return out


def ingest_file(spark: SparkSession, path: str, store: str, weighted: bool = False, id_base: int = 0, sep: str = r"\s+", **options) -> list[BatchStats]:
    """``ingest_in_batches`` of an edge-list file."""
    return ingest_in_batches(read_edge_list(spark, path, weighted, id_base, sep), store, **options)
