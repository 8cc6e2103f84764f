"""Versioned graph snapshots, kept as a base and small changes.

A version is a folder ``v=N``: a *base* holds all edges, clustered by source so that
point lookups and neighbour scans prune row groups; a *change* holds the distinct
edges one batch adds or removes, and the ids it registers, so committing a batch
costs what the batch holds.  A version is its base with the changes since, in order:
of a pair that changed, at most one row a change is replayed.  After ``CHANGES``
changes the next commit writes a base again.  The metadata row is written last; a
version without one was never finished and is not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from edgeloom.model import EDGES, VERTICES, WEIGHTED_EDGES, Graph, edge_columns, empty_graph, endpoints
from edgeloom.operators.mutate import KEY, batch_edges, batch_keys

META = "version bigint, base bigint, capacity bigint, directed boolean, weighted boolean, stream string, batch bigint"
#: Changes upon a base before a base is written again.
CHANGES = 16


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The metadata rows of all finished versions."""
    if not _exists(spark, f"{path}/meta"):
        return spark.createDataFrame([], META)
    return spark.read.schema(META).parquet(f"{path}/meta")


def latest(spark: SparkSession, path: str) -> Row | None:
    return versions(spark, path).orderBy(F.desc("version")).limit(1).first()


def last_batch(spark: SparkSession, path: str, stream: str) -> int:
    """The largest batch id that a stream has committed, -1 if none."""
    return versions(spark, path).where(F.col("stream") == stream).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def _finish(spark: SparkSession, path: str, row: tuple) -> int:
    spark.createDataFrame([row], META).coalesce(1).write.mode("append").parquet(f"{path}/meta")
    return row[0]


def commit(graph: Graph, path: str, stream: str | None = None, batch: int = -1) -> int:
    """Write the whole graph as the next version, a base, and return its number."""
    spark = graph.edges.sparkSession
    now = latest(spark, path)
    version = 0 if now is None else now["version"] + 1
    graph.edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/v={version}/edges")
    graph.vertices.write.mode("overwrite").parquet(f"{path}/v={version}/vertices")
    return _finish(spark, path, (version, version, graph.given, graph.directed, graph.weighted, stream, batch))


def change(path: str, batch: DataFrame, delete: bool = False, stream: str | None = None, number: int = -1) -> int:
    """Insert (or delete) a batch of edges as the next version and return its number.

    As ``insert_edges`` and ``delete_edges`` do: a stored edge keeps its weight,
    endpoints of inserted edges are registered, unknown victims change nothing.
    """
    spark = batch.sparkSession
    now = latest(spark, path)
    if now is None:
        raise FileNotFoundError(f"no finished snapshot in {path}")
    graph = Graph(spark.createDataFrame([], WEIGHTED_EDGES if now["weighted"] else EDGES), spark.createDataFrame([], VERTICES), now["capacity"], now["directed"], now["weighted"])
    version, at = now["version"] + 1, f"{path}/v={now['version'] + 1}"
    if delete:
        batch_keys(graph, batch).withColumn("gone", F.lit(True)).write.mode("overwrite").parquet(f"{at}/changes")
    else:
        batch_edges(graph, batch).withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{at}/changes")
        endpoints(spark.read.parquet(f"{at}/changes")).write.mode("overwrite").parquet(f"{at}/vertices")
    if version - now["base"] <= CHANGES:
        return _finish(spark, path, (version, now["base"], now["capacity"], now["directed"], now["weighted"], stream, number))
    whole = _graph(spark, path, now["base"], version, now)
    whole.edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{at}/edges")
    whole.vertices.write.mode("overwrite").parquet(f"{at}/all")
    return _finish(spark, path, (version, version, now["capacity"], now["directed"], now["weighted"], stream, number))


def _vertices(spark: SparkSession, path: str, version: int) -> DataFrame:
    at = f"{path}/v={version}"
    return spark.read.schema(VERTICES).parquet(f"{at}/all" if _exists(spark, f"{at}/all") else f"{at}/vertices")


def _graph(spark: SparkSession, path: str, base: int, version: int, meta: Row) -> Graph:
    schema = WEIGHTED_EDGES if meta["weighted"] else EDGES
    columns = edge_columns(meta["weighted"])
    edges, vertices = spark.read.schema(schema).parquet(f"{path}/v={base}/edges"), _vertices(spark, path, base)
    later = [k for k in range(base + 1, version + 1) if _exists(spark, f"{path}/v={k}/changes")]
    if later:
        kind = "src bigint, dst bigint, weight int, gone boolean"
        read = lambda k: spark.read.schema(kind).parquet(f"{path}/v={k}/changes").withColumn("v", F.lit(k))
        changes = reduce(DataFrame.unionAll, map(read, later))
        keys = changes.select(*KEY).distinct()
        weight = F.col("weight") if meta["weighted"] else F.lit(None).cast("int").alias("weight")
        touched = edges.join(keys, KEY, "left_semi").select(*KEY, weight, F.lit(False).alias("gone"), F.lit(base).alias("v"))
        story = touched.unionAll(changes).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("v", "gone", "weight"))).alias("story"))
        none = F.lit(None).cast("struct<weight:int>")
        step = lambda now, x: F.when(x["gone"], none).otherwise(F.coalesce(now, F.struct(x["weight"].alias("weight"))))
        ended = story.withColumn("now", F.aggregate("story", none, step)).where("now is not null")
        edges = edges.join(keys, KEY, "left_anti").select(*columns).unionByName(ended.select(*KEY, *(["now.weight"] if meta["weighted"] else [])))
        added = [spark.read.schema(VERTICES).parquet(f"{path}/v={k}/vertices") for k in later if _exists(spark, f"{path}/v={k}/vertices")]
        vertices = reduce(DataFrame.unionAll, [vertices, *added]).distinct()
    return Graph(edges, vertices, meta["capacity"], meta["directed"], meta["weighted"])


def load(spark: SparkSession, path: str, version: int | None = None) -> Graph:
    """The graph of a version, the latest by default."""
    meta = latest(spark, path) if version is None else versions(spark, path).where(F.col("version") == version).first()
    if meta is None:
        raise FileNotFoundError(f"no finished snapshot in {path}")
    return _graph(spark, path, meta["base"], meta["version"], meta)


def create(spark: SparkSession, path: str, capacity: int | None = None, directed: bool = True, weighted: bool = False) -> Graph:
    """An empty store; returns its graph."""
    commit(empty_graph(spark, capacity, directed, weighted), path)
    return load(spark, path)


def usage(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One row: version, n_edges, n_vertices and the bytes on disk of what the version reads."""
    graph = load(spark, path, version)
    meta = latest(spark, path) if version is None else versions(spark, path).where(F.col("version") == version).first()
    size = 0
    for k in range(meta["base"], meta["version"] + 1):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={k}")
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        size += files.getContentSummary(where).getLength() if files.exists(where) else 0
    n = graph.vertices.agg(F.count("*").alias("n_vertices"))
    return graph.edges.agg(F.count("*").alias("n_edges")).join(F.broadcast(n)).select(F.lit(meta["version"]).alias("version"), "n_edges", "n_vertices", F.lit(size).alias("bytes"))
