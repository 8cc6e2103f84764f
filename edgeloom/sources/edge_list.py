"""Edge-list and vertex-list text files: reading, writing, profiling, shuffling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.model import Graph, GraphSpec, from_edges

#: Fixed value: the ending of a day's log name.
LOG_ENDING = "_insert_test.log"


def numbered(lines: DataFrame) -> DataFrame:
    """Adds ``pos``, 0, 1, 2 ... over the rows of a file scan, file by file (by path) and in each from start to end.

    A task reads a split from start to end, so a row's place in its split is its
    distance from the split's first row; only the splits' sizes (one row each) are
    sorted and summed.  Rows don't move.
    """
    rows = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_at", F.monotonically_increasing_id())
    splits = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ahead = splits.select("_file", "_block", (F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n") - F.col("_first")).alias("_shift"))
    return rows.join(ahead, ["_file", "_block"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_file", "_block", "_at", "_shift")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of text files, pos gapless from 0."""
    return numbered(spark.read.text(path)).select("pos", "value")


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, id_base: int = 0, sep: str = r"\s+", strict: bool = False) -> DataFrame:
    """(pos, src, dst[, weight]) of a text file of ``src dst [weight]`` lines.

    Any white space separates, comment and header lines and lines without two
    numbers are skipped, and an unterminated last line counts.  With ``strict`` a
    line that is neither blank nor made of numbers raises.  id_base is subtracted
    from both ids.  pos numbers the edges from 0 without gaps.
    """
    parts = F.split(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")), sep)
    item = lambda k, kind: F.try_element_at(parts, F.lit(k)).try_cast(kind)
    src, dst = item(1, "bigint") - F.lit(id_base), item(2, "bigint") - F.lit(id_base)
    weight = item(3, "int")
    good = src.isNotNull() & dst.isNotNull() & (weight.isNotNull() if weighted else F.lit(True))
    if strict:
        fault = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("boolean")
        good = F.when(F.trim("value") == "", False).when(good, True).otherwise(fault)
    return numbered(spark.read.text(path).where(good)).select("pos", src.alias("src"), dst.alias("dst"), *([weight.alias("weight")] if weighted else []))


def read_graph(spark: SparkSession, path: str, spec: GraphSpec) -> Graph:
    """The graph of an edge-list file, read as the spec says."""
    raw = read_edge_list(spark, path, spec.weighted, spec.id_base)
    return from_edges(raw, spec.directed, spec.weighted, spec.capacity)


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def read_vertex_list(spark: SparkSession, path: str, vertices: DataFrame | None = None) -> DataFrame:
    """Distinct ids, one per line, blanks skipped; with ``vertices`` only those registered."""
    ids = spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("id")).where("id is not null").distinct()
    return ids if vertices is None else ids.join(vertices, "id", "left_semi")


def write_lines(df: DataFrame, path: str, columns: list[str] | None = None, append: bool = False) -> None:
    """Rows as space-separated text lines."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns or df.columns])
    df.select(line.alias("value")).write.mode("append" if append else "overwrite").text(path)


def dump_vertices(ids: DataFrame, path: str) -> None:
    """Distinct ids, ascending, one to a line."""
    ids.select("id").distinct().orderBy("id").select(F.col("id").cast("string").alias("value")).write.mode("overwrite").text(path)


def write_log(spark: SparkSession, folder: str, content: str) -> str:
    """Appends a line to today's log and returns its path, ``<folder>/<yyyyMMdd>`` with LOG_ENDING."""
    day = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd")).first()[0]
    path = f"{folder.rstrip('/')}/{day}{LOG_ENDING}"
    spark.createDataFrame([(content,)], "value string").write.mode("append").text(path)
    return path


def profile(edges: DataFrame) -> DataFrame:
    """One row: n_vertices, min_id, max_id, n_lines, n_unique_edges, n_self_loops of raw (src, dst) rows."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    loops = F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0))
    per = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), F.count("*").alias("n_unique_edges"), loops.alias("n_self_loops"), F.min(F.least("src", "dst")).alias("min_id"), F.max(F.greatest("src", "dst")).alias("max_id"))
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().agg(F.count("*").alias("n_vertices"))
    return ends.join(F.broadcast(per)).select("n_vertices", "min_id", "max_id", "n_lines", "n_unique_edges", "n_self_loops")


def shuffle_lines(lines: DataFrame, seed: int, block: int = 1_000_000, key: Column | None = None) -> DataFrame:
    """Lines in random order within consecutive blocks of ``block``; blank lines go.

    lines: (pos, value) with gapless pos from 0.  Adds block_id and out_pos; the sort is by block, so
    blocks spread over tasks.
    """
    rows = lines.where(F.trim("value") != "").withColumn("block_id", F.floor(F.col("pos") / block))
    draw = key if key is not None else F.xxhash64("pos", F.lit(seed))
    place = F.row_number().over(Window.partitionBy("block_id").orderBy(draw, "pos")) - 1
    return rows.withColumn("out_pos", F.col("block_id") * block + place)
