"""The registered graph queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import bits
from edgeloom.model import Graph, GraphSpec, dense_ids, first_seen, from_edges, mirror
from edgeloom.operators import access, measures, mutate, ranking, traverse
from edgeloom.plans.lineage import cut, new_path
from edgeloom.plans.projections import ctes, graph, raw_p1, raw_p2, raw_p3, raw_p5, read
from edgeloom.plans.superstep import edge_map, frontier_of, union, vertex_map
from edgeloom.sources import store
from edgeloom.sources.edge_list import dump_vertices, profile, read_edge_list, read_graph, read_lines, read_vertex_list, self_loops, shuffle_lines, write_lines, write_log
from edgeloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that gives the same rows."""

    def put(fn: Query) -> Query:
        _queries[fn.__name__] = fn
        if sql is not None:
            _sql[fn.__name__] = sql
        return fn

    return put


def _every(g: Graph) -> DataFrame:
    return g.vertices


def _on_kept(g: Graph, run: Callable[[Graph], DataFrame]) -> DataFrame:
    """``run``'s rows, written down, on edges kept in the meantime."""
    kept = g.persist()
    try:
        return cut(run(kept), "answer")
    finally:
        kept.unpersist()


# Sources and projections


@query(f"WITH {ctes('p3')} SELECT src, dst, weight, pos FROM raw")
def edge_scan(spark, d):
    return raw_p3(spark, d)


@query(f"WITH {ctes('p2')} SELECT src, dst, CAST(side AS INTEGER) AS side FROM both_ways")
def mirror_edges(spark, d):
    return mirror(raw_p2(spark, d).select("src", "dst"))


@query("SELECT l_orderkey - 1 AS src, l_partkey - 1 AS dst FROM lineitem")
def shift_ids(spark, d):
    return raw_p3(spark, d).select((F.col("src") - 1).alias("src"), (F.col("dst") - 1).alias("dst"))


@query(f"""WITH {ctes('p3')} SELECT (SELECT count(*) FROM ids) AS n_vertices, min(least(src, dst)) AS min_id, max(greatest(src, dst)) AS max_id,
  count(*) AS n_lines, (SELECT count(*) FROM e) AS n_unique_edges, CAST(count_if(src = dst) AS BIGINT) AS n_self_loops FROM raw""")
def edge_profile(spark, d):
    return profile(raw_p3(spark, d))


@query("""SELECT o_orderkey AS pos, o_orderkey // 1000 AS block_id,
  (o_orderkey // 1000) * 1000 + row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS out_pos FROM orders""")
def shuffle_blocks(spark, d):
    lines = read(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("value"))
    return shuffle_lines(lines, 0, 1000, F.md5(F.col("pos").cast("string"))).select("pos", "block_id", "out_pos")


_DENSE = "SELECT id, row_number() OVER (ORDER BY p, id) - 1 AS dense FROM (SELECT id, min(p) AS p FROM (SELECT dst AS id, pos * 2 AS p FROM raw UNION ALL SELECT src, pos * 2 + 1 FROM raw) GROUP BY id)"


@query(f"WITH {ctes('p3')} {_DENSE}")
def vertex_ids_dense(spark, d):
    return dense_ids(first_seen(raw_p3(spark, d)))


@query("""SELECT l_orderkey AS id, l_orderkey & 255 AS fingerprint, (l_orderkey >> 4) & 3 AS branch, (l_orderkey >> 2) & 7 AS low_bits,
  ((x >> 8) # x) & 255 AS folded FROM (SELECT DISTINCT l_orderkey, xor(y >> 16, y) AS x FROM (SELECT l_orderkey, xor(l_orderkey >> 32, l_orderkey) AS y FROM lineitem))""".replace("((x >> 8) # x)", "xor(x >> 8, x)"))
def fingerprint_bits(spark, d):
    ids = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return ids.select("id", bits.fingerprint(F.col("id")).alias("fingerprint"), bits.branch(F.col("id"), 2).alias("branch"), bits.get_bits(F.col("id"), 2, 3).alias("low_bits"), bits.xor_fold(F.col("id")).alias("folded"))


# Mutations


@query(f"WITH {ctes('p2')} SELECT src, dst FROM e")
def insert_edges(spark, d):
    raw = raw_p2(spark, d)
    half = from_edges(raw.where("pos % 2 = 0"), directed=False)
    return mutate.insert_edges(half, raw.where("pos % 2 = 1")).edges


@query(f"WITH {ctes('p3')} SELECT src, dst, arg_min(weight, pos) AS weight FROM raw GROUP BY src, dst")
def insert_edges_first_weight(spark, d):
    raw = raw_p3(spark, d)
    middle = raw.agg(F.expr("(min(pos) + max(pos)) div 2").alias("m")).first()["m"] or 0
    half = from_edges(raw.where(F.col("pos") <= middle), weighted=True)
    return mutate.insert_edges(half, raw.where(F.col("pos") > middle)).edges


@query(f"WITH {ctes('p3')} SELECT src, dst, arg_max(weight, pos) AS weight FROM raw GROUP BY src, dst")
def upsert_edges_last_weight(spark, d):
    raw = raw_p3(spark, d)
    return mutate.upsert_edges(from_edges(raw.limit(0), weighted=True), raw).edges


@query(f"WITH {ctes('p3')} SELECT src, dst FROM raw")
def insert_multi_edges(spark, d):
    return from_edges(raw_p3(spark, d), dedup=False).edges


@query(f"WITH {ctes('p2')} SELECT src, dst FROM e WHERE (src + dst) % 5 <> 0")
def delete_edges(spark, d):
    g = graph(spark, d, "p2")
    return mutate.delete_edges(g, raw_p2(spark, d).where("(src + dst) % 5 = 0")).edges


@query(f"WITH {ctes('p3')} SELECT id FROM ids")
def register_vertices(spark, d):
    g = graph(spark, d, "p3")
    return mutate.register(g.edges.select(F.col("src").alias("id")), g.edges.select(F.col("dst").alias("id")))


@query("""WITH b AS (SELECT l_partkey * 2 AS s, l_suppkey * 2 + 1 AS t, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) AS n FROM lineitem),
r AS (SELECT s, t, n // 5000 AS batch_id FROM b), m AS (SELECT s, t, batch_id FROM r UNION ALL SELECT t, s, batch_id FROM r),
f AS (SELECT min(batch_id) AS batch_id FROM m GROUP BY s, t)
SELECT batch_id, count(*) AS attempted, (SELECT count(*) FROM f WHERE f.batch_id = m.batch_id) AS inserted FROM m GROUP BY batch_id""")
def batch_ingest_stats(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("id"))
    first = rows.select("id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "id").alias("first_pos"))
    numbered = rows.join(dense_ids(first), "id")
    raw = numbered.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"), F.col("dense").alias("pos"))
    return mutate.batch_stats(raw, 10_000, directed=False)


@query(f"""WITH {ctes('p2')} SELECT count(*) FILTER (src % 3 = 0 OR dst % 3 = 0) AS missing, count(*) FILTER ((src + dst) % 5 <> 0) AS left_over FROM e""")
def verify_batches(spark, d):
    """An ingest that lost the edges of every third id, and a deletion that only removed a fifth, as verification counts them."""
    g, raw = graph(spark, d, "p2"), raw_p2(spark, d)
    lossy = g.with_edges(g.edges.where("src % 3 <> 0 and dst % 3 <> 0"))
    missing = mutate.missing_after_ingest(lossy, raw).agg(F.count("*").alias("missing"))
    partly = mutate.delete_edges(g, raw.where("(src + dst) % 5 = 0"))
    left = mutate.present_after_delete(partly, raw).agg(F.count("*").alias("left_over"))
    return missing.join(F.broadcast(left))


# Lookups


@query(f"""WITH {ctes('p3')}, asked AS (SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders)
SELECT asked.src, asked.dst, e.src IS NOT NULL AS found FROM asked LEFT JOIN e ON e.src = asked.src AND e.dst = asked.dst""")
def has_edges(spark, d):
    asked = read(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).distinct()
    return access.has_edges(graph(spark, d, "p3"), asked)


@query(f"WITH {ctes('p2')} SELECT dst FROM e WHERE src = 2")
def neighbors(spark, d):
    return access.neighbors(graph(spark, d, "p2"), 2)


@query(f"WITH {ctes('p2')} SELECT src, dst FROM e WHERE src IN (SELECT c_custkey * 2 FROM customer WHERE c_nationkey = 3)")
def neighbors_of_set(spark, d):
    ids = read(spark, d, "customer").where("c_nationkey = 3").select((F.col("c_custkey") * 2).alias("id"))
    return access.neighbors_of(graph(spark, d, "p2"), ids)


@query(f"WITH {ctes('p2')} SELECT src, array_to_string(list(dst ORDER BY dst), ' ') AS neighbors FROM e GROUP BY src")
def adjacency_sorted(spark, d):
    return access.adjacency_sorted(graph(spark, d, "p2")).select("src", F.concat_ws(" ", F.col("neighbors").cast("array<string>")).alias("neighbors"))


@query(f"WITH {ctes('p2')} SELECT src, CAST(sum(dst) AS BIGINT) AS total FROM e GROUP BY src")
def neighbor_id_sum(spark, d):
    return measures.neighbor_id_sum(graph(spark, d, "p2"))


# Degrees and hops


@query(f"WITH {ctes('p3')} SELECT id, deg AS degree FROM v")
def degree(spark, d):
    return access.degrees(graph(spark, d, "p3"))


@query(f"""WITH {ctes('p2')} SELECT max(deg) AS max_degree, CAST(sum(deg) AS BIGINT) // CAST(count_if(deg > 0) AS BIGINT) AS avg_nonempty, CAST(sum(deg) AS BIGINT) // any_value(capacity) AS avg_all,
  any_value(capacity) - CAST(count_if(deg > 0) AS BIGINT) AS num_empty, CAST(count_if(deg > 0) AS BIGINT) AS num_nonempty FROM v, cap""")
def degree_stats(spark, d):
    return measures.degree_stats(graph(spark, d, "p2"))


@query(f"""WITH {ctes('p2')}, h AS (SELECT (deg - 1) // 16 AS bucket, count(*) AS n FROM v WHERE deg > 0 GROUP BY 1),
filled AS (SELECT count(*) AS s FROM v WHERE deg > 0)
SELECT bucket, bucket * 16 + 1 AS low, (bucket + 1) * 16 AS high, n,
  round((capacity - s + sum(n) OVER (ORDER BY bucket)) * 100.0 / capacity, 4) AS cumulative_pct FROM h, filled, cap ORDER BY bucket LIMIT 100""")
def degree_histogram(spark, d):
    return measures.degree_histogram(graph(spark, d, "p2"))


@query(f"WITH {ctes('p3')} SELECT CAST(sum(deg) AS BIGINT) AS n FROM v")
def one_hop(spark, d):
    g = graph(spark, d, "p3")
    return measures.one_hop(g, _every(g))


@query(f"WITH {ctes('p2')} SELECT CAST(sum(deg) AS BIGINT) AS n FROM e JOIN v ON id = dst")
def two_hop(spark, d):
    g = graph(spark, d, "p2")
    return measures.two_hop(g, _every(g))


@query(f"WITH {ctes('p3')} SELECT w.id, CAST(coalesce(sum(u.deg), 0) AS BIGINT) AS n FROM v w LEFT JOIN e ON e.src = w.id LEFT JOIN v u ON u.id = e.dst GROUP BY w.id")
def two_hop_by_vertex(spark, d):
    g = graph(spark, d, "p3")
    return measures.two_hop_by_vertex(g, _every(g))


@query(f"WITH {ctes('p3')} SELECT id FROM v WHERE deg > 0 ORDER BY md5(id || ':11'), id LIMIT 64")
def sample_vertices(spark, d):
    return measures.sample_vertices(graph(spark, d, "p3"), 64, 11)


# Iterative algorithms


def _levels(name: str, source: int) -> str:
    return f"""WITH RECURSIVE {ctes(name)},
b(v, d) USING KEY (v) AS (
  SELECT CAST({source} AS BIGINT), CAST(0 AS BIGINT)
  UNION SELECT e.dst, min(b.d) + 1 FROM b JOIN e ON e.src = b.v LEFT JOIN recurring.b r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst)"""


@query(_levels("p3", 0) + " SELECT v AS id, CAST(d AS INTEGER) AS depth FROM b")
def bfs_levels(spark, d):
    return _on_kept(graph(spark, d, "p3"), lambda g: traverse.bfs(g, 0).select("id", "depth"))


@query(_levels("p3", 0) + """ SELECT b.v AS id, CASE WHEN b.d = 0 THEN b.v ELSE min(p.v) END AS parent
FROM b LEFT JOIN e ON e.dst = b.v LEFT JOIN b p ON p.v = e.src AND p.d = b.d - 1 GROUP BY b.v, b.d""")
def bfs_parents(spark, d):
    return _on_kept(graph(spark, d, "p3"), lambda g: traverse.bfs(g, 0).select("id", "parent"))


@query(_levels("p1", 1) + " SELECT CAST(1 AS BIGINT) AS source, CAST(sum(d) AS BIGINT) AS depth_sum, count(*) AS reached FROM b")
def bfs_depth_sum(spark, d):
    return _on_kept(graph(spark, d, "p1"), lambda g: traverse.bfs_depth_sum(g, [1]))


_SHORTEST = f"""WITH RECURSIVE {ctes('p3')},
w AS (SELECT src, dst, arg_min(weight, pos) AS weight FROM raw GROUP BY src, dst),
b(v, d) USING KEY (v) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION SELECT w.dst, min(b.d + w.weight) FROM b JOIN w ON w.src = b.v LEFT JOIN recurring.b r ON r.v = w.dst
  WHERE r.v IS NULL OR b.d + w.weight < r.d GROUP BY w.dst)"""


@query(_SHORTEST + " SELECT v AS id, d AS dist FROM b")
def sssp_dist(spark, d):
    return _on_kept(graph(spark, d, "p3", weighted=True), lambda g: traverse.sssp(g, 0)[0])


@query(_SHORTEST + " SELECT CAST(sum(d) AS BIGINT) AS dist_sum, false AS negative_cycle FROM b")
def sssp_dist_sum(spark, d):
    return _on_kept(graph(spark, d, "p3", weighted=True), lambda g: traverse.sssp_dist_sum(g, 0))


@query(_levels("p2", 0) + " SELECT v AS id, d AS dist FROM b")
def sssp_unit(spark, d):
    return _on_kept(graph(spark, d, "p2"), lambda g: traverse.sssp(g, 0, unit=True)[0])


_COMPONENTS = f"""WITH RECURSIVE {ctes('p1')},
b(v, c) USING KEY (v) AS (
  SELECT id, id FROM ids
  UNION SELECT e.dst, min(b.c) FROM b JOIN e ON e.src = b.v JOIN recurring.b r ON r.v = e.dst WHERE b.c < r.c GROUP BY e.dst)"""


@query(_COMPONENTS + " SELECT v AS id, c AS component FROM b")
def cc_labels(spark, d):
    return ranking.cc_labels(graph(spark, d, "p1"))


@query(_COMPONENTS + " SELECT count(DISTINCT c) AS components, count(DISTINCT c) + any_value(capacity) - count(*) AS components_with_empty FROM b, cap")
def cc_count(spark, d):
    return ranking.cc_count(graph(spark, d, "p1"))


def _ranks(name: str, iterations: int = 10) -> str:
    out = f"WITH {ctes(name)}, r0 AS (SELECT id, deg, CASE WHEN deg > 0 THEN 0.15::DOUBLE ELSE 0 END AS p FROM v)"
    for i in range(1, iterations + 1):
        x = "0.15::DOUBLE + 0.85::DOUBLE * coalesce(x, 0)"
        p = x if i == iterations else f"CASE WHEN deg > 0 THEN ({x}) / deg ELSE 0 END"
        out += f",\na{i} AS (SELECT e.dst AS id, sum(p) AS x FROM r{i - 1} r JOIN e ON e.src = r.id GROUP BY e.dst),\nr{i} AS (SELECT v.id, v.deg, {p} AS p FROM v LEFT JOIN a{i} USING (id))"
    return out


@query(_ranks("p3") + " SELECT id, round(p, 6) AS rank FROM r10")
def pagerank_ranks(spark, d):
    return _on_kept(graph(spark, d, "p3"), lambda g: ranking.pagerank(g).select("id", F.round("rank", 6).alias("rank")))


@query(_ranks("p2") + " SELECT round(sum(p) + 0.15 * (count_if(deg = 0) + any_value(capacity) - count(*)), 4)::DOUBLE AS checksum FROM r10, cap")
def pagerank_checksum(spark, d):
    return _on_kept(graph(spark, d, "p2"), lambda g: ranking.pagerank_checksum(g).select(F.round("checksum", 4).alias("checksum")))


# The frontier API


@query(f"WITH {ctes('p3')} SELECT dst AS id, count(*) AS n, min(src) AS least FROM e WHERE src IN (0, 1, 2) AND dst NOT IN (0, 1, 2) GROUP BY dst")
def edge_map_step(spark, d):
    start = frontier_of(spark, [0, 1, 2])
    return edge_map(graph(spark, d, "p3"), start, {"n": F.count("*"), "least": F.min("src")}, settled=start)


@query(f"WITH {ctes('p3')} SELECT src AS id, count(*) AS n FROM e WHERE dst IN (SELECT id FROM v WHERE id % 7 = 0) GROUP BY src")
def edge_map_pull(spark, d):
    g = graph(spark, d, "p3")
    return edge_map(g, vertex_map(g.vertices, keep=F.col("id") % 7 == 0), {"n": F.count("*")}, reverse=True)


@query(f"WITH {ctes('p3')} SELECT id, deg * 2 AS twice FROM v WHERE deg > 4")
def vertex_map_filter(spark, d):
    return vertex_map(access.degrees(graph(spark, d, "p3")), {"twice": F.col("degree") * 2}, F.col("degree") > 4).select("id", "twice")


@query(f"WITH {ctes('p3')} SELECT id FROM v WHERE deg > 6 OR id % 10 = 0")
def frontier_union(spark, d):
    degrees = access.degrees(graph(spark, d, "p3"))
    return union(degrees.where("degree > 6"), degrees.where("id % 10 = 0"))


# Text files


def _text(spark: SparkSession, rows: DataFrame, columns: list[str], sep: str = " ", times: int = 1) -> str:
    path = new_path(spark, "text")
    line = F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])
    for k in range(times):
        write_lines(rows.select(line.alias("line")), path, append=k > 0)
    return path


@query(f"WITH {ctes('p3')} SELECT src, dst FROM raw")
def text_scan(spark, d):
    return read_edge_list(spark, _text(spark, raw_p3(spark, d), ["src", "dst"])).select("src", "dst")


@query(f"WITH {ctes('p3')} SELECT src - 1 AS src, dst - 1 AS dst, weight FROM raw")
def weighted_text_scan(spark, d):
    return read_edge_list(spark, _text(spark, raw_p3(spark, d), ["src", "dst", "weight"]), weighted=True, id_base=1).drop("pos")


@query(f"WITH {ctes('p3')} SELECT count(*) AS n, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high, count(*) AS n_distinct FROM raw")
def text_positions(spark, d):
    rows = read_edge_list(spark, _text(spark, raw_p3(spark, d).repartition(7), ["src", "dst"]))
    return rows.agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count_distinct("pos").alias("n_distinct"))


@query(f"WITH {ctes('p3')} SELECT src, dst, count(*) * 2 AS n FROM raw GROUP BY src, dst")
def text_append(spark, d):
    return read_edge_list(spark, _text(spark, raw_p3(spark, d), ["src", "dst"], times=2)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(_sql["edge_profile"])
def delimited_profile(spark, d):
    return profile(read_edge_list(spark, _text(spark, raw_p3(spark, d), ["src", "dst"], sep=","), sep=","))


@query(f"WITH {ctes('p2')} SELECT src, dst, arg_min(weight, (pos, side)) AS weight FROM both_ways GROUP BY src, dst")
def text_graph(spark, d):
    path = _text(spark, raw_p2(spark, d).orderBy("pos"), ["src", "dst", "weight"])
    return read_graph(spark, path, GraphSpec("parts", directed=False, weighted=True)).edges


@query(f"WITH {ctes('p3')} SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM ids)")
def query_vertex_file(spark, d):
    path = _text(spark, read(spark, d, "orders"), ["o_custkey"])
    return read_vertex_list(spark, path, graph(spark, d, "p3").vertices)


@query(f"WITH {ctes('p3')} SELECT row_number() OVER (ORDER BY id) - 1 AS pos, CAST(id AS VARCHAR) AS value FROM ids")
def dump_vertex_set(spark, d):
    path = new_path(spark, "dump")
    dump_vertices(graph(spark, d, "p3").vertices, path)
    return read_lines(spark, path)


@query("SELECT DISTINCT 'nation ' || n_nationkey AS line FROM nation")
def dated_log(spark, d):
    folder = new_path(spark, "log")
    for k in sorted(r[0] for r in read(spark, d, "nation").select("n_nationkey").collect()):
        path = write_log(spark, folder, f"nation {k}")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT o_orderkey AS id, CAST(strftime(o_orderdate, '%Y%m%d') || '000000' AS BIGINT) AS number, strftime(o_orderdate, '%Y%m%d') AS day, '00:00:00' AS clock FROM orders")
def time_numbers(spark, d):
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), bits.timestamp_number(at).alias("number"), bits.date_text(at).alias("day"), bits.time_text(at).alias("clock"))


@query("""SELECT DISTINCT l_orderkey AS id, l_orderkey | 4 AS set_2, l_orderkey & ~1 AS clear_0, xor(l_orderkey, 8) AS flip_3,
  (l_orderkey >> 2) & 1 = 1 AS test_2, CAST(bit_count(l_orderkey) AS INTEGER) AS ones, CAST(instr(reverse(lpad(bin(l_orderkey), 64, '0')), '0') - 1 AS INTEGER) AS first_zero FROM lineitem""")
def bit_array(spark, d):
    x = F.col("id")
    ids = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return ids.select("id", bits.bit_set(x, 2).alias("set_2"), bits.bit_clear(x, 0).alias("clear_0"), bits.bit_flip(x, 3).alias("flip_3"), bits.bit_test(x, 2).alias("test_2"), bits.popcount(x).cast("int").alias("ones"), bits.first_zero(x, 62).cast("int").alias("first_zero"))


# The store and its ingest drivers


def _store(spark: SparkSession, **kind) -> str:
    path = new_path(spark, "store")
    store.create(spark, path, **kind)
    return path


@query(f"WITH {ctes('p2')} SELECT src, dst FROM e")
def store_reopen(spark, d):
    path = _store(spark, directed=False)
    store.commit(graph(spark, d, "p2"), path)
    return store.load(spark, path).edges


@query(f"WITH {ctes('p2')} SELECT CAST(1 AS INTEGER) AS version, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM ids) AS n_vertices, true AS has_bytes")
def store_usage(spark, d):
    path = _store(spark, directed=False)
    store.commit(graph(spark, d, "p2"), path)
    return store.usage(spark, path).select("version", "n_edges", "n_vertices", (F.col("bytes") > 0).alias("has_bytes"))


@query(f"WITH {ctes('p5')} SELECT (SELECT count(*) FROM ids) AS n_vertices, capacity, false AS directed, true AS weighted FROM cap")
def graph_accessors(spark, d):
    path = _store(spark, directed=False, weighted=True)
    store.change(path, raw_p5(spark, d).withColumn("weight", F.lit(1)))
    g = store.load(spark, path)
    return spark.createDataFrame([(g.count_vertices(), g.capacity, g.directed, g.weighted)], "n_vertices bigint, capacity bigint, directed boolean, weighted boolean")


_BATCHED = """WITH n AS (SELECT src, dst, row_number() OVER (ORDER BY pos, src, dst) - 1 AS k FROM (SELECT o_custkey * 2 AS src, o_orderkey * 2 + 1 AS dst, o_orderkey AS pos FROM orders)),
r AS (SELECT src, dst, least(k // 200, 4) AS batch FROM n), m AS (SELECT src, dst, batch FROM r UNION ALL SELECT dst, src, batch FROM r),
f AS (SELECT src, dst, min(batch) AS batch FROM m GROUP BY src, dst)"""


def _ingested(spark: SparkSession, d: str) -> tuple[str, str, list]:
    """The orders, as a text file, ingested batch by batch: file, store, figures."""
    rows = raw_p5(spark, d).orderBy("pos", "src", "dst")
    file, path = _text(spark, rows, ["src", "dst"]), _store(spark, directed=False)
    return file, path, ingest.ingest_file(spark, file, path, batch_size=400, num_batches=5, verify=True)


def _figures(spark: SparkSession, stats: list) -> DataFrame:
    return spark.createDataFrame([(x.batch, x.attempted, x.changed) for x in stats], "batch bigint, attempted bigint, changed bigint")


@query(_BATCHED + " SELECT batch, count(*) AS attempted, (SELECT count(*) FROM f WHERE f.batch = m.batch) AS changed FROM m GROUP BY batch")
def ingest_driver(spark, d):
    return _figures(spark, _ingested(spark, d)[2])


@query(_BATCHED + " SELECT src, dst FROM f")
def ingest_driver_edges(spark, d):
    return store.load(spark, _ingested(spark, d)[1]).edges


@query(_BATCHED + " SELECT CAST(5 AS BIGINT) AS batches, (SELECT count(*) FROM m) AS attempted, (SELECT count(*) FROM f) AS changed, true AS timed")
def ingest_throughput(spark, d):
    t = mutate.throughput(_ingested(spark, d)[2])
    return spark.createDataFrame([(t.batches, t.attempted, t.changed, t.seconds > 0 and t.edges_per_second > 0)], "batches bigint, attempted bigint, changed bigint, timed boolean")


@query(_BATCHED + " SELECT src, dst FROM f WHERE batch > 1")
def delete_driver(spark, d):
    file, path, _ = _ingested(spark, d)
    ingest.ingest_in_batches(read_edge_list(spark, file).where("pos < 400"), path, 400, delete=True, verify=True)
    return store.load(spark, path).edges


@query(_BATCHED + " SELECT CAST(0 AS BIGINT) AS batch, count(*) AS attempted, (SELECT count(*) FROM f WHERE batch <= 1) AS changed FROM m WHERE batch <= 1")
def delete_driver_stats(spark, d):
    file, path, _ = _ingested(spark, d)
    return _figures(spark, ingest.ingest_in_batches(read_edge_list(spark, file).where("pos < 400"), path, 10**9, delete=True))


def _streamed(spark: SparkSession, d: str, delete_odd: bool = False) -> tuple[str, list]:
    """Orders as three text files, streamed into a store; with ``delete_odd`` the odd orders are streamed out again."""
    files, path = new_path(spark, "stream"), _store(spark)
    raw_p5(spark, d).select(F.concat_ws(" ", "src", "dst").alias("value")).repartition(3).write.text(files)
    done = ingest.ingest(ingest.edge_stream(spark, files), path, new_path(spark, "checkpoint"))
    done.awaitTermination()
    seen = ingest.progress(done)
    if delete_odd:
        gone = new_path(spark, "stream")
        raw_p5(spark, d).where("pos % 2 = 1").select(F.concat_ws(" ", "src", "dst").alias("value")).repartition(2).write.text(gone)
        checkpoint = new_path(spark, "checkpoint")
        for _ in range(2):  # started again, it finds nothing new
            ingest.ingest(ingest.edge_stream(spark, gone), path, checkpoint, delete=True).awaitTermination()
    return path, seen


@query(f"WITH {ctes('p5')} SELECT DISTINCT src, dst FROM raw")
def stream_ingest(spark, d):
    return store.load(spark, _streamed(spark, d)[0]).edges


@query(f"WITH {ctes('p5')} SELECT DISTINCT src, dst FROM raw WHERE pos % 2 = 0")
def stream_delete(spark, d):
    return store.load(spark, _streamed(spark, d, delete_odd=True)[0]).edges


@query(f"WITH {ctes('p5')} SELECT count(*) AS n_rows, true AS timed FROM raw")
def stream_progress(spark, d):
    seen = _streamed(spark, d)[1]
    return spark.createDataFrame([(sum(x["rows"] for x in seen), all(x["ms"] is not None for x in seen))], "n_rows bigint, timed boolean")


@query(f"WITH {ctes('p5')} SELECT src AS id, count(DISTINCT dst) AS degree FROM raw WHERE pos % 2 = 0 GROUP BY src")
def query_latest(spark, d):
    path, _ = _streamed(spark, d, delete_odd=True)
    return access.degrees(store.load(spark, path)).where("degree > 0")


@query(f"WITH {ctes('p5')} SELECT DISTINCT src, dst FROM raw")
def replayed_batch(spark, d):
    path, raw = _store(spark), raw_p5(spark, d).select("src", "dst")
    once = ingest.apply_once(path, "orders")
    once(raw, 0)
    ingest.apply_once(path, "orders", delete=True)(raw, 0)  # the same batch again, whatever it would do
    ingest.apply_once(path, "others", delete=True)(raw.limit(0), 0)  # another stream's first batch counts
    return store.load(spark, path).edges


# Further lookups and algorithms


@query(f"WITH {ctes('p3')} SELECT DISTINCT c_custkey AS id, c_custkey IN (SELECT id FROM ids) AS found FROM customer")
def vertex_exists(spark, d):
    return access.has_vertices(graph(spark, d, "p3"), read(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query(f"""WITH {ctes('p3')}, w AS (SELECT src, dst, arg_min(weight, pos) AS weight FROM raw GROUP BY src, dst),
asked AS (SELECT DISTINCT l_orderkey AS src, CASE WHEN l_linenumber = 1 THEN l_suppkey ELSE l_partkey END AS dst FROM lineitem)
SELECT asked.src, asked.dst, coalesce(weight, 0) AS weight FROM asked LEFT JOIN w USING (src, dst)""")
def edge_weights(spark, d):
    lines = read(spark, d, "lineitem")
    asked = lines.select(F.col("l_orderkey").alias("src"), F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("dst")).distinct()
    return access.edge_weights(graph(spark, d, "p3", weighted=True), asked)


@query(f"WITH {ctes('p2')} SELECT src, dst, arg_min(weight, (pos, side)) AS weight FROM both_ways WHERE src IN (SELECT c_custkey * 2 FROM customer WHERE c_nationkey = 3) GROUP BY src, dst")
def neighbors_weighted(spark, d):
    ids = read(spark, d, "customer").where("c_nationkey = 3").select((F.col("c_custkey") * 2).alias("id"))
    return access.neighbors_of(graph(spark, d, "p2", weighted=True), ids)


@query(f"WITH {ctes('p3')} SELECT src FROM e WHERE src = dst")
def self_loop_edges(spark, d):
    return self_loops(graph(spark, d, "p3").edges).select("src")


@query(f"WITH {ctes('p3')}, m AS ({_DENSE}) SELECT a.dense AS src, b.dense AS dst FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst")
def edges_dense(spark, d):
    raw = raw_p3(spark, d)
    ids = dense_ids(first_seen(raw))
    named = lambda end: ids.select(F.col("id").alias(end), F.col("dense").alias(f"{end}_dense"))
    return from_edges(raw).edges.join(named("src"), "src").join(named("dst"), "dst").select(F.col("src_dense").alias("src"), F.col("dst_dense").alias("dst"))


@query(_levels("p3", 0) + " SELECT CAST(d AS INTEGER) AS depth, count(*) AS n FROM b GROUP BY d")
def frontier_sizes(spark, d):
    return _on_kept(graph(spark, d, "p3"), lambda g: traverse.frontier_sizes(g, 0))


@query(_SHORTEST + " SELECT v AS id, d AS dist FROM b")
def dijkstra_dist(spark, d):
    return _on_kept(graph(spark, d, "p3", weighted=True), lambda g: traverse.dijkstra(g, 0))


@query(f"""WITH {ctes('p1')}, u AS (SELECT id FROM ids UNION SELECT x FROM (VALUES (900000000001), (900000000002)) AS t(x))
SELECT CAST(0 AS BIGINT) + count(*) AS n_vertices, max(id) + 1 AS capacity, max(id) + 1 - CAST((SELECT count(DISTINCT src) FROM e) + 2 AS BIGINT) AS num_empty FROM u""")
def capacity_grows(spark, d):
    g = graph(spark, d, "p1")
    more = mutate.insert_edges(g, spark.createDataFrame([(900000000001, 900000000002)], "src bigint, dst bigint"))
    return measures.degree_stats(more).select(F.lit(more.count_vertices()).alias("n_vertices"), F.lit(more.capacity).alias("capacity"), "num_empty")


#: The rows of the survey's operator inventory that each query covers.
COVERS = {
    "edge_scan": "SRC-2", "text_scan": "SRC-1 SRC-13 SNK-1 SCA-9", "weighted_text_scan": "SRC-2 SRC-3", "text_positions": "SRC-1 SRC-15", "text_append": "SNK-2",
    "delimited_profile": "SRC-13 AGG-12", "text_graph": "SRC-2 SET-3 MUT-7", "query_vertex_file": "SRC-5 SRC-6 SRT-1", "dump_vertex_set": "SNK-3 SRT-1", "dated_log": "SNK-4",
    "mirror_edges": "SRC-4 SET-3 PRJ-2", "shift_ids": "SRC-3", "edge_profile": "SRC-14 AGG-12 FIL-12 SCA-10", "shuffle_blocks": "SRC-15 SRT-5", "vertex_ids_dense": "SRC-11 FIL-6 WIN-2", "edges_dense": "JOI-4",
    "fingerprint_bits": "SCA-1 SCA-2 SCA-3 SCA-4", "bit_array": "SCA-5 UDF-8 AGG-15", "time_numbers": "SCA-7 SCA-8",
    "store_reopen": "SRC-7 SRC-8 SRC-10 SNK-5 SNK-6", "store_usage": "SNK-8", "graph_accessors": "ADJ-14 SRC-8", "capacity_grows": "MUT-1 MUT-2 MUT-11 AGG-5",
    "insert_edges": "MUT-1 MUT-2 MUT-11 JOI-5 SET-1", "insert_edges_first_weight": "MUT-1", "upsert_edges_last_weight": "MUT-13", "insert_multi_edges": "MUT-3", "delete_edges": "MUT-4 MUT-5 MUT-14 SET-2",
    "register_vertices": "MUT-6 MUT-12 SET-4", "batch_ingest_stats": "MUT-7", "ingest_driver": "MUT-7 MUT-8 JOI-6 STR-1", "ingest_driver_edges": "MUT-8 STR-3", "ingest_throughput": "AGG-14 MUT-8",
    "delete_driver": "MUT-9 MUT-10 JOI-7", "delete_driver_stats": "MUT-10", "verify_batches": "JOI-6 JOI-7", "stream_ingest": "STR-1 STR-3", "stream_delete": "STR-3 STR-5", "stream_progress": "STR-4", "query_latest": "STR-2", "replayed_batch": "STR-5",
    "has_edges": "FIL-1 FIL-2 FIL-3 FIL-4", "vertex_exists": "FIL-5", "edge_weights": "ADJ-11", "neighbors": "PRJ-1 ADJ-1 ADJ-2", "neighbors_of_set": "ADJ-3 ADJ-4 ADJ-5 ADJ-6 ADJ-7 ADJ-8", "neighbors_weighted": "PRJ-1 SRC-4",
    "adjacency_sorted": "ADJ-9 ADJ-10 ADJ-13 SRT-3", "neighbor_id_sum": "AGG-11", "self_loop_edges": "FIL-12", "degree": "AGG-1 AGG-2 MUT-18 FIL-9", "degree_stats": "AGG-5 ALG-9", "degree_histogram": "AGG-6 WIN-1 SRT-2 SCA-11",
    "one_hop": "AGG-3 SNK-9", "two_hop": "AGG-4 JOI-2", "two_hop_by_vertex": "AGG-4 JOI-2", "sample_vertices": "ALG-10",
    "bfs_levels": "ALG-1 FIL-7 FIL-8 FIL-13 UDF-9", "bfs_parents": "ALG-2 AGG-7 SCA-6", "bfs_depth_sum": "ALG-1 AGG-10 SNK-9", "frontier_sizes": "AGG-13 UDF-9", "sssp_dist": "ALG-3 FIL-11", "sssp_dist_sum": "ALG-3 FIL-10 AGG-10",
    "sssp_unit": "ALG-4 PRJ-3", "dijkstra_dist": "ALG-5", "cc_labels": "ALG-6 ALG-7", "cc_count": "AGG-9", "pagerank_ranks": "ALG-8 AGG-8 JOI-3", "pagerank_checksum": "ALG-8 AGG-10",
    "edge_map_step": "UDF-1 UDF-2 UDF-10 JOI-1", "edge_map_pull": "UDF-3 JOI-8", "vertex_map_filter": "UDF-4", "frontier_union": "UDF-5 UDF-6 SET-5",
}
for _name, _ids in COVERS.items():
    _queries[_name].__doc__ = f"Covers {_ids}.  {_queries[_name].__doc__ or ''}".strip()


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
