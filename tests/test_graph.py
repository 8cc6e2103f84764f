"""The hand-made graphs and invariants of the survey's test plan."""

import pytest
from pyspark.sql import functions as F

from edgeloom.model import check_capacity, empty_graph, from_edges
from edgeloom.operators import access, measures, mutate, ranking, stars, traverse
from edgeloom.plans import lineage
from edgeloom.plans.superstep import Steps, edge_map, frontier_of, supersteps, union, vertex_map


def graph(spark, edges, directed=True, weighted=False, capacity=None):
    schema = "src bigint, dst bigint, weight int, pos bigint" if weighted else "src bigint, dst bigint, pos bigint"
    data = [(*e, k) for k, e in enumerate(edges)]
    return from_edges(spark.createDataFrame(data, schema), directed, weighted, capacity)


def one(df):
    return tuple(df.first())


def test_empty(spark):
    g = empty_graph(spark, 5)
    assert one(ranking.cc_count(g)) == (0, 5)
    assert one(ranking.pagerank_checksum(g))[0] == pytest.approx(0.75)
    assert measures.degree_histogram(g).count() == 0
    assert one(measures.degree_stats(g)) == (0, 0, 0, 5, 0)
    assert one(measures.one_hop(g, g.vertices)) == (0,) and one(measures.two_hop(g, g.vertices)) == (0,)


def test_duplicates_keep_first_weight(spark, rows):
    g = graph(spark, [(0, 1, 5), (0, 1, 9)], weighted=True)
    assert rows(g.edges) == [(0, 1, 5)]
    assert access.edge_weight(g, 0, 1) == 5 and access.edge_weight(g, 1, 0) == 0
    later = mutate.insert_edges(g, spark.createDataFrame([(0, 1, 7)], "src bigint, dst bigint, weight int"))
    assert rows(later.edges) == [(0, 1, 5)]
    last = mutate.upsert_edges(g, spark.createDataFrame([(0, 1, 7)], "src bigint, dst bigint, weight int"))
    assert rows(last.edges) == [(0, 1, 7)]


def test_undirected_self_loop(spark, rows):
    g = graph(spark, [(2, 2)], directed=False)
    assert rows(g.edges) == [(2, 2)]
    assert rows(access.degrees(g)) == [(2, 1)] and rows(ranking.cc_labels(g)) == [(2, 2)]


def test_undirected_path(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)], directed=False, capacity=6)
    assert one(traverse.bfs_depth_sum(g, [0])) == (0, 6, 4)
    assert one(ranking.cc_count(g)) == (1, 3)
    assert one(measures.two_hop(g, g.vertices)) == (10,)
    assert one(traverse.sssp_dist_sum(g, 0)) == (6, False)


def test_directed_sink_counts_twice(spark, rows):
    g = graph(spark, [(0, 1)], capacity=2)
    assert one(traverse.bfs_depth_sum(g, [0]))[1] == 1 and one(traverse.bfs_depth_sum(g, [1]))[1] == 0
    assert one(ranking.cc_count(g)) == (1, 1)
    assert [round(r[1], 4) for r in rows(ranking.pagerank(g))] == [0.15, 0.2775]
    assert one(ranking.pagerank_checksum(g))[0] == pytest.approx(0.5775)


def test_pagerank_closed_form(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (3, 4)], directed=False, capacity=9)
    n, m, cap = 5, 8, 9
    want = n + 0.85**10 * (0.15 * m - n) + 0.15 * (cap - n)
    assert one(ranking.pagerank_checksum(g))[0] == pytest.approx(want)
    assert one(ranking.pagerank(g, 1).agg(F.sum("rank")))[0] == pytest.approx(n * 0.15 + 0.85 * 0.15 * m)


def test_weighted_detour_and_negative_weights(spark, rows):
    g = graph(spark, [(0, 1, 10), (0, 2, 1), (2, 1, 2)], weighted=True)
    assert rows(traverse.sssp(g, 0)[0]) == [(0, 0), (1, 3), (2, 1)]
    assert rows(traverse.dijkstra(g, 0)) == [(0, 0), (1, 3), (2, 1)]
    bad = graph(spark, [(0, 1, 1), (1, 0, -2)], weighted=True)
    assert one(traverse.sssp_dist_sum(bad, 0)) == (-1, True)
    with pytest.raises(ValueError):
        traverse.dijkstra(bad, 0)


def test_negative_cycle_is_found_early(spark, rows, monkeypatch):
    # 400 vertices on a path; behind its third one a cycle of weight -1.
    path = [(k, k + 1, 1) for k in range(400)]
    seen, add = [], Steps.add
    monkeypatch.setattr(Steps, "add", lambda self, rows: seen.append(1) or add(self, rows))
    bad = graph(spark, [*path, (2, 900, 5), (900, 901, -9), (901, 2, 3)], weighted=True)
    assert one(traverse.sssp_dist_sum(bad, 0)) == (-1, True)
    assert len(seen) <= 16
    links = lambda x: spark.createDataFrame(x, "id bigint, via bigint")
    assert not traverse.has_cycle(links([(k, k - 1 if k else None) for k in range(9)]))
    assert not traverse.has_cycle(links([]))
    assert traverse.has_cycle(links([(0, None), (1, 0), (2, 4), (3, 2), (4, 3), (5, 4)]))
    assert traverse.has_cycle(links([(0, 0)]))
    # A cycle of weight 0 is none, and weights that are negative without one do no harm.
    zero = graph(spark, [(0, 1, 4), (1, 2, -3), (2, 1, 3), (2, 3, -5)], weighted=True)
    assert rows(traverse.sssp(zero, 0)[0]) == [(0, 0), (1, 4), (2, 1), (3, -4)] and not traverse.sssp(zero, 0)[1]


def test_far_distances_do_not_count(spark):
    g = graph(spark, [(0, 1, 999_999), (1, 2, 1)], weighted=True)
    assert one(traverse.sssp_dist_sum(g, 0)) == (999_999, False)


def test_delete_keeps_vertices(spark, rows):
    g = graph(spark, [(0, 1), (0, 2)])
    victims = spark.createDataFrame([(0, 1), (5, 6)], "src bigint, dst bigint")
    left = mutate.delete_edges(g, victims)
    assert rows(left.edges) == [(0, 2)] and rows(left.vertices) == [(0,), (1,), (2,)]
    assert access.degree_of(left, 0) == 1
    assert mutate.present_after_delete(left, victims).isEmpty()
    assert mutate.missing_after_ingest(g, spark.createDataFrame([(0, 1)], "src bigint, dst bigint")).isEmpty()


def test_histogram_bounds(spark, rows):
    g = graph(spark, [(100, k) for k in range(16)] + [(101, k) for k in range(17)], capacity=200)
    assert rows(measures.degree_histogram(g)) == [(0, 1, 16, 1, 99.5), (1, 17, 32, 1, 100.0)]
    assert one(measures.degree_stats(g)) == (17, 16, 0, 198, 2)


def test_batches_do_not_change_the_edges(spark, rows):
    edges = [(k % 7, k % 5) for k in range(60)]
    whole = graph(spark, edges, directed=False)
    frame = spark.createDataFrame([(*e, k) for k, e in enumerate(edges)], "src bigint, dst bigint, pos bigint")
    parts = empty_graph(spark, 7, directed=False)
    for k in range(3):
        parts = mutate.insert_edges(parts, frame.where(F.col("pos") % 3 == k))
    assert rows(parts.edges) == rows(whole.edges) and rows(parts.vertices) == rows(whole.vertices)
    again = mutate.insert_edges(whole, frame)
    assert rows(again.edges) == rows(whole.edges)
    stats = rows(mutate.batch_stats(frame, 40, False))
    assert sum(r[1] for r in stats) == 120 and sum(r[2] for r in stats) == whole.edges.count()
    assert whole.edges.count() == one(measures.one_hop(whole, whole.vertices))[0]


def test_multigraph(spark):
    frame = spark.createDataFrame([(0, 1), (0, 1)], "src bigint, dst bigint")
    assert from_edges(frame, dedup=False).edges.count() == 2


def test_lookups(spark, rows):
    g = graph(spark, [(0, 1), (0, 2), (3, 0), (None, 1)])
    assert access.has_edge(g, 0, 2) and not access.has_edge(g, 2, 0) and not access.has_edge(g, 9, 9)
    assert access.has_vertex(g, 3) and not access.has_vertex(g, 4)
    pairs = spark.createDataFrame([(0, 1), (0, 9), (0, 1)], "src bigint, dst bigint")
    assert rows(access.has_edges(g, pairs)) == [(0, 1, True), (0, 1, True), (0, 9, False)]
    assert rows(access.neighbors(g, 0)) == [(1,), (2,)]
    assert rows(access.capacity_degrees(g)) == [(0, 2), (1, 0), (2, 0), (3, 1)]
    with pytest.raises(ValueError):
        traverse.bfs(g, 77)
    with pytest.raises(ValueError):
        check_capacity(from_edges(g.edges, capacity=2))
    ids = spark.createDataFrame([(3,), (4,), (3,)], "id bigint")
    assert rows(access.has_vertices(g, ids)) == [(3, True), (3, True), (4, False)]
    assert rows(access.edge_weights(g, pairs)) == [(0, 1, 1), (0, 1, 1), (0, 9, 0)]


def test_capacity_grows_unless_given(spark, rows):
    more = spark.createDataFrame([(5, 9), (6, 9), (7, 9)], "src bigint, dst bigint")
    g = mutate.insert_edges(graph(spark, [(0, 1)]), more)
    assert g.capacity == 10 and one(measures.degree_stats(g)) == (1, 1, 0, 6, 4)
    assert one(ranking.cc_count(g)) == (2, 6)
    assert one(ranking.cc_count(mutate.insert_edges(graph(spark, [(0, 1)], capacity=12), more))) == (2, 8)
    with pytest.raises(Exception, match="outside the capacity"):
        mutate.insert_edges(graph(spark, [(0, 1)], capacity=9), more).edges.collect()
    assert rows(mutate.delete_edges(graph(spark, [(0, 1)], capacity=9), more).edges) == [(0, 1)]


def test_components_on_long_paths_and_hubs(spark, rows):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(300, 300)]
    labels = dict(rows(ranking.cc_labels(graph(spark, edges))))
    assert {labels[k] for k in range(100, 161)} == {100} and {labels[k] for k in range(200, 260)} == {1} and labels[300] == 300


def test_component_rounds_do_not_fill_the_driver(spark, rows, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(160, 259), (400, 401), (7, 7), (None, 3)], "a bigint, b bigint")
    want = sorted([(k, 1) for k in (1, *range(100, 161), *range(200, 260))] + [(400, 400), (401, 400)], key=repr)
    steps = []

    def noted(df, what):
        df.collect()
        steps.append(df._jdf.queryExecution().executedPlan().toString())
        return lineage.cut(df, what)

    monkeypatch.setattr(stars, "cut", noted)
    assert rows(stars.components(edges)) == want and len(steps) == 2  # few edges: no rounds, whatever the diameter
    monkeypatch.setattr(stars, "FEW", 0)
    assert rows(stars.components(edges)) == want and len(steps) > 4
    assert not any("BroadcastExchange" in step for step in steps)


def test_frontier_api(spark, rows):
    g = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 0)])
    start = frontier_of(spark, [0, 0])
    assert rows(edge_map(g, start, {"n": F.count("*")})) == [(1, 1), (2, 1)]
    assert rows(edge_map(g, start, {"n": F.count("*")}, reverse=True)) == [(2, 1)]
    assert rows(edge_map(g, frontier_of(spark, [0, 1]), {"least": F.min("src")}, settled=frontier_of(spark, [1]))) == [(2, 0)]
    assert rows(vertex_map(g.vertices, {"twice": F.col("id") * 2}, F.col("id") > 0)) == [(1, 2), (2, 4)]
    assert rows(union(start, frontier_of(spark, [1, 0]))) == [(0,), (1,)]
    steps, done = supersteps(start, lambda now, s: now.where("false"), "idle")
    assert done and steps.n == 2


def test_bfs_parents(spark, rows):
    g = graph(spark, [(5, 1), (5, 2), (2, 3), (1, 3)])
    assert rows(traverse.bfs(g, 5)) == [(1, 1, 5), (2, 1, 5), (3, 2, 1), (5, 0, 5)]
    assert rows(measures.sample_vertices(g, 10, 1)) == [(1,), (2,), (5,)]
    assert rows(measures.two_hop_by_vertex(g, g.vertices)) == [(1, 0), (2, 0), (3, 0), (5, 2)]
