"""The golden values of the smallest projections: registered vertices, capacity, measures and checksums."""

import os

import pytest

from edgeloom.operators import measures, ranking, traverse
from edgeloom.plans.projections import graph

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Edges, vertices, capacity, depth sum from 0, components, with empty ids, PageRank checksum, two-hop paths.
GOLDEN = {
    "p1": (510, 263, 400, 1385, 24, 161, 246.8329, 1310),
    "p2": (3810, 210, 399, 408, 1, 190, 309.5201, 381238),
    "p3": (5942, 1476, 1500, 898, 1, 25, 1295.9478, 23995),
    "p4": (221, 15, 15, 14, 1, 1, 18.5733, 3256),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, name):
    g = graph(spark, DATA, name).persist()
    n_edges, n_vertices, capacity, depth, cc, cc_empty, rank, hops = GOLDEN[name]
    assert (g.edges.count(), g.count_vertices(), g.capacity) == (n_edges, n_vertices, capacity)
    assert traverse.bfs_depth_sum(g, [0]).first()["depth_sum"] == depth
    assert traverse.sssp_dist_sum(g, 0).first()["dist_sum"] == depth
    assert tuple(ranking.cc_count(g).first()) == (cc, cc_empty)
    assert ranking.pagerank_checksum(g).first()[0] == pytest.approx(rank, abs=5e-5)
    assert measures.two_hop(g, g.vertices).first()[0] == hops
    g.unpersist()


def test_depths_from_the_giant_component(spark):
    assert tuple(traverse.bfs_depth_sum(graph(spark, DATA, "p1").persist(), [1]).first()) == (1, 894, 165)
