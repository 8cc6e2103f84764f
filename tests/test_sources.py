"""Text files, snapshots, streaming and the scalar functions."""

import random

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import bits
from edgeloom.model import GraphSpec, dense_ids, empty_graph, first_seen, from_edges
from edgeloom.operators import mutate
from edgeloom.sources import edge_list, store
from edgeloom.streaming import ingest


def test_edge_list(spark, rows, tmp_path):
    (tmp_path / "e.txt").write_text("# header\n1 2\n3\t4\n\n 5   6 \n7 8 9")
    got = edge_list.read_edge_list(spark, str(tmp_path / "e.txt"), id_base=1)
    assert rows(got.select("src", "dst")) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    assert rows(edge_list.read_edge_list(spark, str(tmp_path / "e.txt"), weighted=True).drop("pos")) == [(7, 8, 9)]
    with pytest.raises(Exception, match="not an edge"):
        edge_list.read_edge_list(spark, str(tmp_path / "e.txt"), strict=True).collect()
    (tmp_path / "c.txt").write_text("1,2\n2,2\n")
    assert rows(edge_list.read_edge_list(spark, str(tmp_path / "c.txt"), sep=",").drop("pos")) == [(1, 2), (2, 2)]


def test_vertex_list_and_sinks(spark, rows, tmp_path):
    (tmp_path / "v.txt").write_text("3\n\n1\n3\n9\n")
    known = spark.createDataFrame([(1,), (3,)], "id bigint")
    assert rows(edge_list.read_vertex_list(spark, str(tmp_path / "v.txt"))) == [(1,), (3,), (9,)]
    ids = edge_list.read_vertex_list(spark, str(tmp_path / "v.txt"), known)
    edge_list.dump_vertices(ids, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1", "3"]
    edge_list.write_lines(known, str(tmp_path / "lines"))
    edge_list.write_lines(known, str(tmp_path / "lines"), append=True)
    assert spark.read.text(str(tmp_path / "lines")).count() == 4
    assert edge_list.write_log(spark, str(tmp_path), "done").endswith("_insert_test.log")


def test_profile_and_shuffle(spark, rows):
    raw = spark.createDataFrame([(1, 2), (1, 2), (3, 3)], "src bigint, dst bigint")
    assert tuple(edge_list.profile(raw).first()) == (3, 1, 3, 3, 2, 1)
    assert tuple(edge_list.profile(raw.limit(0)).first()) == (0, None, None, 0, 0, 0)
    lines = spark.createDataFrame([(k, f"x{k}" if k != 4 else " ") for k in range(25)], "pos bigint, value string")
    out = rows(edge_list.shuffle_lines(lines, 5, 10).select("block_id", "out_pos", "pos"))
    assert len(out) == 24 and all(p // 10 == b for b, _, p in out) and len({o for _, o, _ in out}) == 24


def test_dense_ids(spark, rows):
    raw = spark.createDataFrame([(7, 5, 0), (5, 9, 1)], "src bigint, dst bigint, pos bigint")
    assert rows(dense_ids(first_seen(raw))) == [(5, 0), (7, 1), (9, 2)]


def test_snapshots(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    store.create(spark, path, 10)
    g = from_edges(spark.createDataFrame([(0, 1), (2, 1)], "src bigint, dst bigint"), capacity=10)
    assert store.commit(g, path) == 1
    back = store.load(spark, path)
    assert rows(back.edges) == rows(g.edges) and rows(back.vertices) == rows(g.vertices) and back.capacity == 10 and back.directed
    assert store.load(spark, path, 0).edges.isEmpty()
    assert tuple(store.usage(spark, path).first())[:3] == (1, 2, 3)


def test_streaming(spark, rows, tmp_path):
    path, incoming = str(tmp_path / "store"), tmp_path / "in"
    incoming.mkdir()
    store.create(spark, path, 100)
    (incoming / "a.txt").write_text("0 1\n1 2\n")
    (incoming / "b.txt").write_text("1 2\n2 3\n")
    stream = ingest.edge_stream(spark, str(incoming))
    q = ingest.ingest(stream, path, str(tmp_path / "cp"))
    q.awaitTermination()
    assert len(ingest.progress(q)) >= 2
    assert rows(store.load(spark, path).edges) == [(0, 1), (1, 2), (2, 3)]
    ingest.apply_once(path, str(tmp_path / "cp"))(spark.createDataFrame([(8, 9)], "src bigint, dst bigint"), 1)  # a replayed batch
    assert store.load(spark, path).edges.count() == 3
    gone = tmp_path / "gone"
    gone.mkdir()
    (gone / "a.txt").write_text("1 2\n7 7\n")
    for _ in range(2):  # another stream upon the same store, started twice
        ingest.ingest(ingest.edge_stream(spark, str(gone)), path, str(tmp_path / "cp2"), delete=True).awaitTermination()
    assert rows(store.load(spark, path).edges) == [(0, 1), (2, 3)]


def test_changes_upon_a_base(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CHANGES", 3)
    path, g = str(tmp_path / "store"), empty_graph(spark, 50, directed=False, weighted=True)
    store.create(spark, path, 50, directed=False, weighted=True)
    rng = random.Random(4)
    for k in range(9):
        batch = spark.createDataFrame([(p, rng.randrange(6), rng.randrange(6), rng.randrange(100)) for p in range(7)], "pos bigint, src bigint, dst bigint, weight int")
        delete = k % 3 == 2
        g = (mutate.delete_edges if delete else mutate.insert_edges)(g, batch)
        assert store.change(path, batch, delete) == k + 1
        back = store.load(spark, path)
        assert rows(back.edges) == rows(g.edges) and rows(back.vertices) == rows(g.vertices)
    assert store.latest(spark, path)["base"] > 0
    assert rows(store.load(spark, path, 0).edges) == []
    with pytest.raises(Exception, match="outside the capacity"):
        store.change(path, spark.createDataFrame([(1, 50, 1)], "src bigint, dst bigint, weight int"))


def test_positions_have_no_gaps(spark, rows, tmp_path):
    (tmp_path / "b.txt").write_text("# head\n" + "".join(f"{k} {k + 1}\n" for k in range(3000)))
    (tmp_path / "a.txt").write_text("9 9\n\n8 8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = rows(edge_list.read_edge_list(spark, str(tmp_path)).select("pos", "src"))
        path = str(tmp_path / "store")
        store.create(spark, path)
        stats = ingest.ingest_file(spark, str(tmp_path / "*.txt"), path, batch_size=1000, num_batches=2)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == [(k, s) for k, s in enumerate([9, 8, *range(3000)])]
    assert [(x.attempted, x.changed) for x in stats] == [(1000, 1000), (2002, 2002)]


def test_batches_into_a_store(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    store.create(spark, path, 10, directed=False)
    raw = spark.createDataFrame([(0, 0, 1), (1, 1, 2), (2, 0, 1), (3, 5, 5), (4, 2, 3)], "pos bigint, src bigint, dst bigint")
    stats = ingest.ingest_in_batches(raw, path, 4, verify=True)
    assert [(x.batch, x.attempted, x.changed) for x in stats] == [(0, 4, 4), (1, 4, 1), (2, 2, 2)]
    assert store.load(spark, path).edges.count() == 7
    gone = ingest.ingest_in_batches(raw.where("pos < 2"), path, 100, delete=True, verify=True)
    assert [x.changed for x in gone] == [4] and rows(store.load(spark, path).edges) == [(2, 3), (3, 2), (5, 5)]
    assert ingest.ingest_in_batches(raw.limit(0), path) == []


def test_read_graph(spark, rows, tmp_path):
    (tmp_path / "g.txt").write_text("1 2 7\n2 2 3\n2 1 9\n")
    g = edge_list.read_graph(spark, str(tmp_path / "g.txt"), GraphSpec("mini", directed=False, weighted=True, id_base=1, capacity=14))
    assert rows(g.edges) == [(0, 1, 7), (1, 0, 7), (1, 1, 3)] and g.capacity == 14
    assert rows(edge_list.self_loops(g.edges)) == [(1, 1, 3)]


def test_bits(spark):
    x = F.lit(0b1011).cast("bigint")
    row = spark.range(1).select(bits.get_bits(x, 1, 2), bits.branch(x, 1), bits.fingerprint(F.lit(513)), bits.bit_set(x, 2), bits.bit_clear(x, 0), bits.bit_flip(x, 3), bits.bit_test(x, 2), bits.first_zero(x, 4), bits.first_zero(F.lit(15).cast("bigint"), 4), bits.xor_fold(F.lit(0x0102030405060708).cast("bigint"))).first()
    assert tuple(row) == (1, 2, 1, 15, 10, 3, False, 2, -1, 1 ^ 2 ^ 3 ^ 4 ^ 5 ^ 6 ^ 7 ^ 8)
    at = F.timestamp_seconds(F.lit(0))
    assert tuple(spark.range(1).select(bits.timestamp_number(at), bits.date_text(at), bits.time_text(at)).first()) == (19700101000000, "19700101", "00:00:00")
