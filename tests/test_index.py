"""Searches of an index that read a small part of it."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecengine.index import IndexParams, VectorIndex
from vecengine.operators import cluster, evaluate, graph, quantize, search


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    """50,000 rows in 500 groups, their index, 100 queries, and the true answers."""
    g = np.random.default_rng(11)
    x = g.standard_normal((500, 16))[g.integers(0, 500, 50_000)] * 2 + g.standard_normal((50_000, 16)) * 0.7
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "v": x.tolist()}), "vec_id long, v array<double>").repartition(4)
    index = VectorIndex.build(rows, str(tmp_path_factory.mktemp("index") / "i"), IndexParams(clusters=64, block_bytes=1024))
    q = rows.where("vec_id % 500 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv")).cache()
    return index, q, search.knn(q, rows, 10).cache()


def mean_recall(found, truth):
    return evaluate.recall(found, truth).agg(F.avg("recall")).first()[0]


def test_a_few_blocks_and_nodes_give_nearly_all_neighbours(held):
    index, q, truth = held
    blocks, nodes, parts, told = index.blocks().count(), index.graph().count(), index._table("routes").count(), []
    assert blocks > 3000 and parts >= 6
    assert mean_recall(index.knn_by_graph(q, 10, 64, parts=4, told=told), truth) >= 0.9  # 2 % of the blocks
    assert mean_recall(index.knn(q, 10, 64), truth) >= 0.95
    assert sum(n for n, _ in told) <= 100 * 8 and sum(d for _, d in told) < 0.5 * 100 * nodes


def test_a_range_follows_edges_from_a_few_parts(held):
    index, q, _ = held
    radius = 9.0
    want = {(r.qid, r.vec_id) for r in index.range(q, radius).collect()}
    found = {(r.qid, r.vec_id) for r in index.range_by_graph(q, radius, factor=1.6).collect()}
    assert len(want) > 500 and found <= want and len(found) >= 0.9 * len(want)


def records_read(spark, job):
    """Rows that the scans of a job gave, as Spark counted them."""
    store, gate = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    args = (None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    seen = lambda: {s.stageId(): s.inputRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(*args))}
    before = seen()
    job()
    return sum(n for i, n in seen().items() if i not in before)


def test_blocks_that_are_not_probed_are_not_read(spark, held):
    index, q, _ = held
    members, _ = index._keyed()
    keys = np.array(sorted(r.cid for r in index._keyed()[1].select("cid").collect()))
    probed = keys[[100, 101, 2000]]
    some = members.where(search.in_ranges("cid", search.ranges_of(probed)))
    got = []
    read = records_read(spark, lambda: got.extend(some.groupBy("cid").count().collect()))
    assert sorted(r.cid for r in got) == probed.tolist()
    assert 0 < read < 0.1 * index.rows


def test_ranges_hold_all_keys_and_little_else():
    g = np.random.default_rng(1)
    keys = np.unique(g.integers(0, 10**6, 1000))
    for most in (1, 2, 7, 128, 5000):
        ranges = search.ranges_of(keys, most)
        assert len(ranges) <= most and all(any(a <= k <= b for a, b in ranges) for k in keys.tolist())
        assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))
    assert sum(b - a + 1 for a, b in search.ranges_of(np.array([1, 2, 3, 9, 10, 50]), 10)) == 6
    assert search.ranges_of(np.array([], np.int64)) == []


def test_a_walk_crosses_parts_and_deals_out_queries(spark, monkeypatch):
    g = np.random.default_rng(3)
    x = np.sort(g.standard_normal((400, 3)), axis=0)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, v array<double>")
    nodes = v.withColumn("cid", F.floor(F.col("vec_id") / 100))
    held = graph.adjacency(nodes, graph.symmetrize(graph.descent(v, 8), 16))
    q = v.where("vec_id % 20 = 10").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    truth = search.knn(q, v, 5)
    starts = q.select("qid", F.floor(F.col("qid") / 100).alias("cid"))
    alone = mean_recall(graph.beam_knn(starts, q, held, 5, 40, hops=0), truth)
    crossed = mean_recall(graph.beam_knn(starts, q, held, 5, 40, hops=1), truth)
    assert crossed >= 0.97 and crossed >= alone
    monkeypatch.setattr(graph, "ASKED", 2)
    assert math.isclose(mean_recall(graph.beam_knn(starts, q, held, 5, 40, hops=1), truth), crossed)


def test_a_graph_of_codes_is_walked_and_its_nodes_are_scored_anew(spark, tmp_path):
    g = np.random.default_rng(12)
    x = g.standard_normal((60, 8))[g.integers(0, 60, 3000)] * 2 + g.standard_normal((3000, 8)) * 0.7
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, v array<double>")
    params = IndexParams(clusters=8, block_bytes=512, least_rows=6, graph_codes=16)
    VectorIndex.build(rows, str(tmp_path / "i"), params)
    index = VectorIndex.load(spark, str(tmp_path / "i"))
    assert index.params == params and dict(index.graph().dtypes)["v"] == "array<smallint>"
    book = quantize.table_of(index._table("codebook"))
    assert book.shape == (8, 16) and (np.diff(book, axis=1) > 0).all()
    q = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    truth, blocks = search.knn(q, rows, 10), index.blocks().count()
    assert mean_recall(index.knn_by_graph(q, 10, blocks // 8), truth) >= 0.9
    # the nodes' scores are those of their vectors, not of codes
    nodes = {r.vec_id: np.array(r.v) for r in index._nodes().collect()}
    for r in index.walk(q, 4, 20).collect():
        assert math.isclose(r.score, ((x[r.qid] - nodes[r.vec_id]) ** 2).sum(), rel_tol=1e-9)
    want = {(r.qid, r.vec_id) for r in index.range(q, 4.0).collect()}
    found = {(r.qid, r.vec_id) for r in index.range_by_graph(q, 4.0, factor=1.6).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_codes_are_the_nearest_codewords_and_their_distances_those_of_tables():
    g = np.random.default_rng(13)
    table = np.sort(g.standard_normal((5, 6)), axis=1)
    table[1, 4:] = np.inf  # fewer codewords
    x = np.concatenate([g.standard_normal((50, 5)), (table[:, :1] + table[:, 1:2]).T / 2])
    codes = quantize.nearest_codes(x, table)
    apart = np.abs(x[:, :, None] - table[None])
    assert (codes == apart.argmin(axis=2))[:50].all() and (codes[50] == 0).all()
    pairs = (table[:, :, None] - np.where(np.isinf(table), 0, table)[:, None, :]) ** 2  # code-to-code
    want = sum(pairs[d][codes[:, d][:, None], codes[:, d][None, :]] for d in range(5))
    assert np.allclose(quantize.code_metric(table).kernel(codes.astype(float), codes.astype(float)), want)


def test_small_blocks_are_merged_where_there_is_room():
    g = np.random.default_rng(14)
    for _ in range(30):
        x, label = g.standard_normal((80, 3)), g.integers(0, int(g.integers(1, 30)), 80)
        label[0] = 99
        new = cluster.merge_blocks(x, label, 15, 7)
        sizes = np.sort(np.bincount(new))
        assert sizes.sum() == 80 and sizes.max() <= max(15, np.bincount(label).max())
        assert len(sizes) == 1 or sizes[0] >= 7 or sizes[0] + sizes[1] > 15
        assert all(len(set(new[label == b])) == 1 for b in set(label))  # blocks are put together whole


def test_small_parts_are_dissolved_between_levels(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SPLIT_ROWS", 100)
    g = np.random.default_rng(15)
    x = np.concatenate([g.standard_normal((500, 2)), g.standard_normal((6, 2)) * 0.1 + [[30, 30]], np.full((150, 2), -40.0)])
    v = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "vec_id long, cid long, v array<double>")
    plain = cluster._parts(v, 5).groupBy("part").count().collect()
    dealt = cluster._parts(v, 5, least=10)
    sizes = {r.part: r["count"] for r in dealt.groupBy("part").count().collect()}
    assert min(r["count"] for r in plain) < 10 <= min(sizes.values())
    assert dealt.select("vec_id").distinct().count() == dealt.count() == len(x)
    assert cluster.pack_clusters(v, 15, 5, 7).select("vec_id").distinct().count() == len(x)


def test_a_search_of_all_blocks_needs_no_probes(held, monkeypatch):
    index, q, truth = held
    monkeypatch.setattr(search, "probe", lambda *_: pytest.fail("pairs of every query and every block"))
    rows = lambda df: {(r.qid, r.rank, r.vec_id) for r in df.collect()}
    assert rows(index.knn(q, 10, index.blocks().count())) == rows(truth)


def test_a_range_by_product_with_many_queries_makes_no_pairs(spark, tmp_path, monkeypatch):
    g = np.random.default_rng(13)
    x = g.standard_normal((600, 6)) * g.uniform(0.5, 3, (600, 1))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, v array<double>")
    index = VectorIndex.build(rows, str(tmp_path / "i"), IndexParams(metric="ip", clusters=6, block_bytes=512))
    q = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    monkeypatch.setattr(search, "SENT", 8)
    found = index.range(q, 20.0)
    i, j = np.nonzero(x[::10] @ x.T > 20.0)
    assert len(i) and sorted((r.qid, r.vec_id) for r in found.collect()) == sorted(zip((10 * i).tolist(), j.tolist(), strict=True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CoGroup" not in plan
