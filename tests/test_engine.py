import math
import re

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from vecengine.functions import vectors as V
from vecengine.index import IndexParams, VectorIndex
from vecengine.operators import cluster, evaluate, graph, quantize, search
from vecengine.sources import binary
from vecengine.streaming.search import stream_knn


def table(spark, x, name="vec_id", value="v"):
    return spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], f"{name} long, {value} array<double>")


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).standard_normal((300, 8))


def brute(q, x, k):
    d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return {(i, int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]}


def pairs(df):
    return {(r.qid, r.vec_id) for r in df.collect()}


def test_blocks_of_queries_give_what_sent_queries_give(spark, x, monkeypatch):
    q, v = table(spark, x[:30], "qid", "qv"), table(spark, x)
    want = brute(x[:30], x, 5)
    assert pairs(search.knn(q, v, 5)) == want
    monkeypatch.setattr(search, "SENT", 4)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 64)
    assert pairs(search.knn(q, v, 5)) == want


def test_ties_go_to_the_smaller_id_and_short_answers_are_short(spark):
    v = table(spark, [[1, 0], [1, 0], [0, 1]])
    q = table(spark, [[1, 0]], "qid", "qv")
    assert [(r.rank, r.vec_id) for r in search.knn(q, v, 2).orderBy("rank").collect()] == [(1, 0), (2, 1)]
    assert search.knn(q, v, 9).count() == 3
    assert search.knn(q, v.limit(0), 3).count() == 0


def test_null_vectors_are_left_out(spark):
    v = spark.createDataFrame([(1, [1.0]), (2, None), (None, [2.0])], "vec_id long, v array<double>")
    q = spark.createDataFrame([(1, [1.0]), (2, None)], "qid long, qv array<double>")
    assert pairs(search.knn(q, v, 5)) == {(1, 1)}


def test_more_probes_never_lose_recall_and_all_probes_are_exact(spark, x):
    q, v = table(spark, x[:20], "qid", "qv"), table(spark, x)
    c = table(spark, x[:12], "cid", "c")
    members = search.assign(v, c)
    truth = search.knn(q, v, 5)
    got = [evaluate.recall(search.ivf_knn(q, members, c, 5, n), truth).agg(F.avg("recall")).first()[0] for n in (1, 4, 12)]
    assert got == sorted(got) and got[-1] == 1.0


def test_pruned_range_is_exact(spark, x):
    q, v = table(spark, x[:20], "qid", "qv"), table(spark, x)
    c = table(spark, x[:12], "cid", "c")
    members = search.assign(v, c)
    exact = pairs(search.within(q, v, 4.0))
    assert pairs(search.range_pruned(q, members, c, 4.0)) == exact
    assert pairs(search.ivf_range(q, members, c, 4.0)) <= exact


def test_ids_pack_and_unpack(spark):
    df = spark.createDataFrame([(255, 0xFFFFFF, 0xFFFFFFFF), (0, 0, 0), (128, 7, 9)], "a long, b long, c long")
    packed = df.withColumn("p", V.pack_node_id(F.col("a"), F.col("b"), F.col("c")))
    a, b, c = V.unpack_node_id(F.col("p"))
    assert packed.where((a != F.col("a")) | (b != F.col("b")) | (c != F.col("c"))).count() == 0


def test_metrics_can_be_added():
    V.register_metric("l1", lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, z: s + z), True)
    assert V.metric("l1")[1]
    with pytest.raises(ValueError):
        V.metric("none")
    V.METRICS.pop("l1")


def test_codes_lose_no_more_than_a_step(spark, x):
    v = table(spark, x)
    lo, hi = quantize.bounds(quantize.train(v))
    back = v.select("v", quantize.decode(quantize.encode(F.col("v"), lo, hi), lo, hi).alias("w")).collect()
    step = (np.array(hi) - np.array(lo) + 1) / 256
    assert all((np.abs(np.array(r.v) - np.array(r.w)) <= step + 1e-12).all() for r in back)


def test_codebook_is_sorted_and_bounded(spark, x):
    book = quantize.train_codebook(table(spark, x), 8, 3)
    rows = book.orderBy("dim", "code").collect()
    by = {}
    for r in rows:
        by.setdefault(r.dim, []).append(r.value)
    assert len(by) == 8 and all(len(b) <= 8 and b == sorted(b) for b in by.values())


@pytest.mark.parametrize(("n", "k"), [(10, 3), (100, 7), (50, 50)])
def test_balanced_clusters_differ_by_one_at_most(n, k):
    x = np.random.default_rng(n).standard_normal((n, 4))
    sizes = np.bincount(cluster.balanced(x, k), minlength=k)
    assert sizes.max() <= -(-n // k) and sizes.min() >= n // k


def test_blocks_hold_every_row_once(spark, x):
    v = table(spark, np.concatenate([x, np.zeros((40, 8))]))
    packed = cluster.pack_clusters(search.assign(v, table(spark, x[:3], "cid", "c")), 15)
    assert packed.select("vec_id").distinct().count() == packed.count() == 340
    assert packed.groupBy("cid", "block_id").count().agg(F.max("count")).first()[0] <= 15


def test_a_zero_sum_falls_back_to_the_mean(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [-1.0, 0.0])], "cid long, v array<double>")
    assert cluster.centroids(rows, 2.0).first().c == [0.0, 0.0]


def test_empty_clusters_are_repaired():
    x = ((11 * np.arange(200)[:, None] + np.arange(128)) % 255).astype(float)
    label = cluster.repair_empty(np.zeros(200, np.int64), 2)
    assert np.bincount(label).tolist() == [100, 100] and (label[:100] == 1).all()
    assert np.bincount(cluster.repair_empty(np.zeros(3, np.int64), 5), minlength=5).max() == 1
    cents = np.stack([x[:100].mean(axis=0), x[100:].mean(axis=0)])
    assert (cluster.assign_penalised(x, cents, 0.0) == search.scores(x, cents, "l2").argmin(axis=1)).all()
    assert np.bincount(cluster.assign_penalised(x, cents, 1e9)).tolist() == [100, 100]


def test_sampling_floor():
    assert cluster.sample_size(500, 10) == 390 and cluster.sample_size(10**6, 10) == 10_000
    with pytest.raises(ValueError):
        cluster.sample_size(3, 10)


def test_capacity():
    assert cluster.capacity(64) == 15 and cluster.capacity(64, coded=True) == 60
    with pytest.raises(ValueError):
        cluster.capacity(4096)


@pytest.mark.parametrize("coded", [False, True])
def test_index_round_trip(spark, x, tmp_path, coded):
    params = IndexParams(clusters=4, block_bytes=512, coded=coded)
    VectorIndex.build(table(spark, x), str(tmp_path / "i"), params)
    index = VectorIndex.load(spark, str(tmp_path / "i"))
    assert index.params == params and index.rows == 300
    assert index.members().select("vec_id").distinct().count() == 300
    q = table(spark, x[:10], "qid", "qv")
    found = pairs(index.knn(q, 5, 10_000))
    want = brute(x[:10], x, 5)
    assert found == want if not coded else len(found & want) >= 45
    within = pairs(search.within(q, index.members(), 3.0))
    assert pairs(index.range(q, 3.0)) == within and pairs(index.range(q, 3.0, 0.5)) <= within
    met = pairs(index.range_by_graph(q, 3.0, 4, factor=2.0))
    assert met <= within and len(met) >= 0.8 * len(within)
    assert len(pairs(index.knn_by_graph(q, 5, 40, 4)) & want) >= 40


def test_a_probe_reads_the_ranges_of_its_cells_only(spark, x, tmp_path):
    index = VectorIndex.build(table(spark, x), str(tmp_path / "i"), IndexParams(clusters=6, block_bytes=512, sample=2))
    q = table(spark, x[:1], "qid", "qv")
    found = index.knn(q, 5, 2)
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*key", plan)
    cells = search.probe(q, index._keyed()[1], 2).select("cid")
    rows = index._keyed()[0].join(cells, "cid", "left_semi").count()
    assert found.count() == 5 and 0 < rows <= 2 * 15 < index.rows
    assert index.graph().count() > index.blocks().count()


def test_large_clusters_are_split_by_distance(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SPLIT_ROWS", 60)
    g = np.random.default_rng(4)
    x = np.concatenate([g.standard_normal((300, 4)) * 0.1 + 10 * c for c in np.eye(4)[:3]] + [np.zeros((200, 4))])
    packed = cluster.pack_clusters(table(spark, x).withColumn("cid", F.lit(0).cast("long")), 15)
    rows = packed.collect()
    assert len({r.vec_id for r in rows}) == len(rows) == 1100
    place = lambda i: min(i // 300, 3)
    parts, blocks = {}, {}
    for r in rows:
        parts.setdefault(r.block_id >> 20, set()).add(place(r.vec_id))
        blocks.setdefault(r.block_id, []).append(r.vec_id)
    assert len(parts) > 10 and all(len(p) == 1 for p in parts.values())
    assert max(map(len, blocks.values())) <= 15


def test_many_queries_are_dealt_out_in_blocks(spark, x, monkeypatch):
    v, c, q = table(spark, x), table(spark, x[:4], "cid", "c"), table(spark, x[:30], "qid", "qv")
    members = search.assign(v, c)
    sent = pairs(search.ivf_knn(q, members, c, 5, 2))
    monkeypatch.setattr(search, "SENT", 8)
    assert pairs(search.ivf_knn(q, members, c, 5, 2)) == sent


def test_a_metric_of_ones_own(spark, x):
    V.register_metric("l1", lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d), True)
    q, v = table(spark, x[:5], "qid", "qv"), table(spark, x)
    order = np.abs(x[:5, None] - x[None]).sum(axis=2).argsort(axis=1)[:, :4]
    assert pairs(search.knn_by(q, v, 4, "l1")) == {(i, int(j)) for i in range(5) for j in order[i]}
    assert pairs(search.knn_by(q, v, 4, "l2")) == pairs(search.knn(q, v, 4))


def test_a_kernel_of_ones_own_goes_through_every_search(spark, x, monkeypatch):
    def column(a, b):
        return F.array_max(F.zip_with(a, b, lambda p, q: F.abs(p - q)))

    def kernel(q, v):
        return np.abs(q[:, None] - v[None]).max(axis=2)

    V.register_metric("farthest", column, True, kernel)
    q, v = table(spark, x[:30], "qid", "qv"), table(spark, x)
    d = np.abs(x[:30, None] - x[None]).max(axis=2)
    want = {(i, int(j)) for i in range(30) for j in d[i].argsort()[:4]}
    c = table(spark, x[:6], "cid", "c")
    members = search.assign(v, c)
    near = {(i, j) for i, j in zip(*np.nonzero(d < np.median(d)), strict=True)}
    for sent in (4096, 8):
        monkeypatch.setattr(search, "SENT", sent)
        assert pairs(search.knn(q, v, 4, "farthest")) == pairs(search.ivf_knn(q, members, c, 4, 6, "farthest")) == want
        assert pairs(search.within(q, v, float(np.median(d)), "farthest")) == near
        assert pairs(search.range_pruned(q, members, c, float(np.median(d)), metric="farthest")) == near  # without a bound
    monkeypatch.undo()
    assert pairs(search.knn_by(q, v, 4, "farthest")) == want
    V.register_metric("farthest", column, True)
    with pytest.raises(ValueError, match="no kernel"):
        search.knn(q, v, 4, "farthest")
    V.METRICS.pop("farthest")


def test_kernels_tell_the_distances_that_they_made(spark, x, monkeypatch):
    v, c, q = table(spark, x), table(spark, x[:4], "cid", "c"), table(spark, x[:30], "qid", "qv")
    members = search.assign(v, c)
    sizes = {r.cid: r.n for r in members.groupBy("cid").agg(F.count("*").alias("n")).collect()}
    probes = search.probe(q, c, 2).collect()
    want, plain = sum(sizes[r.cid] for r in probes), pairs(search.ivf_knn(q, members, c, 5, 2))
    for sent in (4096, 8):
        monkeypatch.setattr(search, "SENT", sent)
        seen = Observation()
        assert pairs(search.ivf_knn(q, members, c, 5, 2, seen=seen)) == plain
        assert seen.get == {"distances": want}
    seen = Observation()
    assert search.ivf_knn(q.limit(0), members, c, 5, 2, seen=seen).collect() == [] and seen.get == {"distances": 0}


def test_bounds_leave_out_no_cell_that_holds_a_row():
    g = np.random.default_rng(8)
    for name in ("l2", "ip", "manhattan"):
        m = V.metric(name)
        for _ in range(20):
            c, rows, q = g.standard_normal((5, 6)) * 3, g.standard_normal((5, 40, 6)), g.standard_normal((9, 6)) * 2
            rows = rows * g.uniform(0, 2, (5, 1, 1)) + c[:, None]
            reach = np.sqrt(((rows - c[:, None]) ** 2).sum(axis=2)).max(axis=1)
            s = np.stack([m.kernel(q, r) for r in rows], axis=1)
            for radius in np.quantile(s, [0.01, 0.3, 0.99]):
                assert not (m.within(s, radius).any(axis=2) & ~m.may_hold(q, c, reach, radius)).any()
    tight = V.metric("ip").may_hold(np.eye(2), np.array([[1.0, 0.0]]), np.array([0.5]), 1.5 + 1e-6)
    assert not tight.any()


def test_a_range_by_inner_product_reads_few_cells(spark):
    g = np.random.default_rng(9)
    x = (g.standard_normal((50, 8))[:, None] * 3 + g.standard_normal((50, 40, 8)) * 0.2).reshape(-1, 8)
    v, q = table(spark, x), table(spark, x[::100], "qid", "qv")
    members = search.assign(v, table(spark, x[::40], "cid", "c"))
    radius = 60.0
    i, j = np.nonzero(x[::100] @ x.T > radius)
    assert pairs(search.range_pruned(q, members, table(spark, x[::40], "cid", "c"), radius, metric="ip")) == set(zip(i.tolist(), j.tolist(), strict=True))
    reach = np.array([np.sqrt(((x[a : a + 40] - x[a]) ** 2).sum(axis=1)).max() for a in range(0, len(x), 40)])
    assert V.metric("ip").may_hold(x[::100], x[::40], reach, radius).mean() < 0.6


def test_lloyd_repairs_empty_clusters_and_stops(spark, x):
    far = np.concatenate([x[:5], np.full((1, 8), 1e6)])
    v, start = table(spark, x), table(spark, far, "cid", "c")
    assert cluster.lloyd(v, start, 5).count() == 5
    assert cluster.lloyd(v, start, 5, repair=True).count() == 6
    assert cluster.lloyd(v, start, 50, stop=0.5, repair=True).count() == 6


def test_graph(spark, x):
    v = table(spark, x)
    edges = graph.knn_graph(v.withColumn("cid", F.lit(0)), 6)
    told = graph.integrity(edges, v).first()
    assert (told.edges, told.self_loops, told.repeated, told.dangling) == (1800, 0, 0, 0)
    both = graph.symmetrize(graph.diverse(edges, v, 6), 12)
    assert both.groupBy("src").count().agg(F.max("count")).first()[0] <= 12
    q = table(spark, x[:20], "qid", "qv")
    held = graph.adjacency(v.withColumn("cid", F.lit(0)), graph.symmetrize(edges, 12))
    answer = graph.beam_knn(q.select("qid", F.lit(0).alias("cid")), q, held, 5, 100)
    assert evaluate.recall(answer, search.knn(q, v, 5)).agg(F.avg("recall")).first()[0] >= 0.95
    seeds = q.select("qid", F.col("qid").alias("vec_id"))
    near = pairs(graph.radius_expand(seeds, both, v, q, 5.0))
    assert {(i, i) for i in range(20)} <= near <= pairs(search.within(q, v, 5.0))


def test_lims_are_cumulative(spark):
    q = spark.createDataFrame([(i, [0.0]) for i in (1, 5, 3000)], "qid long, qv array<double>")
    found = spark.createDataFrame([(1, 2), (1, 3), (3000, 4)], "qid long, vec_id long")
    assert [(r.qid, r.n, r.lim) for r in evaluate.lims(q, found).orderBy("qid").collect()] == [(1, 2, 2), (5, 0, 2), (3000, 1, 3)]


@pytest.mark.parametrize(("kind", "dtype"), [("fbin", "<f4"), ("u8bin", "u1"), ("i8bin", "i1")])
def test_vector_files(spark, tmp_path, kind, dtype):
    x = np.arange(-12, 12).reshape(6, 4).astype(dtype)
    path = tmp_path / f"a.{kind}"
    path.write_bytes(np.array([6, 4], "<u4").tobytes() + x.tobytes())
    assert binary.header(spark, str(path)) == (6, 4)
    read = binary.read_vectors(spark, str(path))
    assert [r.embedding for r in read.orderBy("vec_id").collect()] == x.astype(float).tolist()
    assert binary.pack_vectors(read, kind) == path.read_bytes()


def test_answer_files(spark, tmp_path):
    (tmp_path / "t").write_bytes(np.array([2, 3, 1, 2, 7, 8, 9], "<i4").tobytes())
    assert [(r.qid, r.vec_id) for r in binary.read_range_truth(spark, str(tmp_path / "t")).collect()] == [(0, 7), (1, 8), (1, 9)]
    (tmp_path / "k").write_bytes(np.array([1, 2, 5, 6], "<u4").tobytes() + np.array([0.5, 1.5], "<f4").tobytes())
    assert [tuple(r) for r in binary.read_knn_truth(spark, str(tmp_path / "k")).collect()] == [(0, 1, 5, 0.5), (0, 2, 6, 1.5)]
    answer = spark.createDataFrame([(0, 1, 5, 0.5), (0, 2, 6, 1.5)], "qid long, rank long, vec_id long, score double")
    assert binary.pack_answer(answer, 2) == (tmp_path / "k").read_bytes()
    binary.write_text_answer(answer, str(tmp_path / "a"))
    assert sorted(tuple(r) for r in binary.read_text_answer(spark, str(tmp_path / "a")).collect()) == [(0, 1, 0.5, 5), (0, 2, 1.5, 6)]
    many = [(q, r, q * 100 + r, q + r / 8) for q in range(30) for r in range(1, 4)]
    binary.write_text_answer(spark.createDataFrame(many, "qid long, rank long, vec_id long, score double").repartition(5), str(tmp_path / "b"))
    assert sorted((r.qid, r.rank, r.vec_id, r.score) for r in binary.read_text_answer(spark, str(tmp_path / "b")).collect()) == many


def test_ids_are_unique_in_a_folder_of_vector_files(spark, tmp_path):
    for k, n in enumerate((3, 5, 2)):
        (tmp_path / f"p{k}.fbin").write_bytes(np.array([n, 2], "<u4").tobytes() + np.full((n, 2), k, "<f4").tobytes())
    rows = binary.read_vectors(spark, str(tmp_path), "fbin").orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(10)) and [r.embedding[0] for r in rows] == [0.0] * 3 + [1.0] * 5 + [2.0] * 2


def test_a_stream_of_queries(spark, x, tmp_path):
    v, c = table(spark, x), table(spark, x[:4], "cid", "c")
    table(spark, x[:5], "qid", "qv").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("qid long, qv array<double>").parquet(str(tmp_path / "q"))
    got = []
    run = stream_knn(stream, search.assign(v, c), c, 3, 4, lambda df, n: got.extend((r.qid, r.vec_id) for r in df.collect()), str(tmp_path / "c"))
    run.processAllAvailable()
    run.stop()
    assert set(got) == brute(x[:5], x, 3)


def test_frontier(spark):
    points = spark.createDataFrame([(1, 0.3), (2, 0.2), (3, 0.5), (3, 0.4)], "cost int, gain double")
    assert {tuple(r) for r in evaluate.frontier(points, "cost", "gain").collect()} == {(1, 0.3), (3, 0.5)}


def test_recall_by_distance_counts_ties(spark):
    truth = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0)], "qid long, vec_id long, score double")
    answer = spark.createDataFrame([(0, 1, 1.0), (0, 9, 2.0)], "qid long, vec_id long, score double")
    assert tuple(evaluate.recall_by_distance(answer, truth).first()) == (0, 2, 2)
    assert math.isclose(evaluate.recall(answer, truth).first().recall, 0.5)


def executed(df):
    """The plan as it ran, after a run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_probes_are_not_broadcast(spark, x, monkeypatch):
    """Spark sizes pairs of a query and a cell by the cells alone; there is no bound on how many they are."""
    v, c, q = table(spark, x), table(spark, x[:6], "cid", "c"), table(spark, x[:30], "qid", "qv")
    found = lambda: search.ivf_knn(q, search.assign(v, c), c, 5, 4)
    want = pairs(found())
    monkeypatch.setattr(search, "SENT_PROBES", 10)
    assert pairs(found()) == want
    plan = executed(found())
    assert "FlatMapCoGroupsInArrow" in plan
    probes = [line for line in plan.splitlines() if "BroadcastExchange" in line and "qid" in line]
    assert not probes and plan.count("BroadcastHashJoin [qid") == 0


@pytest.mark.parametrize("bytes_", [8 << 20, 400])
def test_rounds_of_queries_give_the_k_best_with_ties_by_id(spark, monkeypatch, bytes_):
    g = np.random.default_rng(21)
    x = g.integers(0, 3, (400, 3)).astype(float)  # copies and ties everywhere; integers, so that scores are exact
    q, v = table(spark, x[:40], "qid", "qv"), table(spark, x).repartition(3)
    monkeypatch.setattr(search, "SENT", 4)
    monkeypatch.setattr(search, "SENT_BYTES", bytes_)
    monkeypatch.setattr(search, "TILE", 40 * 9)
    for name, d, sign in (("l2", ((x[:40, None] - x) ** 2).sum(axis=2), 1), ("ip", x[:40] @ x.T, -1)):
        for k in (7, 500):
            order = np.lexsort((np.broadcast_to(np.arange(400), d.shape), sign * d), axis=1)[:, :k]
            want = {(i, n + 1, int(j), d[i, j]) for i in range(40) for n, j in enumerate(order[i])}
            assert {tuple(r) for r in search.knn(q, v, k, name).collect()} == want


@pytest.mark.parametrize("name", ["l2", "ip", "manhattan"])
@pytest.mark.parametrize("bound", ["SENT", "SENT_PROBES"])
def test_a_range_with_many_pairs_shuffles_none_of_them(spark, monkeypatch, name, bound):
    """Over cells that hold much of what is asked, and some that hold nothing; both ways past what is sent along."""
    g = np.random.default_rng(22)
    x = np.concatenate([g.standard_normal((300, 5)), g.standard_normal((100, 5)) * 0.2 + 8])
    d = {"l2": ((x[::10, None] - x) ** 2).sum(axis=2), "ip": x[::10] @ x.T, "manhattan": np.abs(x[::10, None] - x).sum(axis=2)}[name]
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[::10])], "qid long, qv array<double>")
    c = table(spark, x[::20], "cid", "c")
    members = search.assign(table(spark, x), c).repartition(3)
    monkeypatch.setattr(search, bound, 10)
    monkeypatch.setattr(search, "SENT_BYTES", 1000)
    monkeypatch.setattr(search, "TILE", 40 * 9)
    for share in (0.02, 0.4):
        radius = float(np.quantile(d, 1 - share if name == "ip" else share))
        want = set(zip(*[a.tolist() for a in np.nonzero(d > radius if name == "ip" else d < radius)], strict=True))
        found = search.range_pruned(q, members, c, radius, metric=name)
        assert want and pairs(found) == want
        assert "Join" not in executed(found) and "CoGroup" not in executed(found)
