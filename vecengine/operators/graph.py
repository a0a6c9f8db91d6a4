"""Neighbour graphs: edges by cells, descent across cells, pruning, symmetry, integrity, radius expansion, beam search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, discard, stored
from .quantize import decoded, nearest_codes
from .search import SCORED, _cells, matrix, ranked


def knn_graph(members: DataFrame, degree: int) -> DataFrame:
    """``(src, dst, dist)``: each row's nearest others in its own cell (``cid``), ``degree`` of them."""
    queries = members.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    probes = members.select(F.col("vec_id").alias("qid"), "cid")
    found = _cells(probes, queries, members, "l2", degree + 1, None).where("qid <> vec_id")
    return ranked(found.drop("cid"), degree).select(F.col("qid").alias("src"), F.col("vec_id").alias("dst"), F.col("score").alias("dist"))


#: Rows of a group that first neighbours are drawn from, and lists whose pairs are compared at once.
DRAWN, LISTS = 32, 128

_LISTS = "array<struct<node:bigint,fresh:boolean,worst:double,v:array<double>>>"


def _first_edges(rows: DataFrame, degree: int, seed: int, draws: int) -> DataFrame:
    """Edges to the nearest of some DRAWN others, which hashes choose, ``draws`` times."""
    groups = max(1, -(-rows.count() // DRAWN))
    parts = [knn_graph(rows.withColumn("cid", F.pmod(F.xxhash64(F.lit(seed + i), "vec_id"), F.lit(groups))), degree) for i in range(draws)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _best_edges(edges: DataFrame, degree: int) -> DataFrame:
    """Each node's ``degree`` nearest of ``(src, dst, dist, fresh)``; an edge that was there before is not fresh."""
    once = edges.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.bool_and("fresh").alias("fresh"))
    at = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return once.withColumn("at", at).where(F.col("at") <= degree).drop("at")


def _closer(batches):
    """Of each list ``(u, list)`` the pairs, one of them fresh, that are closer than one's worst neighbour; a row of counts a batch (src null)."""
    for batch in batches:
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        order = np.argsort(sizes, kind="stable")
        compared = 0
        for a in range(0, len(order), LISTS):
            some = order[a : a + LISTS]  # lists of about one length
            part = lists.take(pa.array(some))
            flat, n = part.flatten(), sizes[some]
            node, fresh, worst, v = flat.field(0).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False), flat.field(2).to_numpy(), matrix(flat.field(3))
            if not len(node):
                continue
            at = np.full((len(some), n.max()), -1)
            at[np.arange(n.max()) < n[:, None]] = np.arange(len(node))
            x = v[at]
            norm = (x * x).sum(axis=2)
            d = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * (x @ x.transpose(0, 2, 1)), 0.0)
            real = (at[:, :, None] >= 0) & (at[:, None, :] >= 0) & (node[at][:, :, None] != node[at][:, None, :])
            real &= fresh[at][:, :, None] | fresh[at][:, None, :]
            compared += int(real.sum()) // 2
            l, i, j = np.nonzero(real & (d < worst[at][:, :, None]))  # noqa: E741
            yield pa.RecordBatch.from_arrays([pa.array(node[at[l, i]]), pa.array(node[at[l, j]]), pa.array(d[l, i, j])], ["src", "dst", "dist"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([compared]), pa.array([0.0])], ["src", "dst", "dist"])


def descent(vectors: DataFrame, degree: int, start: DataFrame | None = None, width: int | None = None, rounds: int = 12, stop: float = 0.01, seed: int = 1234, told: list | None = None) -> DataFrame:
    """``(src, dst, dist)``: about each row's ``degree`` nearest others, wherever they are, by neighbour descent.

    From first edges (``start``, and some that hashes draw) each round compares with one another
    the ends of each node's edges and the nodes with an edge to it (``width`` of those, chosen by a
    hash), unless neither is new to the list; a node keeps the ``width`` nearest that it has met.
    So work is in proportion to the rows.  Rounds end when fewer than ``stop`` of the edges changed.
    A list has at most twice ``width`` vectors, whatever the data; a node that many have an edge to
    is in as many lists, which are many tasks.  Vectors and ids that are null are left out, and a
    row's distance from a copy of it is zero.  ``told`` gets each round's ``(compared, changed)``.
    """
    width = width or max(24, 3 * degree)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").where("vec_id IS NOT NULL AND v IS NOT NULL")
    first = _first_edges(rows, width, seed, 1 if start is not None else 2)
    if start is not None:
        first = first.unionByName(start.select("src", "dst", "dist"))
    edges = stored(_best_edges(first.withColumn("fresh", F.lit(True)), width), "graph-edges")
    total = max(1, edges.count())
    for nth in range(rounds):
        worst = edges.groupBy(F.col("src").alias("vec_id")).agg(F.when(F.count("*") >= width, F.max("dist")).otherwise(F.lit(float("inf"))).alias("worst"))
        known = rows.join(worst, "vec_id", "left").select(F.col("vec_id").alias("node"), F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "v")
        by_hash = Window.partitionBy("u").orderBy(F.xxhash64(F.lit(seed + nth), "node"))
        back = edges.select(F.col("dst").alias("u"), F.col("src").alias("node"), "fresh").withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= width).drop("at")
        lists = edges.select(F.col("src").alias("u"), F.col("dst").alias("node"), "fresh").unionByName(back)
        lists = lists.groupBy("u", "node").agg(F.bool_or("fresh").alias("fresh")).join(known, "node")
        lists = lists.groupBy("u").agg(F.collect_list(F.struct("node", "fresh", "worst", "v")).cast(_LISTS).alias("list")).where(F.exists("list", lambda x: x["fresh"]))
        met = stored(lists.mapInArrow(_closer, "src long, dst long, dist double"), "graph-met")
        now = edges.withColumn("fresh", F.lit(False)).unionByName(met.where("src IS NOT NULL").withColumn("fresh", F.lit(True)))
        before, edges = edges, stored(_best_edges(now, width), "graph-edges")
        changed = edges.where("fresh").count()
        if told is not None:
            told.append((met.where("src IS NULL").agg(F.sum("dst")).first()[0] or 0, changed))
        discard(before, met)
        if changed <= stop * total:
            break
    return _best_edges(edges, degree).select("src", "dst", "dist")


def symmetrize(edges: DataFrame, most: int) -> DataFrame:
    """Edges both ways, each node with the ``most`` nearest of its own; equal distances by id."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist"))
    once = both.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    at = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return once.withColumn("at", at).where(F.col("at") <= most).drop("at")


def diverse(edges: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """Edges of each node without those whose end is closer to a nearer kept end than to the node."""
    ends = edges.join(vectors.select(F.col("vec_id").alias("dst"), "v"), "dst")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("dist", "ascending"), ("dst", "ascending")])
        x, d, kept = matrix(table["v"]), table["dist"].to_numpy(), []
        for i in range(table.num_rows):
            if len(kept) < most and all(((x[i] - x[j]) ** 2).sum() >= d[i] for j in kept):
                kept.append(i)
        return table.select(["src", "dst", "dist"]).take(pa.array(kept, pa.int64()))

    # a group is one node's edges, bounded by the degree
    return ends.select("src", "dst", "dist", "v").groupBy("src").applyInArrow(run, "src long, dst long, dist double")


def integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of counts: edges, self loops, repeated edges, ends without a node, nodes without an edge in."""
    ids = nodes.select(F.col("vec_id").alias("dst"))
    loops = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    repeated = edges.groupBy("src", "dst").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("repeated"))
    dangling = edges.join(ids, "dst", "left_anti").agg(F.count("*").alias("dangling"))
    orphans = ids.join(edges.select("dst").distinct(), "dst", "left_anti").agg(F.count("*").alias("no_edge_in"))
    # four tables of one row each
    return loops.join(repeated, F.lit(True)).join(dangling, F.lit(True)).join(orphans, F.lit(True))


def radius_expand(seeds: DataFrame, edges: DataFrame, vectors: DataFrame, queries: DataFrame, radius: float, rounds: int = 50) -> DataFrame:
    """``(qid, vec_id, score)``: nodes within ``radius`` that are reachable from the seeds over such nodes.

    ``seeds`` is ``(qid, vec_id)``.  Each round joins the frontier with the edges and leaves out
    what was seen; state is checkpointed, so the plan stays short.
    """
    from ..functions.vectors import l2_sq

    checkpoint_dir(edges.sparkSession)

    def near(pairs: DataFrame) -> DataFrame:
        scored = pairs.join(queries.select("qid", "qv"), "qid").join(vectors.select("vec_id", "v"), "vec_id")
        return scored.select("qid", "vec_id", l2_sq(F.col("qv"), F.col("v")).alias("score")).where(F.col("score") < radius)

    found = near(seeds.select("qid", "vec_id").distinct()).checkpoint()
    frontier = found
    for _ in range(rounds):
        step = frontier.select("qid", F.col("vec_id").alias("src")).join(edges.select("src", "dst"), "src").select("qid", F.col("dst").alias("vec_id")).distinct()
        frontier = near(step.join(found.select("qid", "vec_id"), ["qid", "vec_id"], "left_anti")).checkpoint()
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier).checkpoint()
    raise RuntimeError(f"no end after {rounds} rounds")


#: Nodes of a part whose edges are followed at once, and those of a part's levels: one in so many.
EXPANDED, LEVEL = 4, 16
#: Queries of a part that one task searches; found nodes whose edges out of the part are handed over.
ASKED, HANDED = 1024, 8

WALKED = "qid long, vec_id long, score double, part long, scored long"


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(cid, vec_id, v, links, parts)``: each node of ``nodes`` with the ends of its edges, and the part ``cid`` of each end."""
    ends = edges.select("src", "dst").join(nodes.select(F.col("vec_id").alias("dst"), F.col("cid").alias("part")), "dst")
    links = ends.groupBy(F.col("src").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("dst", "part"))).alias("x"))  # as many as its degree
    none = F.array().cast("array<long>")
    told = nodes.select("cid", "vec_id", "v").join(links, "vec_id", "left")
    return told.select("cid", "vec_id", "v", F.coalesce(F.transform("x", lambda e: e["dst"].cast("long")), none).alias("links"), F.coalesce(F.transform("x", lambda e: e["part"].cast("long")), none).alias("parts"))


def _walk(q: np.ndarray, x: np.ndarray, ends: np.ndarray, upper: np.ndarray, entries: tuple[np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distances of the nodes that each query has met (others are infinite), and whether their edges were followed.

    ``ends`` has a row a node, filled up with -1.  A query enters at the nodes of ``entries`` (its number and a
    node's), or without any at the nearest of the nodes of the ``upper`` level, and then follows the edges of the
    nearest nodes that it has met, for all queries at once, until none of its ``width`` nearest is left to follow.
    """
    dist, done = np.full((len(q), len(x)), np.inf), np.zeros((len(q), len(x)), bool)

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        new = np.isinf(dist[i, j])
        i, j = i[new], j[new]
        dist[i, j] = ((x[j] - q[i]) ** 2).sum(axis=1)

    meet(*entries)
    lost = np.flatnonzero(np.isinf(dist).all(axis=1))
    meet(np.repeat(lost, len(upper)), np.tile(upper, len(lost)))
    live = np.arange(len(q))
    while len(live):
        d = dist[live]
        edge = np.partition(d, width - 1, axis=1)[:, width - 1] if d.shape[1] > width else np.full(len(live), np.inf)
        d[done[live]] = np.inf
        step = min(EXPANDED, d.shape[1])
        best = np.argpartition(d, step - 1, axis=1)[:, :step]
        good = np.take_along_axis(d, best, axis=1)
        good = (good <= edge[:, None]) & np.isfinite(good)
        i, k = np.nonzero(good)
        i, j = live[i], best[i, k]
        done[i, j] = True
        to = ends[j]
        at, k = np.nonzero(to >= 0)
        pairs = np.unique(np.stack([i[at], to[at, k]]), axis=1)
        meet(pairs[0], pairs[1])
        live = live[good.any(axis=1)]
    return dist, done


def walk(starts: DataFrame, queries: DataFrame, graph: DataFrame, width: int, book: np.ndarray | None = None) -> DataFrame:
    """One round in the parts that each query starts in, as rows of WALKED.

    ``starts`` is ``(qid, cid, vec_id)``: a part and a node of it to enter at (null: the part's
    upper level, one in LEVEL of its nodes, chosen by a hash).  ``graph`` is that of :func:`adjacency`, in
    parts of bounded size.  A part is searched in one task by up to ASKED queries, so a part that all
    queries start in is many tasks.  Rows with a score are nodes found (``width`` a query and part);
    rows with a part hand a query over to a node there that an edge leads to; rows with ``scored``
    tell how many distances a query took.  With ``book`` the nodes' ``v`` are codes of that codebook, queries
    are put into codes too, and distances are those between codes.
    """
    coded = starts.sparkSession.sparkContext.broadcast(book) if book is not None else None
    s = starts.select("qid", F.col("cid").alias("of"), "vec_id").join(queries.select("qid", "qv"), "qid")
    count = s.groupBy("of").agg(F.ceil(F.count_distinct("qid") / ASKED).cast("int").alias("nb"))
    asked = s.join(count, "of").select("of", F.pmod(F.xxhash64("qid"), "nb").cast("int").alias("b"), F.col("qid").cast("long").alias("qid"), "qv", F.col("vec_id").cast("long").alias("vec_id"))
    held = graph.join(count.select(F.col("of").alias("cid"), "nb"), "cid").select("cid", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("nth"), "vec_id", "v", "links", "parts")

    def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]

        def put(qid, vec_id, score, part, scored) -> None:
            for to, c in zip(out, (qid, vec_id, score, part, scored), strict=True):
                to.append(pa.array(c, from_pandas=True) if c is not None else pa.nulls(len(qid)))

        if nodes.num_rows and asked.num_rows:
            nodes = nodes.sort_by("vec_id")
            ids, x = nodes["vec_id"].to_numpy(), matrix(nodes["v"])
            links = nodes["links"].combine_chunks()
            dst, sizes, parts = links.flatten().to_numpy(), np.diff(links.offsets.to_numpy()), nodes["parts"].combine_chunks().flatten().to_numpy()
            src, column = np.repeat(np.arange(len(ids)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else np.zeros(0, int)
            place = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
            inside = ids[place] == dst
            ends = np.full((len(ids), max(1, sizes.max(initial=0))), -1)
            ends[src[inside], column[inside]] = place[inside]
            mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # a fixed odd constant
            upper = np.argsort(mixed, kind="stable")[: max(8, len(ids) // LEVEL)]
            qids, first, of = np.unique(asked["qid"].to_numpy(), return_index=True, return_inverse=True)
            q = matrix(asked["qv"])[first]
            if coded is not None:
                x, q = decoded(x, coded.value), decoded(nearest_codes(q, coded.value), coded.value)
            given = asked["vec_id"].combine_chunks()
            has = given.is_valid().to_numpy(zero_copy_only=False)
            nth = np.minimum(np.searchsorted(ids, given.fill_null(0).to_numpy()), len(ids) - 1)
            has &= ids[nth] == given.fill_null(-1).to_numpy()
            dist, done = _walk(q, x, ends, upper, (of[has], nth[has]), width)
            best = np.argsort(dist, axis=1, kind="stable")[:, :width]
            d = np.take_along_axis(dist, best, axis=1)
            i, k = np.nonzero(np.isfinite(d))
            put(qids[i], ids[best[i, k]], d[i, k], None, None)
            put(qids, None, None, None, np.isfinite(dist).sum(axis=1))
            # edges out of the part from the nearest nodes
            outside = np.flatnonzero(~inside)
            from_, to = np.searchsorted(src[outside], np.arange(len(ids))), np.searchsorted(src[outside], np.arange(len(ids)), side="right")
            i, k = np.nonzero(np.isfinite(d[:, :HANDED]))
            j = best[i, k]
            n = to[j] - from_[j]
            e = outside[np.repeat(from_[j] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] if n.sum() else np.zeros(0, int)
            put(np.repeat(qids[i], n), dst[e], None, parts[e], None)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table({f.split()[0]: pa.chunked_array([c.cast(k) for c in cs], k) for f, cs, k in zip(WALKED.split(", "), out, kinds, strict=True)})

    return held.groupBy("cid", "nth").cogroup(asked.groupBy("of", "b")).applyInArrow(run, WALKED)


def beam_knn(starts: DataFrame, queries: DataFrame, graph: DataFrame, k: int, width: int, hops: int = 1, parts: int = 4, told: list | None = None, book: np.ndarray | None = None) -> DataFrame:
    """``(qid, rank, vec_id, score)``: approximate k nearest nodes by best-first search from where each query starts.

    After a round in the parts of ``starts`` (``(qid, cid)``, with ``vec_id`` a node to enter at) a
    query goes on, ``hops`` times, in up to ``parts`` other parts: those that most edges of its nearest
    nodes lead to, entered at those edges' ends.  ``told`` gets each round's ``(query-part pairs, distances)``.
    """
    starts = starts.withColumn("vec_id", F.lit(None).cast("long")) if "vec_id" not in starts.columns else starts
    starts = stored(starts.select("qid", "cid", "vec_id").distinct(), "graph-starts")
    been, found = starts.select("qid", "cid").distinct(), None
    for hop in range(hops + 1):
        met = stored(walk(starts, queries, graph, max(width, k), book), "graph-walk")
        if told is not None:
            told.append(tuple(met.where("scored IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum("scored"), F.lit(0))).first()))
        nodes = met.where("score IS NOT NULL").select("qid", "vec_id", "score")
        found = nodes if found is None else found.unionByName(nodes)
        if hop == hops:
            break
        out = met.where("part IS NOT NULL").select("qid", F.col("part").alias("cid"), "vec_id").join(been, ["qid", "cid"], "left_anti")
        at = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "cid"))
        chosen = out.groupBy("qid", "cid").agg(F.count("*").alias("n")).withColumn("at", at).where(F.col("at") <= parts).select("qid", "cid")
        starts = stored(out.join(chosen, ["qid", "cid"]).distinct(), "graph-starts")
        been = been.unionByName(chosen)
    return ranked(found.dropDuplicates(["qid", "vec_id"]), k)
