"""Clustering: sampling, Lloyd rounds, merging, balanced splits and packing into blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import metric as metric_of
from ..session import stored
from .search import TILE, assign, matrix, scores

#: Groups of at most so many rows are cut into blocks in one task; larger ones are split into so many parts at most first.
SPLIT_ROWS, MOST_PARTS = 20_000, 512
#: Rows that seeding takes before it cuts them down.
CANDIDATES = 65_536


def hash_sample(df: DataFrame, n: int, seed: int = 1234, key: str = "vec_id") -> DataFrame:
    """``n`` rows by order of a seeded MD5 of the key's digits: the same rows whatever the partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def sample_size(n: int, k: int, rate: float = 0.01) -> int:
    """Rows to train ``k`` clusters on: the rate, but at least 39 a cluster where there are as many."""
    if n < k:
        raise ValueError(f"{n} rows for {k} clusters")
    return max(int(rate * n), min(n, 39 * k))


def kmeanspp(x: np.ndarray, k: int, seed: int = 1234, weights: np.ndarray | None = None) -> np.ndarray:
    """Indices of ``k`` rows of a bounded sample, each drawn by its squared distance to those before (times its weight)."""
    g = np.random.default_rng(seed)
    w = np.ones(len(x)) if weights is None else weights
    picked = [int(g.integers(len(x)) if weights is None else g.choice(len(x), p=w / w.sum()))]
    d = ((x - x[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < min(k, len(x)):
        odds = d * w
        total = odds.sum()
        new = int(g.choice(len(x), p=odds / total)) if total > 0 else next(i for i in range(len(x)) if i not in picked)
        picked.append(new)
        d = np.minimum(d, ((x - x[new]) ** 2).sum(axis=1))
    return np.array(picked)


def seeds(vectors: DataFrame, k: int, seed: int = 1234, rounds: int = 5) -> DataFrame:
    """``(cid, vec_id, c)``: ``k`` rows to start from, numbered from 0, by rounds of oversampling over all rows.

    From one row that a hash chooses, each round takes about ``2 k`` more, each row by a hash that falls
    below its share of the total squared distance to those taken; all of it is on the executors.  The rows
    taken (CANDIDATES at most, about) are weighted by how many rows are nearest to each, and they alone are
    cut down to ``k`` on the driver, by the same draws in sequence.  Where rounds take fewer than
    ``k`` rows, rows by order of a hash fill up; fewer rows than ``k`` are all of them.
    """
    if not 1 <= k <= CANDIDATES:
        raise ValueError(f"1 to {CANDIDATES} clusters are wanted")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    by_hash = lambda i: F.xxhash64(F.lit(seed + i), "vec_id")
    taken = stored(rows.orderBy(by_hash(0), "vec_id").limit(1), "seeds")
    wanted = min(2 * k, (CANDIDATES - 1) // rounds)
    for nth in range(1, rounds + 1):
        if taken.isEmpty():
            break
        near = assign(rows, taken.select(F.col("vec_id").alias("cid"), F.col("v").alias("c")))
        total = near.agg(F.sum("dist")).first()[0]
        if not total > 0:
            break
        share = F.pmod(by_hash(nth), F.lit(1 << 53)) / float(1 << 53)
        new = near.where(share < F.col("dist") * (wanted / total)).select("vec_id", "v")
        taken = stored(taken.unionByName(new).dropDuplicates(["vec_id"]), "seeds")
    if taken.count() < k:
        taken = stored(taken.unionByName(rows.orderBy(by_hash(0), "vec_id").limit(2 * k)).dropDuplicates(["vec_id"]), "seeds")
    weights = assign(rows, taken.select(F.col("vec_id").alias("cid"), F.col("v").alias("c"))).groupBy("cid").agg(F.count("*").alias("n"))
    weighed = taken.join(weights, taken["vec_id"] == weights["cid"], "left").select("vec_id", "v", F.coalesce("n", F.lit(0)).alias("n"))
    table = weighed.orderBy("vec_id").toArrow()  # CANDIDATES rows, about
    if not table.num_rows:
        return vectors.sparkSession.createDataFrame([], "cid long, vec_id long, c array<double>")
    x, n, ids = matrix(table["v"]), table["n"].to_numpy().astype(np.float64), table["vec_id"].to_pylist()
    chosen = kmeanspp(x, k, seed, n + 1e-9)
    return vectors.sparkSession.createDataFrame([(i, ids[j], x[j].tolist()) for i, j in enumerate(chosen.tolist())], "cid long, vec_id long, c array<double>")


def centroids(assigned: DataFrame, length: float | None = None) -> DataFrame:
    """``(cid, c, n)``: each cluster's mean, or with ``length`` its sum scaled to that length.

    A sum of zero length falls back to the mean.  Sums are made by dimension, in part before the
    shuffle.
    """
    dims = assigned.select("cid", F.posexplode("v").alias("i", "x")).groupBy("cid", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    rows = dims.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("a"), F.max("n").alias("n"))
    sums = rows.select("cid", "n", F.transform("a", lambda y: y["s"]).alias("s"))
    mean = F.transform("s", lambda y: y / F.col("n"))
    if length is None:
        return sums.select("cid", mean.alias("c"), "n")
    size = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, y: a + y * y))
    return sums.withColumn("size", size).select("cid", F.when(F.col("size") > 0, F.transform("s", lambda y: y * F.lit(length) / F.col("size"))).otherwise(mean).alias("c"), "n")


def mean_norm(vectors: DataFrame) -> float:
    return vectors.agg(F.avg(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y)))).first()[0]


def lloyd(vectors: DataFrame, start: DataFrame, rounds: int, length: float | None = None, stop: float | None = None, repair: bool = False) -> DataFrame:
    """Centroids after ``rounds`` rounds from ``start``; only they, a bounded sample, go through the driver.

    With ``stop`` the rounds end once the total distance shrinks by a smaller share of itself.  An
    empty cluster is dropped, or with ``repair`` gets half of the largest: both get its centroid,
    moved a little to either side.
    """
    spark, now = vectors.sparkSession, start.select(F.col("cid").cast("long").alias("cid"), "c")
    wanted, before = [r.cid for r in now.select("cid").orderBy("cid").collect()] if repair else [], None
    for _ in range(rounds):
        assigned = assign(vectors, now)
        if stop is not None:
            assigned = assigned.persist()
            total = assigned.agg(F.sum("dist")).first()[0] or 0.0
        rows = [(r.cid, r.c, r.n) for r in centroids(assigned, length).select("cid", "c", "n").collect()]
        if stop is not None:
            assigned.unpersist()
        for cid in sorted(set(wanted) - {r[0] for r in rows}):
            at = max(range(len(rows)), key=lambda i: (rows[i][2], -rows[i][0]))
            donor, c, n = rows[at]
            if n < 2:
                break
            rows[at] = (donor, [x * (1 + (-1) ** i / 1024) for i, x in enumerate(c)], n - n // 2)
            rows.append((cid, [x * (1 - (-1) ** i / 1024) for i, x in enumerate(c)], n // 2))
        now = spark.createDataFrame([r[:2] for r in sorted(rows)], "cid long, c array<double>")
        if stop is not None:
            if before is not None and before - total <= stop * before:
                break
            before = total
    return now


def dissolve(assigned: DataFrame, cents: DataFrame, least: int) -> DataFrame:
    """``(cid, vec_id, v)`` with clusters below ``least`` rows dissolved into the nearest that remain.

    If none is that large, all rows go to one cluster, the smallest cid.
    """
    sizes = assigned.groupBy("cid").agg(F.count("*").alias("n"))
    large = cents.join(sizes.where(F.col("n") >= least), "cid", "left_semi")
    if large.isEmpty():
        one = sizes.agg(F.min("cid")).first()[0]
        return assigned.select(F.lit(one).cast("long").alias("cid"), "vec_id", "v")
    kept = assigned.join(large.select("cid"), "cid", "left_semi").select("cid", "vec_id", "v")
    loose = assigned.join(large.select("cid"), "cid", "left_anti").select("vec_id", "v")
    return kept.unionByName(assign(loose, large).select("cid", "vec_id", "v"))


def merge_small(assigned: DataFrame, cents: DataFrame, least: int) -> DataFrame:
    """``(vec_id, cid)`` of :func:`dissolve`."""
    return dissolve(assigned, cents, least).select("vec_id", "cid")


def balanced(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1234) -> np.ndarray:
    """Clusters of one bounded group whose sizes differ by at most one.

    Rows are placed in order of how much they lose if their best cluster is full; then pairs of
    rows whose exchange shortens the total distance are swapped.
    """
    n = len(x)
    k = min(k, n)
    cents = x[kmeanspp(x, k, seed)]
    room = np.full(k, n // k)
    room[: n % k] += 1
    label = np.full(n, -1)
    for _ in range(rounds):
        d = scores(x, cents, "l2")
        left, new = room.copy(), np.full(n, -1)
        open_ = np.arange(n)
        while len(open_):
            free = left > 0
            own = np.where(free, d[open_], np.inf)
            best = own.argmin(axis=1)
            worst = np.where(free, d[open_], -np.inf).max(axis=1)
            order = np.lexsort((open_, own[np.arange(len(open_)), best] - worst))
            spilled = []
            for i in order:
                c = best[i]
                if left[c] > 0:
                    left[c] -= 1
                    new[open_[i]] = c
                else:
                    spilled.append(open_[i])
            open_ = np.array(spilled, np.int64)
        for a in range(k):
            for b in range(a + 1, k):
                ia, ib = np.flatnonzero(new == a), np.flatnonzero(new == b)
                ga, gb = np.sort(d[ia, a] - d[ia, b])[::-1], np.sort(d[ib, b] - d[ib, a])[::-1]
                m = min(len(ga), len(gb))
                swaps = int((ga[:m] + gb[:m] > 1e-12).sum())
                if swaps:
                    oa, ob = ia[np.argsort(d[ia, b] - d[ia, a], kind="stable")[:swaps]], ib[np.argsort(d[ib, a] - d[ib, b], kind="stable")[:swaps]]
                    new[oa], new[ob] = b, a
        same, label = (new == label).all(), new
        if same:
            break
        cents = np.stack([x[label == c].mean(axis=0) for c in range(k)])
    return label


def repair_empty(label: np.ndarray, k: int, seed: int = 1234) -> np.ndarray:
    """Labels of one bounded group in which every cluster has a row, as far as there are rows.

    An empty cluster gets the first half of the rows of one drawn by its size less one.
    """
    label, g = label.copy(), np.random.default_rng(seed)
    for c in range(k):
        sizes = np.bincount(label, minlength=k)
        if sizes[c] == 0 and sizes.max() > 1:
            chance = np.maximum(sizes - 1, 0)
            donor = int(g.choice(k, p=chance / chance.sum()))
            label[np.flatnonzero(label == donor)[: sizes[donor] // 2]] = c
    return label


def assign_penalised(x: np.ndarray, cents: np.ndarray, weight: float) -> np.ndarray:
    """Labels of one bounded group: in row order, the least of distance and ``weight`` times the cluster's size so far."""
    d, sizes, label = scores(x, cents, "l2"), np.zeros(len(cents)), np.empty(len(x), np.int64)
    for i in range(len(x)):
        label[i] = (d[i] + weight * sizes).argmin()
        sizes[label[i]] += 1
    return label


def merge_blocks(x: np.ndarray, label: np.ndarray, capacity: int, least: int) -> np.ndarray:
    """Blocks of one bounded group, each under ``least`` rows put together with the nearest that has room for it.

    The smallest goes first; afterwards a block is under ``least`` rows only if no other one has room.
    """
    _, label = np.unique(label, return_inverse=True)
    sizes, label = np.bincount(label), label.copy()
    sums = np.zeros((len(sizes), x.shape[1]))
    np.add.at(sums, label, x)
    into, stuck = np.arange(len(sizes)), np.zeros(len(sizes), bool)
    while True:
        small = np.flatnonzero((sizes > 0) & (sizes < least) & ~stuck)
        if not len(small):
            break
        a = small[sizes[small].argmin()]
        room = np.flatnonzero((sizes > 0) & (sizes + sizes[a] <= capacity))
        room = room[room != a]
        if not len(room):
            stuck[a] = True  # sizes only grow, so it stays so
            continue
        b = room[((sums[room] / sizes[room, None] - sums[a] / sizes[a]) ** 2).sum(axis=1).argmin()]
        into[into == a] = b
        sizes[b], sums[b], sizes[a] = sizes[b] + sizes[a], sums[b] + sums[a], 0
    return np.unique(into[label], return_inverse=True)[1]


def blocks_of(x: np.ndarray, capacity: int, seed: int = 1234, least: int = 0) -> np.ndarray:
    """Block of each row of one bounded group: split by the square root of what is needed, then evenly; blocks under ``least`` are merged."""
    out, ready, todo = np.zeros(len(x), np.int64), 0, [(np.arange(len(x)), 0)]
    while todo:
        rows, level = todo.pop()
        if len(rows) <= capacity:
            out[rows], ready = ready, ready + 1
            continue
        need = math.ceil(len(rows) / capacity)
        if len(rows) <= 1500 or level >= 3:
            label = balanced(x[rows], need, seed=seed)
        else:
            k = min(500, int(math.isqrt(need)) + 1)
            cents = x[rows][kmeanspp(x[rows], k, seed)]
            k = len(cents)
            for _ in range(5):
                label = repair_empty(scores(x[rows], cents, "l2").argmin(axis=1), k, seed)
                cents = np.stack([x[rows][label == c].mean(axis=0) for c in range(k)])
        parts = [rows[label == c] for c in np.unique(label)]
        todo += [(p, level + 1) for p in parts[::-1]] if len(parts) > 1 else [(h, 3) for h in np.array_split(rows, need)]
    return merge_blocks(x, out, capacity, least) if least and len(x) else out


def _sub_centroids(large: DataFrame, seed: int) -> DataFrame:
    """``(cid, part, subs)``: of each large group the centroids that split it, from a sample of bounded size."""
    few = large.where(F.expr(f"pmod(xxhash64({seed}, vec_id), greatest(1, n div {SPLIT_ROWS})) = 0"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").slice(0, 2 * SPLIT_ROWS)  # about SPLIT_ROWS rows; more only by chance
        x = matrix(table["v"])
        k = min(MOST_PARTS, len(x), 2 * math.ceil(table["n"][0].as_py() / SPLIT_ROWS))
        cents = x[kmeanspp(x, k, seed)]
        for _ in range(5):
            label = repair_empty(np.concatenate([scores(x[a : a + 4096], cents, "l2").argmin(axis=1) for a in range(0, len(x), 4096)]), len(cents), seed)
            cents = np.stack([x[label == c].mean(axis=0) for c in range(len(cents))])
        lists = pa.array([c.tolist() for c in cents], pa.list_(pa.float64()))
        return pa.table({"cid": pa.array([table["cid"][0].as_py()] * len(cents)), "part": pa.array([table["part"][0].as_py()] * len(cents)), "sub": pa.array(range(len(cents)), pa.int64()), "c": lists})

    return few.select("cid", "part", "n", "vec_id", "v").groupBy("cid", "part").applyInArrow(run, "cid long, part long, sub long, c array<double>")


def _nearest_parts(large: DataFrame, subs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``(cid, part, vec_id, v)``: each row in the nearest of its group's parts.

    A group has one centroid for every SPLIT_ROWS / 2 of its rows, so their number is a fixed small
    share of the rows'; it is checked before they are sent to the tasks.
    """
    table = subs.orderBy("cid", "part", "sub").limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"more than {most} parts: cluster in more clusters first")
    subs, groups = table["sub"].to_numpy(), {}
    for i, key in enumerate(zip(table["cid"].to_pylist(), table["part"].to_pylist(), strict=True)):
        groups.setdefault(key, []).append(i)
    held = large.sparkSession.sparkContext.broadcast((groups, subs, matrix(table["c"])))

    def run(batches):
        groups, subs, c = held.value
        for batch in batches:
            cid, part, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(3))
            new = part.copy()
            for key in set(zip(cid.tolist(), part.tolist(), strict=True)):
                rows, own = np.flatnonzero((cid == key[0]) & (part == key[1])), c[groups[key]]
                for at in range(0, len(rows), max(1, TILE // len(own))):
                    some = rows[at : at + max(1, TILE // len(own))]
                    new[some] = key[1] * MOST_PARTS + subs[groups[key]][scores(v[some], own, "l2").argmin(axis=1)] + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new), batch.column(2), batch.column(3)], ["cid", "part", "vec_id", "v"])

    return large.select("cid", "part", "vec_id", "v").mapInArrow(run, "cid long, part long, vec_id long, v array<double>")


def _split(large: DataFrame, seed: int, least: int) -> DataFrame:
    """Each row of the large groups in a part of its group; parts under ``least`` rows are dissolved among the group's others."""
    subs = _sub_centroids(large, seed)
    if not least:
        return _nearest_parts(large, subs)
    subs = stored(subs, "subs")
    first = stored(_nearest_parts(large, subs), "split")
    small = first.groupBy("cid", F.col("part").alias("new")).agg(F.count("*").alias("n")).where(F.col("n") < least)
    # a part's number is that of its group, times MOST_PARTS, and of its centroid; of an only part nothing is left to go to
    own = subs.withColumn("new", F.col("part") * MOST_PARTS + F.col("sub") + 1)
    rest = own.join(small, ["cid", "new"], "left_anti").drop("new")
    some = small.join(own.select("cid", "new", "part"), ["cid", "new"]).join(rest.select("cid", "part").distinct(), ["cid", "part"], "left_semi").select("cid", "new", "part")
    if some.isEmpty():
        return first
    loose = first.withColumnRenamed("part", "new").join(some, ["cid", "new"]).select("cid", "part", "vec_id", "v")
    stay = first.join(some.select("cid", F.col("new").alias("part")), ["cid", "part"], "left_anti")
    return stay.unionByName(_nearest_parts(loose, rest.join(some.select("cid", "part").distinct(), ["cid", "part"], "left_semi")))


def _parts(assigned: DataFrame, seed: int, levels: int = 4, least: int = 0) -> DataFrame:
    """``(cid, part, vec_id, v)``: clusters over SPLIT_ROWS rows split by distance, level by level; parts under ``least`` are merged between levels.

    A group that does not shrink (rows of one place) is dealt out by a hash of the id in the end,
    so a part holds a bounded number of rows whatever the data.
    """
    dealt = assigned.select("cid", F.lit(0).cast("long").alias("part"), "vec_id", "v")
    for level in range(levels):
        sizes = dealt.groupBy("cid", "part").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT_ROWS)
        if sizes.isEmpty():
            return dealt
        sizes = sizes.cache()
        if level == levels - 1:
            break
        large = dealt.join(sizes.select("cid", "part", "n"), ["cid", "part"])
        split = _split(large, seed + level, least)
        dealt = stored(dealt.join(sizes, ["cid", "part"], "left_anti").unionByName(split), "parts")
    again = dealt.join(sizes.select("cid", "part", F.ceil(F.col("n") / SPLIT_ROWS).cast("int").alias("by")), ["cid", "part"], "left")
    hashed = F.col("part") * MOST_PARTS + F.coalesce(F.pmod(F.xxhash64("vec_id"), "by") + 1, F.lit(0))
    return again.select("cid", hashed.alias("part"), "vec_id", "v")


def pack_clusters(assigned: DataFrame, capacity: int, seed: int = 1234, least: int = 0) -> DataFrame:
    """``(cid, block_id, vec_id, v)``: each cluster cut into blocks of at most ``capacity`` close rows.

    A cluster of more than SPLIT_ROWS rows is split by distance first, so a task holds a bounded
    group whatever the cluster's size; parts are numbered within their cluster, and a block's id
    starts with its part.  A part or block under ``least`` rows is merged with near ones of its group that have room.
    """
    dealt = _parts(assigned, seed, least=least)
    known = dealt.select("cid", "part").distinct()
    known = known.withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy("part")).cast("long") - 1)
    dealt = dealt.join(known, ["cid", "part"]).select("cid", F.col("nth").alias("part"), "vec_id", "v")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        block = blocks_of(matrix(table["v"]), capacity, seed, least)
        ids = pa.array(table["part"].to_numpy().astype(np.int64) * (1 << 20) + block)
        return pa.table({"cid": table["cid"], "block_id": ids, "vec_id": table["vec_id"], "v": table["v"]})

    return dealt.groupBy("cid", "part").applyInArrow(run, "cid long, block_id long, vec_id long, v array<double>")


def pack_in_order(assigned: DataFrame, capacity: int) -> DataFrame:
    """``(cid, block_id, slot, vec_id)``: rows of each cluster by distance from its centroid, so many a block.

    The rank in a cluster is that in its range of distances plus the sizes of the ranges before
    it, so that a large cluster is ranked by many tasks.
    """
    parts = 8
    cut = assigned.groupBy("cid").agg(F.percentile_approx("dist", [i / parts for i in range(1, parts)], 1000).alias("cuts"))
    ranged = assigned.join(cut, "cid").withColumn("r", F.size(F.filter("cuts", lambda x: x < F.col("dist"))))
    sizes = ranged.groupBy("cid", "r").agg(F.count("*").alias("n"))
    before = sizes.withColumn("at", F.coalesce(F.sum("n").over(Window.partitionBy("cid").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("cid", "r").orderBy("dist", "vec_id")) - 1 + F.col("at")
    placed = ranged.join(before, ["cid", "r"]).withColumn("rank", rank)
    return placed.select("cid", F.floor(F.col("rank") / capacity).cast("long").alias("block_id"), (F.col("rank") % capacity).cast("long").alias("slot"), "vec_id", "v", "dist")


def capacity(dim: int, block_bytes: int = 4096, component_bytes: int = 4, coded: bool = False) -> int:
    """Rows that a block of so many bytes holds: a count, and a vector (or its codes) and an id a row."""
    n = (block_bytes - 4) // (dim + 4 if coded else dim * component_bytes + 4)
    if n < 1:
        raise ValueError(f"a block of {block_bytes} bytes holds no vector of {dim} components")
    return n


def representatives(packed: DataFrame, cents: DataFrame, m: int, metric: str = "l2") -> DataFrame:
    """``(cid, block_id, rep, vec_id, dist)``: of each block the ``m`` rows that a metric puts farthest from its centroid, 1 the farthest.

    For a likeness those are the least like it.  Scores that agree to nine digits are a tie, and the smaller id comes first.
    """
    score, ascending = metric_of(metric)[:2]
    apart = packed.select("cid", "block_id", "vec_id", "v").join(cents.select("cid", "block_id", "c"), ["cid", "block_id"])
    apart = apart.select("cid", "block_id", "vec_id", score(F.col("v"), F.col("c")).alias("dist"))
    worst = F.round("dist", 9).desc() if ascending else F.round("dist", 9).asc()
    at = F.row_number().over(Window.partitionBy("cid", "block_id").orderBy(worst, "vec_id"))
    return apart.withColumn("rep", at.cast("long")).where(F.col("rep") <= m)


def transposed(rows: DataFrame, tile: int) -> DataFrame:
    """``(block, dim, n, column_values)``: the values of each dimension for ``tile`` ids at a time, by vec_id.

    A vector is shuffled once, with its block, and a block's columns are cut from its rows; no
    column is ever whole in one place.  A component that a shorter vector of the block does not have
    is left out; null and empty vectors have none.
    """
    blocks = rows.where("size(v) > 0").groupBy(F.expr(f"vec_id div {tile}").alias("block"))
    held = blocks.agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("r"))
    cut = held.select("block", F.posexplode(F.expr("transform(sequence(1, array_max(transform(r, x -> size(x.v)))), d -> transform(filter(r, x -> size(x.v) >= d), x -> x.v[d - 1]))")).alias("dim", "column_values"))
    return cut.select("block", "dim", F.size("column_values").cast("long").alias("n"), "column_values")
