"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

Each distinct vector has a home, the cell of its nearest centroid, and is looked up in the PROBES
nearest cells.  In a cell the vectors that look it up meet those at home there, in blocks of a
bounded number of rows each; a block pair is one matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

#: Centroids are fitted on at most SAMPLE distinct vectors, by order of a hash; all are indexed.
SAMPLE, MOST_CELLS, ROUNDS = 20_000, 1_250, 8
#: Cells in which a vector is looked up; rows of a block; least cosine of a link.
PROBES, BLOCK, COSINE = 4, 512, 0.95


def spherical_kmeans(x: np.ndarray, cells: int, seed: int = 3, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; a cell left empty starts anew from a random row."""
    g = np.random.default_rng(seed)
    centroids = x[g.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[at : at + 4096] @ centroids.T).argmax(axis=1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-12
        sums[empty] = x[g.integers(0, len(x), int(empty.sum()))]
        norms[empty] = 1
        centroids = sums / norms[:, None]
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length, in double precision."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(home: pa.Table, probe: pa.Table, cosine: float) -> pa.Table:
    """One block pair: ``(n, links, root)`` for each vector that has a link here.

    The vector that looks the cell up always counts the link; the one at home counts it too,
    unless it looks up the other's home itself and so counts it there.
    """
    out = {"n": [], "links": [], "root": []}
    if home.num_rows and probe.num_rows:
        h, p = _unit(_matrix(home["vec"])), _unit(_matrix(probe["of_vec"]))
        hn, pn = home["n"].to_numpy(), probe["of_n"].to_numpy()
        i, j = np.nonzero((p @ h.T >= cosine) & (pn[:, None] != hn[None, :]))
        if len(i):
            looks = _matrix(home["probes"]).astype(np.int64)
            also = ~(looks[j] == probe["of_home"].to_numpy()[i][:, None]).any(axis=1)
            size = {"h": home["size"].to_numpy(), "p": probe["of_size"].to_numpy()}
            nodes, local = np.unique(np.concatenate([pn[i], hn[j]]), return_inverse=True)
            a, b = local[: len(i)], local[len(i) :]
            links = np.zeros(len(nodes), np.int64)
            np.add.at(links, a, size["h"][j])
            np.add.at(links, b[also], size["p"][i][also])
            root = np.arange(len(nodes))
            while True:
                low = np.minimum(root[a], root[b])
                new = root.copy()
                np.minimum.at(new, a, low)
                np.minimum.at(new, b, low)
                if (new == root).all():
                    break
                root = new
            out = {"n": nodes, "links": links, "root": nodes[root]}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _links(rows: DataFrame, cosine: float, probes: int, seed: int) -> DataFrame:
    """``(vec_id, n_links, component_id)`` of ``(vec_id, vec)``, sound vectors of one length."""
    spark = rows.sparkSession
    keys = [F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2")]
    sound = rows.select("vec_id", "vec", *keys)
    nodes = sound.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.any_value("vec").alias("vec"))
    nodes = stored(nodes.withColumn("n", F.monotonically_increasing_id()), "embedding-nodes")
    count = nodes.count()
    sample = nodes.orderBy("k1", "k2").limit(SAMPLE).select("vec").toArrow()  # bounded by SAMPLE
    x = _unit(_matrix(sample["vec"])) if sample.num_rows else np.zeros((0, 1))
    cells = int(max(1, min(count**0.5, MOST_CELLS, sample.num_rows)))
    held = spark.sparkContext.broadcast(spherical_kmeans(x, cells, seed) if len(x) else x)  # MOST_CELLS rows at most
    width = min(probes, cells)

    def place(batches):
        for batch in batches:
            near = _unit(_matrix(batch.column(3))) @ held.value.T
            looks = np.argsort(-near, axis=1, kind="stable")[:, :width].astype(np.int32)
            ends = pa.array(np.arange(0, looks.size + 1, width, dtype=np.int32))
            columns = [*batch.columns, pa.array(looks[:, 0]), pa.ListArray.from_arrays(ends, pa.array(looks.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "least", "size", "vec", "home", "probes"])

    placed = nodes.select("n", "least", "size", "vec").mapInArrow(place, "n long, least long, size long, vec array<double>, home int, probes array<int>")
    placed = stored(placed.drop("least"), "embedding-cells")
    looked = placed.select("n", "size", "vec", "home", F.explode("probes").alias("cell"))
    # blocks of each cell: one row a cell, MOST_CELLS at most
    at_home = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nh"))
    at_look = placed.select(F.explode("probes").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("np"))
    blocks = F.broadcast(at_home.join(at_look, "cell"))
    mine = lambda k: F.pmod(F.xxhash64("n"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = placed.withColumnRenamed("home", "cell").join(blocks, "cell").select("cell", mine("nh").alias("hb"), every("np").alias("pb"), "n", "size", "vec", "probes")
    right = looked.join(blocks, "cell").select("cell", mine("np").alias("pb"), every("nh").alias("hb"), "n", "size", "vec", "home")
    block = ["cell", "hb", "pb"]
    right = right.toDF(*[f"of_{c}" for c in right.columns])  # a cogroup wants names of its own on either side
    met = left.groupBy(*block).cogroup(right.groupBy(*[f"of_{c}" for c in block])).applyInArrow(lambda a, b: _linked(a, b, cosine), "n long, links long, root long")
    met = stored(met, "embedding-links")
    links = met.groupBy("n").agg(F.sum("links").alias("links"))
    roots = connected_components(met.select(F.col("n").alias("u"), F.col("root").alias("v")))
    told = nodes.select("n", "k1", "k2", "least", "size").join(links, "n", "left").join(roots.select(F.col("node").alias("n"), "root"), "n", "left")
    told = told.select("k1", "k2", "least", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "n").alias("root"))
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(least, "root").select("k1", "k2", "n_links", "component_id")
    return sound.select("vec_id", "k1", "k2").join(told, ["k1", "k2"]).select("vec_id", "n_links", "component_id")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int = PROBES, seed: int = 3
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    n_links counts the other rows found with that cosine or more, component_id is the least id
    reachable over links, and kept tells that it is the row's own.  A vector that is null or zero,
    or holds null or non-finite components, links with nothing; vectors of different lengths have
    no cosine, so each length that several rows have is worked on by itself.  Rows with equal
    vectors are one node and link with each other, repeated rows too; a null id is never the
    least, and of null ids alone the component_id is null.  An empty table gives an empty result.
    Several jobs run while the result is built.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = source.withColumn("sound", F.coalesce(finite, F.lit(False)))
    shared = rows.where("sound").groupBy(F.size("vec").alias("d")).count().where("count > 1").orderBy("d").collect()  # a row a length
    dims = [r.d for r in shared]
    met = F.col("sound") & F.size("vec").isin(dims)
    alone = rows.where(~met).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for d in dims:
        alone = _links(rows.where(F.col("sound") & (F.size("vec") == d)).select("vec_id", "vec"), cosine, probes, seed).union(alone)
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
