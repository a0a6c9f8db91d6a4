"""Connected components by alternating star contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of those. Every ``u`` exceeds its ``v``."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    links = e.join(least, "u")
    up = links.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that an edge touches; root is the least node reachable.

    Nodes are longs.  Self-loops and repeated edges do no harm.  Each round is two joins on a
    node against one row a node, so a hub is a skewed join that can be split, and no neighbour
    list is ever gathered.  The number of rounds grows with the logarithm of a component's size;
    the state of each round is checkpointed in the shared folder.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    mark = _mark(e)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        new = checkpoint(_small_star(_large_star(e)))
        now = _mark(new)
        e, same, mark = new, now == mark, now
        if same:
            break
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
