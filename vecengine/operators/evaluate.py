"""Measures of answers against the truth, and of answer sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.vectors import metric as metric_of
from ..session import stored


def recall(answer: DataFrame, truth: DataFrame) -> DataFrame:
    """``(qid, hits, wanted, recall)``: how many of each query's true ids the answer has."""
    met = truth.select("qid", "vec_id").join(answer.select("qid", "vec_id", F.lit(1).alias("hit")).distinct(), ["qid", "vec_id"], "left")
    told = met.groupBy("qid").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
    return told.withColumn("recall", F.col("hits") / F.col("wanted"))


def recall_by_distance(answer: DataFrame, truth: DataFrame, metric: str = "l2") -> DataFrame:
    """``(qid, hits, wanted)``: answers no worse than the last true one; ties count."""
    ascending = metric_of(metric).ascending
    last = truth.groupBy("qid").agg((F.max if ascending else F.min)("score").alias("edge"), F.count("*").alias("wanted"))
    good = F.col("score") <= F.col("edge") if ascending else F.col("score") >= F.col("edge")
    told = last.join(answer.select("qid", "score"), "qid", "left").groupBy("qid", "wanted").agg(F.count_if(good).alias("hits"))
    return told.select("qid", F.least("hits", "wanted").alias("hits"), "wanted")


def shared(answer: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.select("qid", "vec_id").intersect(answer.select("qid", "vec_id"))


def missed(answer: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.select("qid", "vec_id").exceptAll(answer.select("qid", "vec_id"))


def lims(queries: DataFrame, found: DataFrame) -> DataFrame:
    """``(qid, n, lim)``: each query's number of answers and how many come before its end, by qid; none is zero.

    The running sum goes by ranges of queries: the totals of the ranges are summed first.
    """
    n = queries.select("qid").join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))
    width = 1024
    ranged = n.withColumn("r", F.floor(F.col("qid") / width))
    totals = ranged.groupBy("r").agg(F.sum("n").alias("t"))
    # a row for each 1,024 ids
    before = totals.withColumn("at", F.coalesce(F.sum("t").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    within = F.sum("n").over(Window.partitionBy("r").orderBy("qid"))
    return ranged.join(before, "r").select("qid", "n", (F.col("at") + within).alias("lim"))


def size_histogram(queries: DataFrame, found: DataFrame) -> DataFrame:
    """``(n, queries)``: how many queries have ``n`` answers."""
    sizes = queries.select("qid").join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.groupBy("n").agg(F.count("*").alias("queries"))


def frontier(points: DataFrame, cost: str, gain: str) -> DataFrame:
    """Points that none of lower or equal cost surpasses; ``points`` is a row a measured run."""
    before = Window.orderBy(F.col(cost), F.col(gain).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("__best", F.max(gain).over(before)).where(F.col("__best").isNull() | (F.col(gain) > F.col("__best"))).drop("__best")


def norm_stats(vectors: DataFrame) -> DataFrame:
    from ..functions.vectors import norm

    return vectors.select(norm(F.col("v")).alias("x")).agg(F.max("x").alias("max_norm"), F.min("x").alias("min_norm"), F.avg("x").alias("avg_norm"))


def run_table(runs: dict[str, Callable[[Observation], DataFrame]], truth: DataFrame) -> DataFrame:
    """``(run, queries, found, distances, hits, wanted, recall)``: a row a search of a sweep.

    ``runs`` has by name functions that give a search's ``(qid, vec_id, ...)``, and let its kernel tell the observation
    how many distances it made.  Each answer is written once and compared from there; so many rows as
    there are runs are held.
    """
    truth, rows = stored(truth.select("qid", "vec_id"), "run-truth"), None
    for name, search in runs.items():
        seen = Observation()
        found = stored(search(seen).select("qid", "vec_id"), "run")
        told = found.agg(F.count_distinct("qid").alias("queries"), F.count("*").alias("found"))
        met = recall(found, truth).agg(F.sum("hits").alias("hits"), F.sum("wanted").alias("wanted"))
        made = F.lit(seen.get["distances"]).cast("long").alias("distances")
        row = told.join(met, F.lit(True)).select(F.lit(name).alias("run"), "queries", "found", made, "hits", "wanted", (F.col("hits") / F.col("wanted")).alias("recall"))  # one row each
        rows = row if rows is None else rows.unionByName(row)
    return rows
