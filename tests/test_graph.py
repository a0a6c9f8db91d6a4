"""Neighbour descent against the distances of all pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecengine.operators import graph

SF = "/root/testdata/sf0.1/embeddings.parquet"


def table(spark, x):
    return spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "vec_id long, v array<double>")


def nearest(x, k):
    d = (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:k]}


def edges(df):
    return {(r.src, r.dst) for r in df.collect()}


@pytest.mark.skipif(not os.path.exists(SF), reason="the test tables are not here")
def test_recall_on_the_embeddings(spark):
    e = spark.read.parquet(SF).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = e.orderBy("vec_id").collect()
    want = nearest(np.array([r.v for r in rows]), 8)
    assert len(edges(graph.descent(e, 8)) & want) >= 0.9 * len(want)


def test_work_grows_as_the_rows(spark):
    g = np.random.default_rng(4)
    done = {}
    for n in (1000, 4000):
        x = g.standard_normal((n // 50, 12))[g.integers(0, n // 50, n)] * 3 + g.standard_normal((n, 12))
        told, want = [], nearest(x, 5)
        found = edges(graph.descent(table(spark, x).repartition(4), 5, width=14, told=told))
        assert len(found & want) >= 0.9 * len(want)
        done[n] = sum(c for c, _ in told)
    assert done[4000] <= 5.5 * done[1000] and done[4000] < 0.3 * 4000 * 3999 / 2


def test_copies_nulls_and_few_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(100 + i, [float(i), -5.0]) for i in range(40)] + [(None, [0.0, 0.0]), (999, None)]
    found = graph.descent(spark.createDataFrame(rows, "vec_id long, v array<double>"), 3).collect()
    assert len(found) == 80 * 3 and all(r.src != r.dst and r.dst is not None for r in found)
    assert all(r.dist == 0 and r.dst < 40 for r in found if r.src < 40)
    one = spark.createDataFrame(rows[:1], "vec_id long, v array<double>")
    assert graph.descent(one, 3).collect() == [] and graph.descent(one.limit(0), 3).collect() == []


def test_first_edges_are_kept_where_they_are_nearest(spark):
    x = np.random.default_rng(2).standard_normal((60, 4))
    start = graph.knn_graph(table(spark, x).withColumn("cid", F.lit(0)), 4)
    assert edges(graph.descent(table(spark, x), 4, start=start)) == nearest(x, 4)
