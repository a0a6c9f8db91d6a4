"""Rows to start k-means from, against draws one by one."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecengine.operators import cluster

SF = "/root/testdata/sf0.1/embeddings.parquet"


def cost(x, c):
    return ((x[:, None, :] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()


def table(spark, x):
    return spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "vec_id long, v array<double>")


@pytest.mark.skipif(not os.path.exists(SF), reason="the test tables are not here")
def test_cost_is_that_of_draws_one_by_one(spark):
    e = spark.read.parquet(SF).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    x = np.array([r.v for r in e.orderBy("vec_id").collect()])
    rows = cluster.seeds(e, 20).collect()
    assert sorted(r.cid for r in rows) == list(range(20)) and len({r.vec_id for r in rows}) == 20
    assert all(np.allclose(x[r.vec_id], r.c) for r in rows)
    plain = np.mean([cost(x, x[cluster.kmeanspp(x, 20, s)]) for s in range(5)])
    assert cost(x, np.array([r.c for r in rows])) <= 1.1 * plain


def test_every_far_group_gets_a_row_in_any_partitioning(spark):
    g = np.random.default_rng(2)
    x = np.concatenate([g.standard_normal((40, 3)) + 100 * i for i in range(12)])
    v = table(spark, x)
    one, two = ({r.vec_id for r in cluster.seeds(v.repartition(n), 12).collect()} for n in (2, 5))
    assert one == two and {i // 40 for i in one} == set(range(12))


def test_few_equal_and_null_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)] + [(9, None), (None, [2.0, 2.0])], "vec_id long, v array<double>")
    assert len({r.vec_id for r in cluster.seeds(same, 4).collect()}) == 4
    assert cluster.seeds(same, 50).count() == 6 and cluster.seeds(same.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        cluster.seeds(same, 0)
