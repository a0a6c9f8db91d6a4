"""Every query that SQL can express gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from vecengine.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    theirs = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert {c: ours[c].dtype for c in columns} == {c: theirs[c].dtype for c in columns}
    text = lambda d: d[columns].astype(str).sort_values(columns).to_numpy().tolist()
    assert text(ours) == text(theirs)


def test_every_query_without_sql_is_known():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"index_knn", "graph_beam_knn", "graph_range", "kmeanspp_seed", "knn_graph_descent", "sq_graph_knn"}


def test_recall_of_the_queries_without_sql(spark):
    rows = lambda name: {(r.qid, r.vec_id) for r in catalog.QUERIES[name](spark, SF).collect()}
    truth, near = rows("knn_exact_l2"), rows("range_exact")
    assert len(rows("index_knn") & truth) / len(truth) >= 0.9
    assert len(rows("graph_beam_knn") & truth) / len(truth) >= 0.9
    assert len(rows("sq_graph_knn") & truth) / len(truth) >= 0.9
    found = rows("graph_range")
    assert found <= near and len(found) >= 0.9 * len(near)
    assert catalog.QUERIES["kmeanspp_seed"](spark, SF).select("vec_id").distinct().count() == 10
