"""Vector files read in splits and written by executors."""

import os

import numpy as np
import pytest

from vecengine.operators import cluster
from vecengine.sources import binary, split


def vectors(path):
    return [tuple(r) for r in path.select("vec_id", "embedding").orderBy("vec_id").collect()]


@pytest.mark.parametrize(("kind", "dtype"), [("fbin", "<f4"), ("u8bin", "u1"), ("i8bin", "i1")])
def test_one_file_in_three_partitions(spark, tmp_path, kind, dtype):
    x = np.arange(-100, 100).reshape(50, 4).astype(dtype)
    path = tmp_path / f"a.{kind}"
    path.write_bytes(np.array([50, 4], "<u4").tobytes() + x.tobytes())
    cut = split.scan_vectors(spark, str(path), split_bytes=20 * 4 * np.dtype(dtype).itemsize)
    assert cut.rdd.getNumPartitions() == 3 and split.scan_vectors(spark, f"file:{path}").rdd.getNumPartitions() == 1
    assert cut.schema == binary.read_vectors(spark, str(path)).schema
    assert vectors(cut) == vectors(binary.read_vectors(spark, str(path))) == [(k, row) for k, row in enumerate(x.astype(float).tolist())]
    assert binary.header(spark, str(path)) == (50, 4)


def test_a_folder_written_by_executors_reads_back(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(300, 5)).astype("f4")
    rows = spark.createDataFrame([(7 * (k * 11 % 300), v, k) for k, v in ((k, x[k * 11 % 300].tolist()) for k in range(300))], "vec_id long, embedding array<float>, other int")
    path = str(tmp_path / "out.fbin")
    split.write_vectors(rows.repartition(6), path, file_bytes=400)
    names = sorted(n for n in os.listdir(path) if n[0] not in "._")
    assert len(names) > 10 and not [n for n in os.listdir(path) if n.startswith("_staging")]
    want = [(k, v) for k, v in enumerate(x.tolist())]
    assert vectors(split.scan_vectors(spark, path, split_bytes=60)) == vectors(binary.read_vectors(spark, path)) == want
    split.write_vectors(rows.limit(0), str(tmp_path / "none.fbin"))
    assert split.scan_vectors(spark, str(tmp_path / "none.fbin")).count() == 0


def test_what_does_not_fit_fails_and_leaves_nothing(spark, tmp_path):
    bad = [[(1, [1.0, 2.0]), (2, [1.0])], [(1, None)], [(1, [1.0, None])], [(1, [])]]
    for k, rows in enumerate(bad):
        path = str(tmp_path / f"bad{k}.fbin")
        with pytest.raises(Exception, match="length"):
            split.write_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), path)
        assert not os.path.exists(path) or not os.listdir(path)
    (tmp_path / "short.fbin").write_bytes(np.array([3, 2], "<u4").tobytes() + b"1234")
    with pytest.raises(Exception, match="tells 3 x 2"):
        split.scan_vectors(spark, str(tmp_path / "short.fbin")).collect()


def test_transposed(spark):
    rows = [(0, [1.0, 2.0]), (3, [3.0, 4.0]), (1, [5.0]), (2, None), (9, [7.0, 8.0]), (5, [])]
    got = {tuple(map(str, r)) for r in cluster.transposed(spark.createDataFrame(rows, "vec_id long, v array<double>"), 4).collect()}
    want = [(0, 0, 3, [1.0, 5.0, 3.0]), (0, 1, 2, [2.0, 4.0]), (2, 0, 1, [7.0]), (2, 1, 1, [8.0])]
    assert got == {tuple(map(str, r)) for r in want}
