"""Binary vector files: ``u32 n, u32 dim``, then rows of one element type; and files of answers.

The element type is that of the file's extension.  Files are read and written through Spark's
own readers and writers, so any path that Spark can open will do; a file is one task's work here,
and its rows follow those of the files before it by name.  ``sources.split`` reads a file in many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Extensions, element types and what Spark calls them.
KINDS = {"fbin": ("<f4", "float", pa.float32()), "u8bin": ("u1", "smallint", pa.int16()), "i8bin": ("i1", "tinyint", pa.int8())}


def kind_of(path: str) -> str:
    """The kind that a path's extension names."""
    ending = path.rstrip("/").rpartition(".")[2].split("/")[0]
    if ending not in KINDS:
        raise ValueError(f"unknown vector file {path!r}; known: {', '.join(KINDS)}")
    return ending


def header(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rows and dimensions of one file."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        raw = bytes(source.readUnsignedByte() for _ in range(8))
    finally:
        source.close()
    n, dim = np.frombuffer(raw, "<u4").tolist()
    return n, dim


def read_vectors(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """``(file, vec_id, embedding)`` of a file or a folder of files of one kind.

    vec_id is the row's place in its file after all rows of the files before it by name, so ids are
    unique in a folder; a short file fails the job.  The files' headers, one row a file, are read
    first.
    """
    dtype, name, arrow = KINDS[kind or kind_of(path)]
    source = spark.read.format("binaryFile").load(path)
    told = sorted((r.path, int.from_bytes(bytes(r.n), "little")) for r in source.select("path", F.substring("content", 1, 4).alias("n")).collect())
    before = dict(zip([p for p, _ in told], np.cumsum([0, *[n for _, n in told]]).tolist(), strict=False))

    def run(batches):
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                buffer = raw.as_buffer()
                n, dim = np.frombuffer(buffer, "<u4", 2).tolist()
                values = np.frombuffer(buffer, dtype, offset=8)
                if len(values) != n * dim:
                    raise ValueError(f"{file} tells {n} x {dim} and has {len(values)} values")
                for at in range(0, n, 65_536):
                    part = values[at * dim : min(n, at + 65_536) * dim]
                    rows = len(part) // dim
                    lists = pa.ListArray.from_arrays(np.arange(0, len(part) + 1, dim, dtype=np.int32), pa.array(part.astype(arrow.to_pandas_dtype())))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * rows), pa.array(np.arange(at, at + rows) + before[file]), lists], ["file", "vec_id", "embedding"])

    return source.select("path", "content").mapInArrow(run, f"file string, vec_id long, embedding array<{name}>")


def pack_vectors(vectors: DataFrame, kind: str, order: str = "vec_id", column: str = "embedding") -> bytes:
    """The bytes of one file of a bounded set of vectors, by ``order``; at most a million rows."""
    table = vectors.select(order, column).orderBy(order).limit(1_000_001).toArrow()
    if table.num_rows > 1_000_000:
        raise ValueError("more than a million rows: use split.write_vectors")
    values = table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(KINDS[kind][0])
    dim = len(values) // table.num_rows if table.num_rows else 0
    return np.array([table.num_rows, dim], "<u4").tobytes() + values.tobytes()


def pack_answer(answer: DataFrame, k: int) -> bytes:
    """The bytes of one file ``u32 nq, u32 k, u32 ids[nq*k], f32 scores[nq*k]`` of a bounded answer, by query.

    A query with fewer than ``k`` rows is filled up with the id 2 ** 32 - 1 and an infinite score.
    """
    table = answer.orderBy("qid", "rank").select("qid", "rank", "vec_id", "score").limit(10_000_001).toArrow()
    if table.num_rows > 10_000_000:
        raise ValueError("more than ten million rows: write a directory of files")
    qids, row = np.unique(table["qid"].to_numpy(), return_inverse=True)
    ids, scores = np.full((len(qids), k), 2**32 - 1, "<u4"), np.full((len(qids), k), np.inf, "<f4")
    at = table["rank"].to_numpy() - 1
    ids[row, at], scores[row, at] = table["vec_id"].to_numpy(), table["score"].to_numpy()
    return np.array([len(qids), k], "<u4").tobytes() + ids.tobytes() + scores.tobytes()


def read_range_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, vec_id)`` of a file ``i32 nq, i32 total, i32 count[nq], i32 ids[total]``."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                values = np.frombuffer(raw.as_buffer(), "<i4")
                nq, total = values[:2].tolist()
                counts, ids = values[2 : 2 + nq], values[2 + nq : 2 + nq + total]
                if len(ids) != total or counts.sum() != total:
                    raise ValueError("the truth file's counts and ids differ")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(nq), counts)), pa.array(ids.astype(np.int64))], ["qid", "vec_id"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "qid long, vec_id long")


def read_knn_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, rank, vec_id, score)`` of a file ``u32 nq, u32 k, u32 ids[nq*k], f32 scores[nq*k]``."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                buffer = raw.as_buffer()
                nq, k = np.frombuffer(buffer, "<u4", 2).tolist()
                ids = np.frombuffer(buffer, "<u4", nq * k, 8).astype(np.int64)
                scores = np.frombuffer(buffer, "<f4", nq * k, 8 + 4 * nq * k).astype(np.float64)
                columns = [np.repeat(np.arange(nq), k), np.tile(np.arange(1, k + 1), nq), ids, scores]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["qid", "rank", "vec_id", "score"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "qid long, rank long, vec_id long, score double")


def read_text_answer(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, rank, score, vec_id)`` of text files of ``score id`` lines with an empty line between queries.

    Queries are numbered from 0 through the files by name; a query without lines has no rows.  A
    file is one task's work.
    """

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nth = rank = 0
                for line in (text or "").splitlines():
                    if line.strip():
                        rank += 1
                        score, vec_id = line.split()
                        for column, x in zip(out, (file, nth, rank, float(score), int(vec_id)), strict=True):
                            column.append(x)
                    else:
                        nth, rank = nth + 1, 0
                for column, x in zip(out, (file, nth + bool(rank), None, None, None), strict=True):  # how many queries the file has
                    column.append(x)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["file", "nth", "rank", "score", "vec_id"])

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = texts.mapInArrow(run, "file string, nth long, rank long, score double, vec_id long")
    counts = rows.where("rank IS NULL").select("file", "nth")  # a row a file
    before = counts.select("file", (F.sum("nth").over(Window.orderBy("file")) - F.col("nth")).alias("before"))
    lines = rows.where("rank IS NOT NULL").join(F.broadcast(before), "file")
    return lines.select((F.col("nth") + F.col("before")).alias("qid"), "rank", "score", "vec_id")


def write_text_answer(answer: DataFrame, path: str) -> None:
    """Lines of ``score id`` by query and rank, and an empty line behind each query."""
    line = F.concat_ws(" ", F.col("score").cast("string"), F.col("vec_id").cast("string"))
    queries = answer.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))  # k lines a query
    queries.orderBy("qid").select(F.concat(F.array_join("x.line", "\n"), F.lit("\n")).alias("value")).write.text(path)
