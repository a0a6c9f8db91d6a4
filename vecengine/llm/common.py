"""Helpers that the operators share: the folder that survives executors, and Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python kernel takes at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the one that ``spark.checkpoint.dir`` names.  Where that is unset, only a local master
    (one machine, as in tests) gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vecengine-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ids_and_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, as ``doc_id`` and ``text``; other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def text_slices(batch: pa.RecordBatch, column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of text each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """Run ``kernel`` over slices of (id, text) batches; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, most):
                yield from kernel(part)

    return df.mapInArrow(run, schema)


_OWNER: list = [None, None]


def claim(name: str, clear: Callable[[], None]) -> None:
    """Let operator ``name`` keep tables in this worker, and free those of the operator before it.

    Spark's workers live on from stage to stage; so the tables of one operator at most take memory.
    """
    if _OWNER[0] != name:
        if _OWNER[1] is not None:
            _OWNER[1]()
        _OWNER[:] = [name, clear]


def bitmap(values: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of ``2 ** bits`` bits with those of ``column`` (longs from 0) set, LSB first.

    Its size does not depend on the data.  It is built on the executors, 32,768 bits a row.
    """
    v = F.col(column) + 1
    parts = values.groupBy(F.bitmap_bucket_number(v).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("b"))
    out = bytearray(max(1 << bits >> 3, 4096))
    for k, b in parts.toLocalIterator():
        out[(k - 1) * 4096 : k * 4096] = b
    return bytes(out)
