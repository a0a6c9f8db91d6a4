"""Vector files in splits: a data source that reads ranges of rows and that executors write to.

``spark.read.format("vectors")`` gives a file or a folder of files of ``sources.binary``'s layout,
each cut into partitions of about ``splitBytes``; ``df.write.format("vectors")`` writes a folder, a
task's rows in files of at most ``fileBytes`` each, whose names follow the partitions' order.  Files
are opened by Arrow's file systems (``file:``, ``hdfs:``, ``s3:``, ``gs:`` or a plain path).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .binary import KINDS, kind_of

#: Bytes of a partition when nothing else is asked for, of a written file, and rows of a batch.
SPLIT_BYTES, FILE_BYTES, BATCH_ROWS = 64 << 20, 256 << 20, 16_384
HEADER = 8


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Rows(InputPartition):
    """A range of the rows of one file; ``before`` counts the rows of the files before it."""

    path: str
    start: int
    count: int
    dim: int
    before: int


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: names in the staging folder, and each one's rows and dimensions."""

    files: list[tuple[str, int, int]]


class VectorReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path = options["path"]
        self.dtype, _, self.arrow = KINDS[options.get("kind") or kind_of(self.path)]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Rows]:
        """Ranges of rows; a file's header, eight bytes, is all that is read here."""
        system, root = _opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name[0] not in "._"]
        files.sort(key=lambda f: f.path)
        width = np.dtype(self.dtype).itemsize

        def told(file: fs.FileInfo) -> tuple[int, int]:
            with system.open_input_file(file.path) as source:
                raw = source.read(HEADER)
            n, dim = np.frombuffer(raw, "<u4").tolist() if len(raw) == HEADER else (0, 0)
            if len(raw) != HEADER or file.size != HEADER + n * dim * width:
                raise ValueError(f"{file.path} tells {n} x {dim} and has {file.size} bytes")
            return n, dim

        with ThreadPoolExecutor(32) as pool:
            headers = list(pool.map(told, files))
        out, before = [], 0
        for file, (n, dim) in zip(files, headers, strict=True):
            step = max(1, self.split // max(1, dim * width))
            out += [Rows(file.path, at, min(step, n - at), dim, before) for at in range(0, n, step)]
            before += n
        return out or [Rows("", 0, 0, 0, 0)]  # Spark wants one partition at least

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = _opened(self.path)
        dim, width = partition.dim, np.dtype(self.dtype).itemsize
        with system.open_input_file(partition.path) as source:
            source.seek(HEADER + partition.start * dim * width)
            for at in range(0, partition.count, BATCH_ROWS):
                rows = min(BATCH_ROWS, partition.count - at)
                values = np.frombuffer(source.read(rows * dim * width), self.dtype)
                if len(values) != rows * dim:
                    raise ValueError(f"{partition.path} became shorter")
                ends = pa.array(np.arange(rows + 1, dtype=np.int32) * dim)
                lists = pa.ListArray.from_arrays(ends, pa.array(values.astype(self.arrow.to_pandas_dtype())))
                first = partition.before + partition.start + at
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * rows), pa.array(np.arange(first, first + rows)), lists], ["file", "vec_id", "embedding"])


class VectorWriter(DataSourceArrowWriter):
    """Tasks write whole files into a staging folder; the commit moves those of the attempts that count."""

    def __init__(self, options: Mapping[str, str], schema: StructType, overwrite: bool):
        self.path, self.kind = options["path"], options.get("kind", "fbin")
        self.dtype, self.most = KINDS[self.kind][0], int(options.get("fileBytes", FILE_BYTES))
        self.column, self.overwrite = schema.fieldNames().index(options.get("column", "embedding")), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.path)
        folder = posixpath.join(root, self.staging)
        system.create_dir(folder, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, held, size, dim = [], [], 0, None

        def flush() -> None:
            nonlocal held, size
            values = np.concatenate(held)
            name = f"part-{task:08d}-{len(files):06d}-{attempt}.{self.kind}"
            with system.open_output_stream(posixpath.join(folder, name)) as out:
                out.write(np.array([len(values) // dim, dim], "<u4").tobytes())
                out.write(values.tobytes())
            files.append((name, len(values) // dim, dim))
            held, size = [], 0

        for batch in batches:
            lists = batch.column(self.column)
            lengths = np.unique(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
            if not lengths:
                continue
            dim = dim or lengths[0]
            if lengths != [dim] or not dim or lists.flatten().null_count:
                raise ValueError(f"a vector file holds vectors of one length without nulls, not of lengths {lengths}")
            values = lists.flatten().to_numpy(zero_copy_only=False)
            rows = max(1, self.most // (dim * np.dtype(self.dtype).itemsize))
            for at in range(0, len(values) // dim, rows):
                part = values[at * dim : (at + rows) * dim].astype(self.dtype)
                if size and size + part.nbytes > self.most:
                    flush()
                held.append(part)
                size += part.nbytes
        if held:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({dim for _, _, dim in files}) > 1:
            self.abort(messages)
            raise ValueError("the tasks' vectors differ in length")
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.is_file and old.base_name.endswith(tuple(f".{k}" for k in KINDS)):
                    system.delete_file(old.path)
        for name, _, _ in files:
            system.move(posixpath.join(root, self.staging, name), posixpath.join(root, name))
        self.abort(messages)
        with system.open_output_stream(posixpath.join(root, "_SUCCESS")) as out:
            out.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        staging = posixpath.join(root, self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class VectorFiles(DataSource):
    """Options: ``path``, ``kind`` (else the path's extension; ``fbin`` when written), ``splitBytes``; for a writer ``column`` and ``fileBytes``."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        kind = self.options.get("kind") or kind_of(self.options["path"])
        return f"file string, vec_id long, embedding array<{KINDS[kind][1]}>"

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options, schema, overwrite)


def scan_vectors(spark: SparkSession, path: str, kind: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(file, vec_id, embedding)`` as ``binary.read_vectors`` gives, with each file read by as many tasks as it has splits.

    vec_id counts the rows of the files before, by name.  A file whose header and size differ
    fails the read; a file or folder without rows is empty; hidden files (``_``, ``.``) are left out.
    """
    spark.dataSource.register(VectorFiles)
    return spark.read.format("vectors").option("kind", kind or kind_of(path)).option("splitBytes", split_bytes).load(path)


def write_vectors(vectors: DataFrame, path: str, kind: str = "fbin", order: str | None = "vec_id", column: str = "embedding", file_bytes: int = FILE_BYTES) -> None:
    """A folder of vector files, written by the executors in the order of ``order`` (null: as the rows come).

    Rows are ranged by ``order``, so file names follow it and a scan's ids are the rows' places in
    that order.  Null vectors and vectors of several lengths fail the job; an empty table gives a
    folder without files.  A failed or repeated task leaves nothing behind.
    """
    vectors.sparkSession.dataSource.register(VectorFiles)
    ranged = vectors.select(order, column).repartitionByRange(order).sortWithinPartitions(order) if order else vectors.select(column)
    ranged.select(column).write.format("vectors").mode("append").option("kind", kind).option("column", column).option("fileBytes", file_bytes).save(path)
