"""Token ids in a binary table of bit-plane shuffled, compressed blocks.

Ids are cut into blocks of a fixed size.  A block's 32-bit ids are transposed into four byte
planes (or 32 bit planes): plane k holds the k-th byte (bit) of every id.  Each plane is
compressed with zstandard; a plane of zeros is stored as no bytes.  A row of the table is a
segment: whole documents in order, their blocks, and the chunk index that tells where each
document and each block starts.  Segments lie in shards, and shards follow each other by id.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _TWO_SPACES
from .common import ids_and_texts, shared_dir, text_slices

#: Distinct chunks of text whose ids a worker keeps; above that it starts anew.
KEPT_CHUNKS = 700_000
BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20

_FILE = (
    "shard int, segment int, n_ids long, doc_ids array<long>, doc_starts array<long>, "
    "blocks array<struct<first:long, n:int, crc32:long, planes:array<binary>>>"
)
_BLOCKS = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int32()), ("crc32", pa.int64()), ("planes", pa.list_(pa.binary()))]))


def shuffle_block(ids: np.ndarray, bits: bool = False, level: int = 1) -> list[bytes]:
    """The compressed planes of one block of unsigned 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(raw.T)
    press = zstandard.ZstdCompressor(level=level).compress
    return [press(p.tobytes()) if p.any() else b"" for p in planes]


def unshuffle_block(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block of ``n``; its number of planes tells whether they are of bytes or bits."""
    bits = len(planes) == 32
    width = -(-n // 8) if bits else n
    plain = zstandard.ZstdDecompressor().decompress
    rows = [np.frombuffer(plain(p), np.uint8) if p else np.zeros(width, np.uint8) for p in planes]
    raw = np.stack(rows)
    if bits:
        raw = np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little")
        return np.ascontiguousarray(raw).view("<u4").ravel()
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


class _Numbers(dict):
    """Numbers chunks as they come, and lists the new ones."""

    def __init__(self, known: list[str] = ()):
        super().__init__(zip(known, range(len(known)), strict=True))
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class LibraryEncoder:
    """Whole texts through the tokenizers library, each distinct chunk of a text once.

    A single space belongs to the word after it, so a text without two spaces in a row may be cut
    at its spaces; the library encodes each chunk with its space.  Other texts, and those that
    hold an added token, go through it whole.  A mark after a letter or digit is a word of its own
    for the library, so a chunk that ends in one is the chunk before it and the mark.  Chunks are
    numbered; chunk k's ids are the ``sizes[k]`` ids of ``pool`` from ``starts[k]`` on.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        space = self.library.encode(" ", add_special_tokens=False).tokens[0]
        self.opens = np.zeros(max(self.library.get_vocab().values()) + 1, bool)
        self.opens[[i for t, i in self.library.get_vocab().items() if t.startswith(space)]] = True
        self.marks = {m: self.library.encode(m, add_special_tokens=False).ids[0] for m in ",.;:!?"}
        self.number, self.pool = _Numbers(), np.zeros(0, "<u4")
        self.starts = self.sizes = self.last = np.zeros(0, np.int64)

    def _put(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the ids of chunks, which follow each other."""
        room = len(self.number)
        if len(self.starts) < room:
            more = np.zeros(room - len(self.starts), np.int64)
            self.starts, self.sizes = np.append(self.starts, more), np.append(self.sizes, more)
        self.starts[numbers] = len(self.pool) + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.pool = np.append(self.pool, ids)

    def _learn(self) -> None:
        """Encode the new chunks end to end, each after a space: only a chunk's first token begins with one."""
        new, self.number.new = self.number.new, []
        number, marks = self.number, self.marks
        marked = [c for c in new if c[-1:] in marks and c[-2:-1].isalnum()]
        bases = np.array([number[c[:-1]] for c in marked], np.int64)
        plain = [c for c in new if not (c[-1:] in marks and c[-2:-1].isalnum())] + number.new
        number.new = []
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(part):
                raise ValueError("a chunk's token begins with a space")
            self._put(np.array([number[c] for c in part], np.int64), ids, np.diff(np.append(starts, len(ids))))
        if marked:
            ids, at = self._gathered(bases)
            ids = np.insert(ids, at[1:], [marks[c[-1]] for c in marked])
            self._put(np.array([number[c] for c in marked], np.int64), ids, np.diff(at) + 1)

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after the other, and where each chunk's begin (and the last one's end)."""
        sizes = self.sizes[numbers]
        at = np.concatenate(([0], np.cumsum(sizes)))
        return self.pool[np.repeat(self.starts[numbers] - at[:-1], sizes) + np.arange(at[-1])], at

    def _forget(self) -> None:
        """Keep the chunks of the texts encoded last."""
        names, recent = list(self.number), np.sort(self.last)
        kept, at = self._gathered(recent)
        self.number, self.pool = _Numbers([names[k] for k in recent.tolist()]), np.zeros(0, "<u4")
        self.starts = self.sizes = np.zeros(0, np.int64)
        self._put(np.arange(len(recent)), kept, np.diff(at))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null text is an empty one."""
        told = [t or "" for t in texts.to_pylist()]
        whole = [bool(_TWO_SPACES.search(t)) or t[-1:].isspace() or t[:1].isspace() or any(a in t for a in self.added) for t in told]
        if len(self.number) > KEPT_CHUNKS:
            self._forget()
        # Arrow cuts the texts and finds the distinct chunks; an odd text is one chunk, its first
        cut = pa.compute.split_pattern(pa.compute.if_else(pa.array(whole, pa.bool_()), "", texts.fill_null("")), " ")
        chunks, offsets = cut.flatten(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        tail = np.ones(len(chunks), bool)
        tail[offsets[:-1]] = False
        first = chunks.take(pa.array(offsets[:-1])).to_pylist()
        heads = self.library.encode_batch_fast([t if odd else f for t, odd, f in zip(told, whole, first, strict=True)], add_special_tokens=False)
        coded = chunks.filter(pa.array(tail)).dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))
        if self.number.new:
            self._learn()
        self.last = known
        ids, at = self._gathered(known[coded.indices.to_numpy()])
        cuts = at[offsets - np.arange(len(offsets))].tolist()
        return [np.array(h.ids, "<u4").tobytes() + ids[a:b].tobytes() for h, a, b in zip(heads, cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def _library(spec: str) -> LibraryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return LibraryEncoder(spec)


def _segment(shard: int, number: int, docs: list[tuple[int | None, bytes]], bits: bool) -> dict:
    ids = np.frombuffer(b"".join(p for _, p in docs), "<u4")
    starts = np.cumsum([0, *[len(p) // 4 for _, p in docs]])[:-1]
    blocks = []
    for at in range(0, len(ids), BLOCK_IDS):
        part = ids[at : at + BLOCK_IDS]
        blocks.append({"first": at, "n": len(part), "crc32": zlib.crc32(part.tobytes()), "planes": shuffle_block(part, bits)})
    return {"shard": shard, "segment": number, "n_ids": len(ids), "doc_ids": [i for i, _ in docs], "doc_starts": starts.tolist(), "blocks": blocks}


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row with the tokenizers library, append ``end_id``, and write the ids by ascending id.

    Rows are dealt out by ranges of ids and sorted; a range is a shard.  A null text is an empty
    one (its end id only); null ids come first; repeated rows are written as often as they come.
    A segment holds about SEGMENT_IDS ids, more only for a document that is longer by itself.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())  # noqa: SIM115  a vocabulary file, a few MB
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def full() -> pa.RecordBatch:
            row = _segment(shard, number, held, bits)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), _BLOCKS]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            for part in text_slices(batch):
                packed = _library(spec.value).encode(part.column(1))
                for doc_id, ids in zip(part.column(0).to_pylist(), packed, strict=True):
                    held.append((doc_id, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield full()
                        number, held, size = number + 1, [], 0
        if held:
            yield full()

    ordered = ids_and_texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # the planes are compressed already
    ordered.mapInArrow(run, _FILE).write.option("compression", "none").parquet(path)


def located(segments: DataFrame) -> DataFrame:
    """The segments with ``first``: how many ids of the whole sequence come before each.

    Only the index columns are read for it.  One row a segment is broadcast after its number is
    checked; a table of more than 200,000 segments (2 * 10^11 ids) is joined by a shuffle.
    """
    sizes = segments.groupBy("shard", "segment").agg(F.sum("n_ids").alias("n_ids"))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.sort_array(F.collect_list(F.struct("segment", "n_ids"))).alias("s"))
    totals = sorted((r[0], r[1]) for r in shards.select("shard", "n").collect())
    at = np.cumsum([0, *[n for _, n in totals]]).tolist()
    firsts = segments.sparkSession.createDataFrame([(s, a) for (s, _), a in zip(totals, at, strict=False)], "shard int, at long")
    places = shards.join(F.broadcast(firsts), "shard").selectExpr("shard", "at", "s", "posexplode(s) AS (k, x)").selectExpr(
        "shard", "x.segment AS segment", "at + aggregate(slice(s, 1, k), 0L, (a, y) -> a + y.n_ids) AS first"
    )
    if sizes.count() <= 200_000:
        places = F.broadcast(places)
    return segments.join(places, ["shard", "segment"])


def _documents(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """The documents of one segment, each block checked."""
    parts = []
    for b in row["blocks"]:
        ids = unshuffle_block(b["planes"], b["n"])
        if zlib.crc32(ids.tobytes()) != b["crc32"]:
            raise ValueError(f"the block at {b['first']} of segment {row['segment']} differs from its checksum")
        parts.append(ids)
    ids = np.concatenate(parts)
    starts = row["doc_starts"]
    for doc_id, a, b in zip(row["doc_ids"], starts, [*starts[1:], len(ids)], strict=True):
        yield doc_id, row["first"] + a, ids[a:b]


def _read(segments: DataFrame, value, kind: str, arrow: pa.DataType) -> DataFrame:
    """``(doc_id, start, n_tokens, value)`` of every document; each segment is read by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = list(_documents(batch.slice(k, 1).to_pylist()[0]))
                columns = [[d for d, _, _ in found], [s for _, s, _ in found], [len(i) for _, _, i in found], [value(i) for _, _, i in found]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "n_tokens", "value"])

    columns = located(segments).select("segment", "first", "doc_ids", "doc_starts", "blocks")
    return columns.mapInArrow(run, f"doc_id long, start long, n_tokens long, value {kind}")


def read(segments: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document; a block that differs from its checksum fails the job."""
    return _read(segments, lambda ids: ids.astype(np.int64), "array<long>", pa.list_(pa.int64())).withColumnRenamed("value", "ids")


def checksums(segments: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the ids read back."""
    return _read(segments, lambda ids: zlib.crc32(ids.tobytes()), "long", pa.int64()).withColumnRenamed("value", "ids_crc32")


def written(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """The segments of a table newly written in the shared folder."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, tokenizer_path, path, **options)
    return spark.read.schema(_FILE).parquet(path)
