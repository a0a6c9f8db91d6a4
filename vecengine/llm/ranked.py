"""Ranked lexical search: the best documents of each item, by bounds from bit-sliced Bloom signatures.

Every document's terms go into a Bloom signature whose width follows their number; of a term that
occurs more often, keys of its tiers (twice or more, three times or more, ...) go in too.  Documents
of one width are put together in blocks, and a block is stored by slices: a slice is a bitmap over
the block's documents of those that have one bit.  The slices of a key's bits and-ed together are a
bitmap that misses no document with the term; summed up with the terms' weights, and with the most
that a tier's occurrences can count in a document of that length, they bound each score from above.

A search takes two passes over the blocks.  The first finds the documents with the highest bounds and
scores them exactly: the k-th of those scores is one that the answer's k-th cannot be below.
The second finds all documents whose bound reaches it, and those are scored exactly.  So the answer
is exact, whatever the signatures' errors; they only tell how many documents are scored for nothing.

Defined results: a null or empty text has no terms and is never returned, nor is a row without
an id (though its terms count).  Rows that repeat are documents of their own; rows of one id
are each ranked.  Rows that repeat an item's id are one item with the terms of all.  An item without
terms has no rows, and an empty table of either kind gives none.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, discard, ids_and_texts, stored

#: Least bits of a signature for each key, and bits that a key sets.
BITS_A_KEY, PROBES = 20, 10
#: Least occurrences of each tier.
TIERS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 22, 29, 38, 50, 70, 100, 150, 250, 500, 1000)
#: Bits of a block's slices, and the widest signature (a longer text's bounds are looser).
BLOCK_BITS, MOST_WIDTH = 1 << 23, 1 << 24
#: Pairs of an item and a term that are sent to every task; more items are searched in several rounds.
MOST_PAIRS = 1 << 17
#: Up to so many documents to score are sent to every task; more are joined by a shuffle.
SENT = 100_000
#: How many times k documents the first pass scores.
FIRST = 2
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 22
# Fixed values of the score: what a weight, an occurrence and a length count.
WEIGHT, GAIN, STEP, DAMP, BASE, PULL = 1000, 1_000_000_000, 1000, 20, 100, 50

#: Letters in lower case, digits and all bytes of other characters stay; what is between terms is a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_BLOCK = "width int, ids array<long>, sizes array<long>, most array<long>, slices binary, terms array<binary>, dfs array<long>"


def terms_of(text: bytes | None) -> Counter:
    """How often each term occurs in a whole text, however long."""
    found: Counter = Counter()
    if not text:
        return found
    text = text.translate(_TERM_BYTES)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE) if len(text) - start > PIECE else -1
        end = len(text) if end < 0 else end
        found.update(text[start:end].split())
        start = end
    return found


def _keys(hashes: np.ndarray, tier: int) -> np.ndarray:
    """The keys of terms in one tier."""
    # fixed values: odd constants that mix the tier in
    k = (hashes + np.uint64((tier * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(29))


def _width(keys: int) -> int:
    """The width of a signature of so many keys: a multiple of 64, in steps of a quarter at most."""
    step = 64 * max(1, 1 << max(0, (BITS_A_KEY * keys // 64).bit_length() - 3))
    return min(MOST_WIDTH, -(-BITS_A_KEY * keys // step) * step)


def _bits(keys: np.ndarray, width: int) -> np.ndarray:
    """The places of each key's bits in a signature of ``width``."""
    low, step = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(width)).astype(np.int64)


def _hashes(terms) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms))


class _Slicer:
    """Signatures of one width that wait until they fill a block."""

    def __init__(self, width: int):
        self.width, self.rows = width, max(8, min(1 << 13, BLOCK_BITS // width))
        self.clear()

    def clear(self):
        self.ids, self.sizes, self.most, self.held = [], [], [], []

    def add(self, doc_id, size: int, most: int, places: np.ndarray) -> bool:
        row = np.zeros(self.width, bool)
        row[places.ravel()] = True
        for to, x in ((self.ids, doc_id), (self.sizes, size), (self.most, most), (self.held, np.packbits(row))):
            to.append(x)
        return len(self.ids) == self.rows

    def block(self) -> pa.RecordBatch:
        """The block of what waits: bit ``j`` of its document ``i`` is bit ``i`` of slice ``j``."""
        rows, step = np.stack(self.held), 1 << 12
        slices = np.concatenate([np.packbits(np.unpackbits(rows[:, a // 8 : (a + step) // 8], axis=1).T, axis=1) for a in range(0, self.width, step)])
        out = _row(self.width, self.ids, self.sizes, self.most, slices.tobytes(), [], [])
        self.clear()
        return out


def _row(*values) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in _BLOCK.split(", ")])


def _scan(docs: DataFrame, watched: list[bytes], signed: bool) -> DataFrame:
    """A row a block of signatures (if ``signed``), and a row a task of how many documents hold each watched term (width 0)."""
    held = docs.sparkSession.sparkContext.broadcast(watched)  # MOST_PAIRS at most, or one item's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts, waiting = set(held.value), Counter(), {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                tf = terms_of(text.as_py())
                if not tf:
                    continue
                counts.update(tf.keys() & wanted)
                if not signed:
                    continue
                h, n = _hashes(tf.keys()), np.fromiter(tf.values(), np.int64, len(tf))
                keys = np.concatenate([_keys(h[n >= least], tier) for tier, least in enumerate(TIERS)])
                width = _width(len(keys))
                to = waiting.setdefault(width, _Slicer(width))
                if to.add(doc_id.as_py(), int(n.sum()), int(n.max()), _bits(keys, width)):
                    yield to.block()
        for to in waiting.values():
            if to.ids:
                yield to.block()
        if counts:
            yield _row(0, [], [], [], b"", list(counts), list(counts.values()))

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, _BLOCK)


def index(docs: DataFrame, watched: list[bytes] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored table of a corpus' signatures in blocks, with how many documents hold each of ``watched``."""
    return stored(_scan(ids_and_texts(docs, id_col, text_col), list(watched), True), "ranked-index")


def totals(blocks: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have together."""
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    told = blocks.where("width > 0").agg(F.sum(F.size("ids")).alias("n"), F.sum(total).alias("l")).first()
    return told.n or 0, told.l or 0


def _frequencies(found: DataFrame) -> dict[bytes, int]:
    rows = found.where("width = 0").select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).toArrow()
    return dict(zip(rows["terms"].to_pylist(), rows["df"].to_pylist(), strict=True))  # a row a watched term


def _damping(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """A document's share of the length in the score, exact also where 64 bits would not do."""
    if len(sizes) and PULL * n * int(sizes.max()) >= 1 << 62:
        return np.array([BASE - PULL + PULL * int(s) * n // total for s in sizes], np.int64)
    return BASE - PULL + PULL * sizes * n // max(1, total)


class _Items:
    """Items as lists of terms' numbers; hashes and weights go by those."""

    def __init__(self, pairs: list[tuple], df: dict[bytes, int], n: int, total: int):
        self.n, self.total, held = n, total, {}
        of = {t: i for i, t in enumerate(sorted({t for _, t in pairs if df.get(t)}))}
        for item, term in pairs:
            if term in of:
                held.setdefault(item, []).append(of[term])
        self.names, self.terms = list(held), list(of)
        self.lists = [np.array(sorted(x)) for x in held.values()]
        self.hashes = _hashes(self.terms)
        self.weights = np.array([math.floor(WEIGHT * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in self.terms], np.int64)


def _upper(items: _Items, width: int, sizes: np.ndarray, most: np.ndarray, slices: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each item's bounds of all scores in one block."""
    m, rows = _damping(sizes, items.n, items.total), len(sizes)
    gains, present, rows_of, any_ = [], [], [], []
    before = np.zeros(rows)
    for tier in range(len(TIERS)):
        tf = np.minimum(most, TIERS[tier + 1] - 1) if tier + 1 < len(TIERS) else most
        cap = ((GAIN * tf) // (STEP * tf + DAMP * m)).astype(np.float64)
        gains.append(cap - before)
        before = cap
        # who has a term thrice has it twice, so later tiers look at what is left of the one before
        own = np.flatnonzero(any_[-1]) if tier else np.arange(len(items.terms))
        places = _bits(_keys(items.hashes[own], tier), width)
        bits = slices[places[:, 0]]
        for i in range(1, PROBES):
            bits &= slices[places[:, i]]
        row_of, there = np.full(len(items.terms), -1), np.zeros(len(items.terms), bool)
        if tier:
            bits &= present[-1][rows_of[-1][own]]
        row_of[own], there[own] = np.arange(len(own)), bits.any(axis=1)
        present.append(bits)
        rows_of.append(row_of)
        any_.append(there)
    # sums of whole weights are exact in single precision up to 2 ** 24
    kind = np.float32 if int(items.weights.max(initial=0)) * max(map(len, items.lists), default=0) < 1 << 24 else np.float64
    weights = items.weights.astype(kind)
    for k, terms in enumerate(items.lists):
        bound = np.zeros(rows)
        for tier in range(len(TIERS)):
            terms = terms[any_[tier][terms]]
            if not len(terms):
                break
            bound += gains[tier] * (weights[terms] @ np.unpackbits(present[tier][rows_of[tier][terms]], axis=1, count=rows).astype(kind))
        yield k, bound


def _bounded(blocks: DataFrame, items: _Items, k: int, edges: np.ndarray | None) -> DataFrame:
    """``(item, doc_id)`` of the k highest bounds of each task, or with ``edges`` of all bounds that reach the item's."""
    held = blocks.sparkSession.sparkContext.broadcast((items, edges))

    def rows(item, ids, bounds) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item), pa.int32()), pa.array(ids, pa.int64()), pa.array(bounds, pa.float64())], ["item", "doc_id", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, edges = held.value
        best = {}
        for batch in batches:
            for row in range(batch.num_rows):
                width, ids = batch.column(0)[row].as_py(), batch.column(1)[row].values
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                sizes, most = batch.column(2)[row].values.to_numpy(), batch.column(3)[row].values.to_numpy()
                slices = np.frombuffer(batch.column(4)[row].as_buffer(), np.uint8).reshape(width, -1)
                for item, bound in _upper(items, width, sizes, most, slices):
                    if edges is not None:
                        at = np.flatnonzero(known & (bound >= edges[item]))
                        if len(at):
                            yield rows(item, ids[at], bound[at])
                        continue
                    has = best.get(item)
                    at = np.flatnonzero(known & (bound > (has[1].min() if has and len(has[1]) >= k else 0)))
                    if len(at):
                        of, b = (np.concatenate([has[0], ids[at]]), np.concatenate([has[1], bound[at]])) if has else (ids[at], bound[at])
                        top = np.argsort(-b, kind="stable")[:k]
                        best[item] = of[top], b[top]
        for item, (of, b) in best.items():
            yield rows(item, of, b)

    return blocks.where("width > 0").select("width", "ids", "sizes", "most", "slices").mapInArrow(run, "item int, doc_id long, bound double")


def _scored(docs: DataFrame, pairs: DataFrame, items: _Items) -> DataFrame:
    """``(item, doc_id, score)``: the exact scores above 0 of ``pairs``, from the documents' texts."""
    held = docs.sparkSession.sparkContext.broadcast(items)
    asked = stored(pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "ranked-asked")  # as many items as are sent
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    if asked.count() <= SENT:
        met = texts.join(F.broadcast(asked), "doc_id")
    else:
        # only texts that may be asked for are shuffled; the join then tells
        bits = 27
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
        seen = docs.sparkSession.sparkContext.broadcast(np.frombuffer(bitmap(asked.select(place.alias("p")), "p", bits), np.uint8))

        def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = batch.column(2).to_numpy()
                yield batch.select([0, 1]).filter(pa.array((seen.value[p >> 3] >> (p & 7) & 1).astype(bool)))

        met = texts.withColumn("p", place).mapInArrow(may, "doc_id long, text binary").join(asked, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = held.value
        for batch in batches:
            out = ([], [], [])
            for doc_id, text, asks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                tf = terms_of(text.as_py())
                if not tf:
                    continue
                m = BASE - PULL + PULL * sum(tf.values()) * it.n // it.total
                for item in asks:
                    score = 0
                    for t in it.lists[item].tolist():
                        n = tf.get(it.terms[t])
                        if n:
                            score += int(it.weights[t]) * (GAIN * n // (STEP * n + DAMP * m))
                    if score > 0:
                        for to, x in zip(out, (item, doc_id, score), strict=True):
                            to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["item", "doc_id", "score"])

    return met.select("doc_id", "text", "items").mapInArrow(run, "item int, doc_id long, score long")


def _pairs(asked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item_id, term)`` of all items, each once."""
    rows = asked.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                terms = list(terms_of(batch.column(1)[row].as_py()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(terms), pa.int64())), pa.array(terms, pa.binary())], ["item_id", "term"])

    return rows.mapInArrow(run, f"item_id {kind}, term binary").distinct()


def search(docs: DataFrame, asked: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of each item with the highest scores above 0; equal scores by id."""
    spark, texts = docs.sparkSession, ids_and_texts(docs, id_col, text_col)
    pairs = stored(_pairs(asked, item_col, item_text), "ranked-pairs")
    rounds = max(1, -(-pairs.count() // MOST_PAIRS))
    blocks, found = None, None
    for nth in range(rounds):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == nth).toArrow()  # about MOST_PAIRS
        wanted = list(zip(mine["item_id"].to_pylist(), mine["term"].to_pylist(), strict=True))
        watched = sorted({t for _, t in wanted})
        if blocks is None:
            blocks = index(texts, watched)
            n, total = totals(blocks)
            df = _frequencies(blocks)
        else:
            df = _frequencies(_scan(texts, watched, False))
        items = _Items(wanted, df, n, total)
        out = _answers(texts, blocks, items, k)
        names = spark.createDataFrame(list(enumerate(items.names)), f"item int, item_id {pairs.schema['item_id'].dataType.simpleString()}")
        out = out.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = out if found is None else found.unionByName(out)
    discard(blocks)
    return found


def _top(scores: DataFrame, k: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
    return scores.withColumn("rank", at).where(F.col("rank") <= k)


def _answers(texts: DataFrame, blocks: DataFrame, items: _Items, k: int) -> DataFrame:
    """``(item, doc_id, score, rank)`` of one round of items, stored."""
    at = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "doc_id"))
    first = _bounded(blocks, items, FIRST * k, None).withColumn("at", at).where(F.col("at") <= FIRST * k).select("item", "doc_id")
    reached = _top(_scored(texts, first, items), k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("edge")).collect()  # a row an item
    edges = np.ones(len(items.names))
    for row in reached:
        if row.n >= k:
            edges[row.item] = row.edge
    alive = _bounded(blocks, items, k, edges).select("item", "doc_id")
    return stored(_top(_scored(texts, alive, items), k), "ranked-answers")
