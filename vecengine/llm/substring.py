"""Substring dedup by seed and extend.

Words are hashed, and each window of LENGTH words is given an anchor, the least hash of the runs
of SEED words in it (winnowing), so equal windows have equal anchors at equal places.  Anchors
that occur in two different documents are seeds.  An occurrence of a seed is joined with the
seed's first occurrence, in the document with the least id, and the match is extended word by
word to both sides; runs of at least LENGTH words are repeats.  Windows that differ from the first
occurrence are matched among themselves, by their anchor and the words around it.  Overlapping
repeats are joined into maximal ones, and those are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, claim, discard, free_name, ids_and_texts, map_texts, stored

LENGTH, SEED = 13, 5
#: log2 of the bits of the filters of documents (2 MB, whatever the data), and of the seeds' filter
#: at least and at most (8 to 64 MB, by the number of seeds).  A filter that the data outgrow lets
#: more rows through; results stay the same.
DOC_BITS, LEAST_BITS, MOST_BITS = 24, 26, 29
#: Bytes of text that a kernel takes at once: its arrays are a few dozen times as large.
SLICE = 2 << 20
#: Distinct words whose hashes a kernel keeps at once.
KEPT_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_HASHES = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each run of ``n`` of the hashed words; the last n - 1 places hold what is of no use."""
    out = np.zeros_like(h)
    out[: len(h) - n + 1] = h[: len(h) - n + 1]
    for j in range(1, n):
        out[: len(h) - n + 1] = out[: len(h) - n + 1] * np.uint64(base) + h[j : len(h) - n + 1 + j]
    return _mixed(out)


class Windows:
    """The windows of a slice of texts: each one's text (``row``) and start, its anchor and the anchor's place in the text."""

    def __init__(self, texts: list[str | None], length: int, seed: int):
        claim("substring", _HASHES.clear)
        if len(_HASHES) > KEPT_WORDS:
            _HASHES.clear()
        cut = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        counts = np.array([len(w) for w in cut], np.int64)
        self.h = np.fromiter((h for words in cut for h in map(_HASHES.__getitem__, words)), np.uint64, int(counts.sum()))
        self.firsts, self.counts = np.cumsum(counts) - counts, counts
        row = np.repeat(np.arange(len(texts)), counts)
        start = np.arange(len(row)) - self.firsts[row]
        at = np.flatnonzero(start <= counts[row] - length)
        self.row, self.start = row[at], start[at]
        self.anchor, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(at):
            least, where, width, span = _rolled(self.h, seed, 0x9E3779B97F4A7C15), np.arange(len(self.h), dtype=np.int32), 1, length - seed + 1
            while width < span:  # of equal hashes the first
                step = min(width, span - width)
                later = least[step:] < least[:-step]
                nxt, place = least.copy(), where.copy()
                nxt[:-step][later], place[:-step][later] = least[step:][later], where[step:][later]
                least, where, width = nxt, place, width + step
            self.anchor = _mixed(least[at])  # a least hash is small; mixed, its high bits are even again
            self.place = where[at] - self.firsts[self.row]

    def runs(self) -> np.ndarray:
        """The first of each run of windows that have one anchor at one place."""
        new = np.ones(len(self.row), bool)
        new[1:] = (self.place[1:] != self.place[:-1]) | (self.row[1:] != self.row[:-1])
        return np.flatnonzero(new)

    def around(self, row: np.ndarray, place: np.ndarray, seed: int, span: int) -> np.ndarray:
        """The hashes of the ``span`` words before (nearest first) and behind each anchor, 32 bits each, 0 where there is none."""
        steps = np.concatenate([-1 - np.arange(span), seed + np.arange(span)])
        at = place[:, None] + steps
        there = (at >= 0) & (at < self.counts[row][:, None])
        words = (self.h[np.where(there, at + self.firsts[row][:, None], 0)] >> np.uint64(32)).astype(np.uint32)
        return np.where(there, np.maximum(words, 1), 0).astype(np.uint32).view(np.int32)


def _has(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _held(batch: pa.RecordBatch, bits: int, found: bytes) -> pa.RecordBatch:
    """The rows of (doc_id, text) whose hashed id is in a bitmap; the others' texts go no further."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return batch.filter(pa.array(_has(np.frombuffer(found, np.uint8), _mixed(ids) >> np.uint64(64 - bits))))


def _id_bits(ids: DataFrame, bits: int) -> bytes:
    """The bitmap of the hashed ``doc_id`` that :func:`_held` asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((_mixed(x) >> np.uint64(64 - bits)).view(np.int64))], ["b"])

    return bitmap(ids.select("doc_id").mapInArrow(run, "b long"), "b", bits)


def _marks(texts: list[bytes]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64))


def mark_of(text_col: str) -> Column:
    """The mark of a row's text, as a column; with the id it tells a row from others of one id."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _summaries(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, whole, mark)`` of every row.

    whole is the SHA-256 of its words joined by one space, mark the XXH64 of its text, as
    ``xxhash64`` gives it.
    """

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        cut = [t.split() for t in raw]
        told = [pa.array([len(w) for w in cut], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in cut]), _marks(raw)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *told], ["doc_id", "n_words", "whole", "mark"])

    return map_texts(docs, kernel, "doc_id long, n_words long, whole string, mark long")


def _repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n_words, whole, mark, copy)`` of every row, and ``(doc_id, mark, runs)`` of those with repeats.

    copy tells that the same words make up a row with a smaller id, so all its windows occur
    there; ``runs`` lists the runs ``(m0, m1)`` of the other rows' windows that occur in a smaller id,
    by the starts of their first and last window.
    Rows of one id never make each other repeats, a null id is neither smaller nor larger than
    any, and a null text has no words.  An empty table gives empty results.
    """
    source = ids_and_texts(docs, id_col, text_col)
    sc = docs.sparkSession.sparkContext
    rows = stored(_summaries(source), "substring-rows")
    firsts = rows.groupBy("whole").agg(F.min("doc_id").alias("first"))
    told = rows.join(firsts, "whole").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    told = stored(told.drop("first"), "substring-copies")
    # windows of a copy are those of its first; leaving copies out keeps the rest's ids the least
    known = source.where("doc_id IS NOT NULL")
    reps = sc.broadcast(_id_bits(told.where("NOT copy AND doc_id IS NOT NULL"), DOC_BITS))

    def anchors(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = _held(batch, DOC_BITS, reps.value)
        w = Windows(batch.column(1).to_pylist(), length, seed)
        first = w.runs()
        yield pa.RecordBatch.from_arrays([pa.array(w.anchor[first].view(np.int64)), batch.column(0).take(pa.array(w.row[first]))], ["a", "doc_id"])

    spread = map_texts(known, anchors, "a long, doc_id long", SLICE).groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = stored(spread.where("lo < hi").select("a"), "substring-seeds")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * shared.count()).bit_length()))
    seeds = sc.broadcast(bitmap(shared.select(F.shiftrightunsigned("a", 64 - bits).alias("b")), "b", bits))
    span = length - seed

    def occurrences(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = _held(batch, DOC_BITS, reps.value)
        texts = batch.column(1).to_pylist()
        w = Windows(texts, length, seed)
        first = w.runs()
        last = np.append(first[1:], len(w.row))[: len(first)] - 1
        found = _has(np.frombuffer(seeds.value, np.uint8), w.anchor[first] >> np.uint64(64 - bits)) if len(first) else np.zeros(0, bool)
        first, last = first[found], last[found]
        marks = _marks([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        for lo in range(0, len(first), 50_000):
            f, t = first[lo : lo + 50_000], last[lo : lo + 50_000]
            row, place = w.row[f], w.place[f]
            words = w.around(row, place, seed, span)
            lists = pa.ListArray.from_arrays(np.arange(0, words.size + 1, 2 * span, dtype=np.int32), pa.array(words.ravel()))
            numbers = [pa.array(x.astype(np.int32)) for x in (place, w.start[f], w.start[t])]
            columns = [pa.array(w.anchor[f].view(np.int64)), batch.column(0).take(pa.array(row)), marks.take(pa.array(row)), *numbers, lists]
            yield pa.RecordBatch.from_arrays(columns, ["a", "doc_id", "mark", "place", "s0", "s1", "words"])

    kind = "a long, doc_id long, mark long, place int, s0 int, s1 int, words array<int>"
    seen = stored(map_texts(known, occurrences, kind, SLICE), "substring-occurrences")
    lead = stored(seen.groupBy("a").agg(F.min(F.struct("doc_id", "mark", "place", "words")).alias("y"), F.max("doc_id").alias("hi")).where("y.doc_id < hi").select("a", "y"), "substring-leaders")

    def equal(at: int) -> str:
        """SQL: how many words agree from place ``at`` of the words around."""
        out = str(span)
        for k in reversed(range(span)):
            out = f"if(words[{at + k}] <> y.words[{at + k}], {k}, {out})"
        return out

    # windows from s0 to s1 hold the seed; those from m0 to m1 also agree with the first occurrence
    met = seen.join(lead, "a").where("doc_id <> y.doc_id OR mark <> y.mark OR place <> y.place")
    met = met.withColumns({"left": F.expr(equal(0)), "right": F.expr(equal(span))})
    met = met.withColumns({"m0": F.expr("if(doc_id <> y.doc_id, greatest(s0, place - left), s1 + 1)"), "m1": F.expr(f"least(s1, place - {span} + right)")})
    met = met.selectExpr("a", "doc_id", "mark", "place", "s0", "s1", "words", "if(m0 <= m1, m0, s1 + 1) AS m0", "if(m0 <= m1, m1, s1) AS m1")
    met = stored(met.withColumn("words", F.expr("if(s0 < m0 OR m1 < s1, words, null)")), "substring-extended")
    direct = met.where("m0 <= m1").select("doc_id", "mark", "m0", "m1")
    # the other windows, by the seed and the words around it
    rest = met.where("words IS NOT NULL").selectExpr("a", "doc_id", "mark", "place", "words", "explode(filter(sequence(s0, s1), s -> s < m0 OR s > m1)) AS s")
    around = f"concat(slice(words, 1, place - s), slice(words, {span + 1}, {span} - (place - s)))"
    rest = rest.selectExpr("a", f"xxhash64(place - s, {around}) AS w", "doc_id", "mark", "s")
    least = stored(rest.groupBy("a", "w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "substring-least")
    indirect = rest.join(least, ["a", "w"]).where("doc_id > lo").selectExpr("doc_id", "mark", "s AS m0", "s AS m1")
    found = direct.union(indirect).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("m0", "m1"))).alias("runs"))
    found = stored(found, "substring-hits")
    discard(rows, shared, seen, lead, met, least)
    return told, found


def maximal(n: int, runs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The maximal repeats of a text of ``n`` words, as first words and ends, and which words they cover.

    ``runs`` has the first and the last window of each run of repeated windows.
    """
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0], 1)
    np.add.at(edges, runs[:, 1] + length, -1)
    gone = np.cumsum(edges[:n]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
    return turns.reshape(-1, 2), gone


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row, and ``kept``, the text that is left.

    A word is removed if a window of ``length`` words that covers it also starts in a row with a
    smaller id.  kept_sha256 is that of the kept words joined by one space.  ``kept`` is null for
    a row that loses nothing (its text stays as it is), else the kept words joined by one space.
    See the module's notes for nulls and repeated rows.  Texts travel only for rows that lose a part.
    """
    told, found = _repeats(docs, id_col, text_col, length, seed)
    source = ids_and_texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    some = docs.sparkSession.sparkContext.broadcast(_id_bits(found, DOC_BITS))
    partly = map_texts(source, lambda batch: [_held(batch, DOC_BITS, some.value)], "doc_id long, text string").withColumn("mark", mark_of("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, removed, left = [], [], []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                words = (text or "").encode().split()
                spans = runs.values
                _, gone = maximal(len(words), np.stack([spans.field(0).to_numpy(), spans.field(1).to_numpy()], axis=1), length)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                shas.append(hashlib.sha256(kept).hexdigest())
                removed.append(int(gone.sum()))
                left.append(kept.decode())
            columns = [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(shas), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n_removed", "kept_sha256", "kept"])

    # rows that repeat in full are cut once
    once = partly.dropDuplicates(["doc_id", "mark"]).join(found, ["doc_id", "mark"]).select("doc_id", "mark", "text", "runs")
    parts = once.mapInArrow(run, "doc_id long, mark long, n_removed long, kept_sha256 string, kept string")
    none = F.col("n_words") < length
    gone = F.col("copy") & ~none
    return told.join(parts, ["doc_id", "mark"], "left").select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        "mark",
    )


def parted(docs: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: the rows whose id may be among the ``doc_id`` of ``ids`` or is null, and the others.

    A filter of fixed size tells them; neither part is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(_id_bits(ids.where("doc_id IS NOT NULL"), DOC_BITS))
    column = docs.columns.index(id_col)

    def only(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(held.value, np.uint8)
            for batch in batches:
                own = batch.column(column).cast(pa.int64())
                found = _has(bits, _mixed(own.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - DOC_BITS))
                found |= own.is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(found == wanted))

        return docs.mapInArrow(run, docs.schema)

    return only(True), only(False)


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed words taken out of the texts; other rows and columns stay as they are.

    Nulls, repeated rows and empty tables are as in :func:`cut`.  Only rows whose id may have a cut
    are shuffled; a filter of fixed size tells them.
    """
    cuts = cut(docs, id_col, text_col).where("kept IS NOT NULL").select("doc_id", "mark", "kept")
    cuts = stored(cuts.dropDuplicates(["doc_id", "mark"]), "substring-cuts")
    maybe, rest = parted(docs, id_col, cuts)
    key, mark, kept = (free_name(docs, n) for n in ("cut_id", "cut_mark", "cut_text"))
    same = (F.col(id_col).cast("long") == F.col(key)) & (mark_of(text_col) == F.col(mark))
    joined = maybe.join(cuts.toDF(key, mark, kept), same, "left").withColumn(text_col, F.coalesce(kept, text_col))
    return rest.unionByName(joined.select(*docs.columns))
