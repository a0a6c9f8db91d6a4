"""Groups of texts whose word shingles are alike, found by deletion-variant signatures of a SimHash.

Two texts alike to 0.8 over shingles of five words differ in more bits than a guarantee over two
halves can span.  So a longer fingerprint is cut into SEGMENTS segments of BITS bits, few enough
bits that one segment of like texts mostly differs in one bit at most, and each segment is indexed
by its variants with one bit taken out: those bits whose margin is least, since they are the ones
that flip.  The fingerprint is over shingles of two words, of which like texts share more than of
five.  An equality join on the variants proposes pairs; a sketch of least hashes and the sizes
sort out most of them, and the rest have their sets of hashed shingles compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, claim, discard, free_name, ids_and_texts, map_texts, stored
from .components import connected_components
from .substring import _has, _mixed, _rolled, mark_of

#: Segments of the indexed fingerprint, bits of each, and how many of a segment's bits are taken out in turn.
SEGMENTS, BITS, UNSURE = 24, 28, 4
#: Bins of the sketch of least hashes (four bits each), and the standard errors that an estimate may be too low.
BINS, MARGIN = 256, 3
#: Members of a block of a large bucket.
BLOCK = 256
#: log2 of the bits of the filter of texts whose shingles are compared (2 MB, whatever the number of texts).
ASKED_BITS = 24
#: Bytes of text that a kernel takes at once, and distinct words whose hashes it keeps.
SLICE, KEPT_WORDS = 1 << 20, 300_000

_LANES = np.uint64(0x0101010101010101)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 5)
        return h


_HASHES = _Hashes()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts end to end, A-Z as a-z, and how many words each text has."""
    claim("likeness", _HASHES.clear)
    if len(_HASHES) > KEPT_WORDS:
        _HASHES.clear()
    cut = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(w) for w in cut], np.int64)
    return np.fromiter((h for words in cut for h in map(_HASHES.__getitem__, words)), np.uint64, int(counts.sum())), counts


def shingle_hashes(h: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of ``size`` words; of a shorter text, that of the whole."""
    out, at = [], 0
    for n in counts.tolist():
        own = h[at : at + n]
        at += n
        k = min(size, n)
        if n:
            own = np.sort(_rolled(own, k, 0x9E3779B97F4A7C15 + 2 * k)[: n - k + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        out.append(own)
    return out


def bit_margins(sets: list[np.ndarray], words: int) -> np.ndarray:
    """For each set and each of ``64 * words`` bits, how many more hashes have the bit set than not.

    Bits are added eight to a long, in lanes of eight bits, at most 255 hashes at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), words * 64), np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h, n = np.concatenate(sets), sizes[full]
    parts = -(-n // 255)
    heads = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(n) - n, parts) + 255 * (np.arange(parts.sum()) - np.repeat(heads, parts))
    counts = np.empty((len(starts), 8, 8), np.int64)
    for w in range(words):
        x = _mixed(h + np.uint64((w + 1) * 0xD1342543DE82EF95 & (2**64 - 1)))
        for k in range(8):
            counts[:, :, k] = np.add.reduceat((x >> np.uint64(k)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
        out[full, 64 * w : 64 * w + 64] = 2 * np.add.reduceat(counts.reshape(-1, 64), heads, axis=0) - n[:, None]
    return out


def segment_codes(margins: np.ndarray) -> np.ndarray:
    """``SEGMENTS`` longs a text: a segment's bits, and above them the places of its UNSURE bits of least margin."""
    m = margins[:, : SEGMENTS * BITS].reshape(len(margins), SEGMENTS, BITS)
    value = ((m > 0) << np.arange(BITS, dtype=np.int64)).sum(axis=2)
    low = np.argsort(np.abs(m), axis=2, kind="stable")[:, :, :UNSURE].astype(np.int64)
    return value | (low << (BITS + 5 * np.arange(UNSURE))).sum(axis=2)


def least_sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A nibble for each of BINS ranges of hashes: 1 to 15 by the least hash in it, 0 if there is none.

    The nibbles are kept as four planes of BINS bits, lowest first.
    """
    out = np.zeros((len(sets), BINS), np.uint8)
    for k, s in enumerate(sets):
        if len(s):
            bins = (s >> np.uint64(56)).astype(np.int64)
            first = np.concatenate(([True], bins[1:] != bins[:-1]))
            out[k, bins[first]] = 1 + (s[first] & np.uint64(0xFFFFFF)) % np.uint64(15)
    planes = [np.packbits((out >> p) & 1, axis=1, bitorder="little") for p in range(4)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """``(doc_id, s1, s2, n, codes, sketch, mark)`` of every row.

    ``s1`` and ``s2`` are hashes of the text's set of shingles (texts of one set are one node),
    ``n`` the number of shingles, ``codes`` the segments of the indexed fingerprint, ``sketch``
    the least hashes by bin and ``mark`` the text's own hash.  A text without words has zeros.
    """

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        h, counts = word_hashes(texts)
        sets = shingle_hashes(h, counts, size)
        codes = segment_codes(bit_margins(shingle_hashes(h, counts, 2), -(-SEGMENTS * BITS // 64)))
        codes[counts == 0] = 0
        one = [int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
        two = [int(_mixed(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
        marks = [xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), 42) for t in texts]
        lists = [pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel())) for a in (codes, least_sketch(sets))]
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two, marks)]
        numbers = pa.array([len(s) for s in sets], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), longs[0], longs[1], numbers, *lists, longs[2]], ["doc_id", "s1", "s2", "n", "codes", "sketch", "mark"])

    kind = "doc_id long, s1 long, s2 long, n int, codes array<long>, sketch array<long>, mark long"
    return map_texts(ids_and_texts(docs, id_col, text_col), kernel, kind, SLICE)


def signatures(nodes: DataFrame) -> DataFrame:
    """``(node, sig)``: the one-wildcard variants of each node's segments, as ``place, wildcard, remaining bits``."""
    spread = nodes.selectExpr("node", "posexplode(codes) AS (k, c)").selectExpr("node", "k", "c", f"explode(sequence(0, {UNSURE - 1})) AS j")
    spread = spread.selectExpr("node", "k", f"c & {(1 << BITS) - 1}L AS v", f"cast(shiftright(c, {BITS} + 5 * j) & 31 AS int) AS w")
    rest = "((shiftright(v, w + 1) * shiftleft(1L, w)) | (v & (shiftleft(1L, w) - 1)))"
    return spread.selectExpr("node", f"(cast(k AS long) * 32 + w) * {1 << (BITS - 1)}L | {rest} AS sig").distinct()


def _may_be_alike(a: str, b: str, similarity: float) -> str:
    """SQL: whether two nodes' sizes and sketches leave it open that they are alike to ``similarity``.

    Of the m bins that either fills, those that differ are held against their number in texts alike
    to ``similarity``: the bins are a sample without replacement of the union of both sets, which
    then has (a.n + b.n) / (1 + similarity) members, and of two members one in 15 looks equal.
    """
    words, planes = range(BINS // 64), range(4)
    of = lambda x, w: [f"{x}.sketch[{BINS // 64 * p + w}]" for p in planes]
    both = " + ".join(f"bit_count({' | '.join(of(a, w) + of(b, w))})" for w in words)
    other = " + ".join(f"bit_count({' | '.join(f'({x} ^ {y})' for x, y in zip(of(a, w), of(b, w), strict=True))})" for w in words)
    drawn = f"{similarity * (1 - similarity)} * greatest(0, 1 - ({both}) * {1 + similarity} / ({a}.n + {b}.n))"
    enough = f"({other}) <= {(1 - similarity) * 14 / 15} * ({both}) + {MARGIN} * sqrt(({both}) * ({drawn} + {(1 - similarity) * 14 / 225})) + 1"
    return f"least({a}.n, {b}.n) >= {similarity} * greatest({a}.n, {b}.n) - 1e-6 AND {enough}"


def shingle_sets(docs: DataFrame, marks: DataFrame, text_col: str = "text", size: int = 5) -> DataFrame:
    """``(mark, shingles)``: the hashed distinct shingles of the texts whose ``mark`` is in ``marks``, one row a text.

    Texts pass a filter of fixed size before they are cut into shingles, so that the others are not shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(bitmap(marks.selectExpr(f"shiftrightunsigned(mark, {64 - ASKED_BITS}) AS b"), "b", ASKED_BITS))

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        marks = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        batch = batch.filter(pa.array(_has(np.frombuffer(held.value, np.uint8), marks >> np.uint64(64 - ASKED_BITS))))
        sets = shingle_hashes(*word_hashes(batch.column(1).to_pylist()), size)
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        values = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, values)], ["mark", "shingles"])

    found = map_texts(docs.select(mark_of(text_col).alias("mark"), F.col(text_col).alias("text")), kernel, "mark long, shingles array<long>", SLICE)
    return found.join(marks.select("mark").distinct(), "mark", "left_semi").dropDuplicates(["mark"])


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, size: int, similarity: float) -> DataFrame:
    """The ``(u, v)`` of stored ``pairs`` whose sets of shingles have ``similarity`` of their union in common, stored."""
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = stored(nodes.select("node", "mark").join(asked, "node", "left_semi"), "likeness-asked")
    sets = stored(wanted.join(shingle_sets(docs, wanted, text_col, size), "mark").select("node", "shingles"), "likeness-shingles")
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    links = both.where(f"size(array_intersect(a, b)) * {1 + similarity} >= {similarity} * (size(a) + size(b)) - 1e-6").select("u", "v")
    links = stored(links, "likeness-links")
    discard(wanted, sets, pairs)
    return links


def _nearest_leaders(rows: DataFrame) -> DataFrame:
    """``(u, v)``: each node v with one leader u, the member of its buckets that has most neighbours.

    A bucket's leader is the member whose buckets hold most members in all (``weight``), which in a
    family of copies is the text that they were made from, or close to it; so one row a node is
    enough to link most of a family.
    """
    led = rows.groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("x"))
    best = rows.join(led, "sig").groupBy("node").agg(F.max("x").alias("x"))
    return best.selectExpr("x.node AS u", "node AS v").where("u <> v")


def _mixed_buckets(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets of several components, with each one's ``root`` and the bucket's largest, ``main``."""
    placed = rows.join(roots, "node", "left").select("sig", "size", "weight", "node", F.coalesce("root", "node").alias("root"))
    shares = placed.groupBy("sig", "root").agg(F.count("*").alias("c"), F.max(F.struct("weight", "node")).alias("first"))
    mixed = shares.groupBy("sig").agg(F.max(F.struct("c", "root", "first")).alias("x"), F.count("*").alias("k")).where("k > 1")
    return placed.join(mixed.select("sig", F.col("x.root").alias("main"), F.col("x.first.node").alias("first")), "sig")


def _unlinked_pairs(mixed: DataFrame, few: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(u, v)`` and the stored table that they are made from: all pairs of a bucket that are of two components yet and may be alike.

    Members outside of a bucket's largest component are compared with every member of another
    component.  They are sent to all blocks of BLOCK members or so that a large bucket is dealt out in.
    """
    members = stored(mixed.withColumn("blocks", F.expr(f"cast(ceil(size / {BLOCK}) AS int)")).join(few, "node"), "likeness-mixed-buckets")
    rest = members.where("root <> main").select("*", F.expr("explode(sequence(0, blocks - 1)) AS block"))
    dealt = members.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) AS int)"))
    apart = "a.sig = b.sig AND a.block = b.block AND a.root <> b.root AND (b.root = b.main OR a.node < b.node)"
    pairs = rest.alias("a").join(dealt.alias("b"), F.expr(f"{apart} AND {_may_be_alike('a', 'b', similarity)}"))
    return pairs.selectExpr("a.node AS u", "b.node AS v").distinct(), members


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)``: groups of texts whose shingles are alike to ``similarity`` or more.

    Likeness is the share of the distinct shingles of ``size`` words (A-Z as a-z; of a shorter
    text, the whole) of both texts that they have in common.  Each node is first compared with
    one leader, and those still outside of a bucket's largest component with one node of it; then
    all pairs of a bucket are compared that are of two components yet, so none that shares a
    bucket is left out, and every link is a comparison of whole sets.  component_id
    is the least id reachable over links.  Texts without words (null, empty, blanks) are one
    group; texts of one set of shingles are one node; a null id is never the least one, and a
    group of null ids only has a null component_id; repeated rows stay; an empty table gives an
    empty result.  Several jobs run while the result is built.
    """
    told = stored(sketches(docs, id_col, text_col, size), "likeness-sketches")
    nodes = told.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.min(F.struct("mark", "n", "codes", "sketch")).alias("x"))
    nodes = stored(nodes.select("s1", "s2", "least", "x.*").withColumn("node", F.monotonically_increasing_id()), "likeness-nodes")
    sigs = signatures(nodes.where("n > 0"))
    counted = sigs.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(sigs.join(counted, "sig"), "likeness-shared")
    rows = stored(shared.join(shared.groupBy("node").agg(F.sum("size").alias("weight")), "node"), "likeness-buckets")
    discard(shared)
    few = nodes.select("node", "n", "sketch")

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(few.toDF("u", "n", "sketch").alias("a"), "u").join(few.toDF("v", "n", "sketch").alias("b"), "v")
        return both.where(_may_be_alike("a", "b", similarity)).select("u", "v")

    edges = roots = None
    past = []
    for step in ("leader", "main", "rest"):
        if step == "leader":
            asked = near(_nearest_leaders(rows))
        elif step == "main":  # those still outside of a bucket's largest component, with one of it
            asked = near(_mixed_buckets(rows, roots).where("root <> main").selectExpr("first AS u", "node AS v").distinct())
        else:
            asked, members = _unlinked_pairs(_mixed_buckets(rows, roots), few, similarity)
            past.append(members)
        asked = stored(asked, f"likeness-pairs-{step}")
        links = _alike(asked, nodes, docs, text_col, size, similarity)
        edges = edges.union(links) if edges else links
        roots = stored(connected_components(edges).select("node", "root"), f"likeness-roots-{step}")
        past += [links, roots]
    placed = nodes.join(roots, "node", "left").select("s1", "s2", "least", F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = told.select("doc_id", "s1", "s2").join(placed.join(ids, "root").select("s1", "s2", "component_id"), ["s1", "s2"]).select("doc_id", "component_id")
    found = stored(found, "likeness-groups")
    discard(told, nodes, rows, *past)
    return found


def first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is their group's least in :func:`similar_groups`.

    Of repeated rows all stay, and so do rows with a null id; all columns stay as they are.
    """
    groups = similar_groups(docs, id_col, text_col, similarity=similarity)
    key = free_name(docs, "kept_id")
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, F.col(id_col).cast("long") == F.col(key), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
