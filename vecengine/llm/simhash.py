"""SimHash near-duplicate groups, found by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves.  Of two fingerprints that differ in at most two
bits, one half differs in at most one bit, so both hold the same half once that bit is taken out.
Each fingerprint is indexed by all 64 variants of a half with one bit taken out; an equality join
on the variant proposes pairs, and the whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, map_texts, stored
from .components import connected_components

#: Buckets of at most so many fingerprints are joined pair by pair; larger ones are cut further.
PAIRED = 64


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text, over shingles of ``size`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    hashed, n = xxhash.xxh64_intdigest, len(words) - k + 1
    cuts = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.fromiter((hashed(line[a:b], seed) for a, b in cuts), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint as a signed long."""

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.array([fingerprint(t, size, seed) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_texts(ids_and_texts(docs, id_col, text_col), kernel, "doc_id long, fp long")


def _without(half: str, i: str) -> str:
    """SQL for 32-bit ``half`` with bit ``i`` taken out."""
    return f"((shiftright({half}, {i} + 1) * shiftleft(1L, {i})) | ({half} & (shiftleft(1L, {i}) - 1)))"


def variants(fps: DataFrame) -> DataFrame:
    """``(sig, fp)``: the 64 one-wildcard variants of each fingerprint's halves.

    ``sig`` holds the wildcard's place (0 to 31 in the low half, 32 to 63 in the high half) above
    the 31 bits that remain.
    """
    half = "(if(w < 32, fp & 4294967295L, shiftrightunsigned(fp, 32)))"
    return fps.selectExpr("fp", "explode(sequence(0, 63)) AS w").selectExpr(
        f"(cast(w AS long) * 2147483648L) | {_without(half, '(w % 32)')} AS sig", "fp"
    )


def _canonical() -> str:
    """True for one of the variants that two fingerprints at most two bits apart share.

    That is the first half that differs in at most one bit, with the wildcard on that bit (or on
    the half's lowest bit if the halves are equal).
    """
    x = "(a.fp ^ b.fp)"
    low, high = f"({x} & 4294967295L)", f"shiftrightunsigned({x}, 32)"
    w = "cast(shiftright(a.sig, 31) AS int)"
    at = f"if(bit_count({low}) <= 1, if({low} = 0, 0, bit_count({low} - 1)), 32 + if({high} = 0, 0, bit_count({high} - 1)))"
    return f"{w} = {at}"


def links(fps: DataFrame) -> DataFrame:
    """``(u, v)``: edges between distinct fingerprints whose components are those of all links.

    ``fps`` has one row a fingerprint.  Members of a bucket of up to PAIRED fingerprints are
    compared pair by pair.  In a larger bucket a second bit is taken out, of the whole
    fingerprint: those that then agree differ in at most two bits, and each is linked to the
    least of them, so no bucket costs more than its size times a constant.

    Spark takes an exploded table to be as large as the one before, and would send 64 rows a
    fingerprint through the driver; hints keep the joins shuffled.
    """
    sigs = variants(fps)
    counted = sigs.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(sigs.hint("merge").join(counted, "sig").select("sig", "fp", "n"), "simhash-buckets")
    small = rows.where(F.col("n") <= PAIRED).select("sig", "fp")
    pairs = (
        small.alias("a")
        .hint("merge")
        .join(small.alias("b"), F.expr(f"a.sig = b.sig AND a.fp < b.fp AND bit_count(a.fp ^ b.fp) <= 2 AND {_canonical()}"))
        .selectExpr("b.fp AS u", "a.fp AS v")
    )
    hot = rows.where(F.col("n") > PAIRED).selectExpr("cast(shiftright(sig, 31) AS int) AS w", "fp")
    # one wildcard w and any other bit; where the half is equal (w is its lowest bit), also any two of the other half
    one = "transform(sequence(0, 63), j -> struct(w AS i, j AS j))"
    other = "if(w = 0, 32, 0)"
    two = f"flatten(transform(sequence({other}, {other} + 30), i -> transform(sequence(i + 1, {other} + 31), j -> struct(i AS i, j AS j))))"
    cut = hot.selectExpr("fp", f"explode(if(w % 32 = 0, concat({one}, {two}), {one})) AS p").selectExpr(
        "fp", "least(p.i, p.j) * 64 + greatest(p.i, p.j) AS ij", "fp & ~(shiftleft(1L, p.i) | shiftleft(1L, p.j)) AS rest"
    )
    cut = cut.distinct()
    first = cut.groupBy("ij", "rest").agg(F.min("fp").alias("m"), F.count("*").alias("k")).where("k > 1")
    stars = cut.hint("merge").join(first, ["ij", "rest"]).where("fp <> m").selectExpr("fp AS u", "m AS v").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row.

    Documents are linked where their fingerprints differ in at most two bits; component_id is the
    least id reachable over links.  Null and empty texts have fingerprint zero and are linked like
    any other; a null id is never the least one, and a component of null ids only has a null
    component_id.  Equal fingerprints are one node, however many rows have them; repeated rows
    stay.  An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col, size, seed), "simhash-fp")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.hint("merge").join(placed.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
