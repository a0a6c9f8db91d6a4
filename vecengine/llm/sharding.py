"""Reproducible shuffle into shards by a Feistel permutation over row numbers.

DataFrame functions only.  A row's number is its rank by id.  A Feistel network over pairs
(left, right) with ``left < a`` and ``right < b``, ``a * b >= n``, permutes ``0 .. a * b - 1``;
cycle walking (apply it again while the result is ``n`` or more) makes it a permutation of
``0 .. n - 1``.  The permuted number p gives shard ``p % shards`` and slot ``p // shards``, so
counts differ by at most one and slots have no gaps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

ROUNDS = 6


def _domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int) -> Column:
    """One application of the network to ``x``, over the least domain that holds ``n``."""
    a, b = _domain(n)

    def turn(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        to_left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), i, right), F.lit(a)), F.lit(a))
        to_right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), i, left), F.lit(b)), F.lit(b))
        even = i % 2 == 0
        return F.struct(F.when(even, to_left).otherwise(left).alias("l"), F.when(even, right).otherwise(to_right).alias("r"))

    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    start = F.struct(F.expr("0L").alias("l"), F.expr("0L").alias("r")) if n == 0 else start
    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(number: Column, n: int, seed: int) -> Column:
    """Where the permutation of ``0 .. n - 1`` puts ``number``.

    The domain exceeds n by less than its square root, so few rows walk, and none walks further
    than that excess.
    """
    a, b = _domain(n)
    first = feistel(number, n, seed)
    if a * b <= n:
        return first
    again = F.aggregate(
        F.sequence(F.lit(1), F.lit(a * b - n)), first, lambda y, _: F.when(y < F.lit(n), y).otherwise(feistel(y, n, seed))
    )
    return F.when(first < F.lit(n), first).otherwise(again)


def row_numbers(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with a gapless long ``row_no`` from 0 by ``order`` (nulls first), and the count.

    Rows are dealt out by range and sorted, and each is kept with its part and place.  A part's
    first number is the sum of the sizes of the parts before it: one row a part, broadcast.
    """
    place = F.monotonically_increasing_id()
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place)
    parts = checkpoint(parts)
    part = F.shiftright("__at", 33)
    sizes = sorted((r[0], r[1]) for r in parts.groupBy(part).count().collect())
    firsts, n = [], 0
    for k, size in sizes:
        firsts.append((k, n))
        n += size
    offsets = df.sparkSession.createDataFrame(firsts, "__part long, __first long")
    numbered = parts.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    at = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("row_no", F.col("__first") + at).drop("__at", "__part", "__first"), n


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """``(doc_id, size, text_crc32, row_no, position, shard, slot)`` for every row, by law ``rows``.

    size is the text's UTF-8 length (null: 0) plus 8; text_crc32 is that of the text (null: of no
    bytes).  Rows are numbered by id (nulls first), then checksum and size; repeated rows get
    numbers of their own.  An empty table gives an empty result.  Equal ids, texts and seed give
    the same shards whatever the partitioning.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = row_numbers(rows, ["doc_id", "text_crc32", "size"])
    placed = numbered.withColumn("position", permuted(F.col("row_no"), n, seed))
    return placed.withColumns(
        {"shard": (F.col("position") % shards).cast("int"), "slot": F.floor(F.col("position") / F.lit(shards)).cast("long")}
    )
