"""Scalar quantisation by dimension, and codebooks of codewords by dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Metric, l2_kernel
from .search import matrix


def train(vectors: DataFrame) -> DataFrame:
    """``(dim, lo, hi)``: the least and greatest component of each dimension, from 0."""
    parts = vectors.select(F.posexplode("v").alias("dim", "x"))
    return parts.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def bounds(trained: DataFrame) -> tuple[list[float], list[float]]:
    """The trained bounds as lists: a row a dimension goes through the driver."""
    rows = sorted(trained.collect())
    return [r.lo for r in rows], [r.hi for r in rows]


def _by_dim(v: Column, lo: list[float], hi: list[float], f) -> Column:
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    return F.transform(F.arrays_zip(v.alias("x"), array(lo).alias("lo"), array(hi).alias("hi")), lambda s: f(s["x"], s["lo"], s["hi"]))


def encode(v: Column, lo: list[float], hi: list[float]) -> Column:
    """Codes 0 to 255: the share of the range, one wider than it is, in steps of 1/256; others are clamped."""
    code = lambda x, a, b: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x - a) / (b - a + 1.0) * 256.0))).cast("smallint")
    return _by_dim(v, lo, hi, code)


def decode(codes: Column, lo: list[float], hi: list[float]) -> Column:
    return _by_dim(codes, lo, hi, lambda y, a, b: y.cast("double") * (b - a + 1.0) / 256.0 + a)


def encode_even(v: Column, lo: list[float], hi: list[float]) -> Column:
    """Codes 0 to 255 by the share of the plain range, clamped to 0 to 1, in steps of 1/255."""

    def code(x: Column, a: Column, b: Column) -> Column:
        share = F.when(b == a, F.lit(0.0)).otherwise((x - a) / (b - a))
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 255.0).cast("smallint")

    return _by_dim(v, lo, hi, code)


def decode_even(codes: Column, lo: list[float], hi: list[float]) -> Column:
    """The middle of each code's step."""
    return _by_dim(codes, lo, hi, lambda y, a, b: a + (y.cast("double") + 0.5) / 255.0 * (b - a))


def codebook_encode(vectors: DataFrame, codewords: DataFrame) -> DataFrame:
    """``(vec_id, dim, code)``: the nearest of each dimension's codewords, the lower code on a tie.

    ``codewords`` is ``(dim, code, value)``, at most 256 a dimension: a row a dimension holds them
    all, and is broadcast (its size is that of the dimensions times 256).
    """
    book = codewords.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("code", "value"))).alias("book"))
    parts = vectors.select("vec_id", F.posexplode("v").alias("dim", "x")).join(F.broadcast(book), "dim")
    apart = F.transform("book", lambda w: F.struct(F.abs(F.col("x") - w["value"]).alias("d"), w["code"].alias("code")))
    return parts.select("vec_id", F.col("dim").cast("long").alias("dim"), F.array_min(apart)["code"].cast("long").alias("code"))


def train_codebook(vectors: DataFrame, size: int, rounds: int = 8) -> DataFrame:
    """``(dim, code, value)``: one-dimensional k-means of every dimension, from its quantiles; values ascend.

    A dimension with fewer distinct values has as many codewords.
    """
    parts = vectors.select(F.posexplode("v").alias("dim", "x"))
    shares = [(i + 0.5) / size for i in range(size)]
    starts = parts.groupBy("dim").agg(F.array_sort(F.array_distinct(F.percentile_approx("x", shares, 10_000))).alias("c"))
    for _ in range(rounds):
        apart = F.transform("c", lambda c: F.struct(F.abs(F.col("x") - c).alias("d"), c.alias("c")))
        means = parts.join(F.broadcast(starts), "dim").select("dim", "x", F.array_min(apart)["c"].alias("c")).groupBy("dim", "c").agg(F.avg("x").alias("m"))
        rows = means.groupBy("dim").agg(F.array_sort(F.array_distinct(F.collect_list("m"))).alias("c")).collect()
        starts = vectors.sparkSession.createDataFrame(rows, "dim int, c array<double>")  # dimensions times size
    return starts.select("dim", F.posexplode("c").alias("code", "value"))


def product_tables(vectors: DataFrame, codewords: DataFrame, parts: int, metric) -> DataFrame:
    """``(vec_id, part, code, score)``: each sub-vector of ``vectors`` against the codewords of its part.

    ``codewords`` is ``(part, code, w)``: a bounded codebook, joined on the part.
    """
    width = F.size("v") / parts
    cut = vectors.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", (p * width + 1).cast("int"), width.cast("int")))).alias("part", "s"))
    return cut.join(F.broadcast(codewords), "part").select("vec_id", F.col("part").cast("long").alias("part"), F.col("code").cast("long").alias("code"), metric(F.col("s"), F.col("w")).alias("score"))


def errors(vectors: DataFrame, lo: list[float], hi: list[float]) -> DataFrame:
    """``(vec_id, err)``: the squared distance of each vector from what its codes decode to."""
    from ..functions.vectors import l2_sq

    return vectors.select("vec_id", l2_sq(F.col("v"), decode(encode(F.col("v"), lo, hi), lo, hi)).alias("err"))


def table_of(codewords: DataFrame) -> np.ndarray:
    """A codebook ``(dim, code, value)`` as a row a dimension, at most 256 values each; shorter rows end in infinities."""
    rows = codewords.select("dim", "code", "value").collect()  # dimensions times 256
    table = np.full((max(r.dim for r in rows) + 1, max(r.code for r in rows) + 1), np.inf)
    for r in rows:
        table[r.dim, r.code] = r.value
    return table


def nearest_codes(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The nearest codeword of every component, the lower code on a tie; codewords ascend."""
    with np.errstate(invalid="ignore"):
        middles = (table[:, 1:] + table[:, :-1]) / 2
    middles[np.isnan(middles)] = np.inf
    codes = [np.searchsorted(m, column, side="left") for m, column in zip(middles, x.T, strict=True)]
    return np.stack(codes, axis=1) if len(codes) else np.zeros(x.shape, np.int64)


def decoded(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.arange(len(table)), codes.astype(np.int64)]


def code_rows(vectors: DataFrame, table: np.ndarray) -> DataFrame:
    """``vectors`` with ``v`` as codes of a codebook; vectors that are null are left out."""
    rows, held = vectors.where("v IS NOT NULL"), vectors.sparkSession.sparkContext.broadcast(table)
    at = rows.columns.index("v")
    fields = ", ".join(f"`{f.name}` {'array<smallint>' if f.name == 'v' else f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(at))
            codes = nearest_codes(x, held.value) if len(x) else np.zeros((0, len(held.value)), np.int64)
            flat = pa.array(codes.astype(np.int16).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * len(held.value)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], lists, *batch.columns[at + 1 :]], batch.schema.names)

    return rows.mapInArrow(run, fields)


def code_metric(table: np.ndarray) -> Metric:
    """Squared distances between codes: both sides are looked up in the codebook, and nothing else of them is known."""
    return Metric(None, True, lambda q, v: l2_kernel(decoded(q, table), decoded(v, table)))
