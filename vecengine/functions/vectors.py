"""Vector arithmetic as columns, which stay in the JVM, and metrics for searches; everything is in double precision."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def l2_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2_sq_integers(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of integer vectors, exact as a long."""
    wide = lambda v: v.cast("array<bigint>")
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: (x - y) * (x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def ip_distance(a: Column, b: Column) -> Column:
    """One less the inner product: smaller is closer."""
    return F.lit(1.0) - inner_product(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def residual(x: Column, c: Column) -> Column:
    return F.zip_with(x, c, lambda p, q: p - q)


def dim_slice(v: Column, start: int, length: int) -> Column:
    """Dimensions ``start`` (from 0) to ``start + length - 1``."""
    return F.slice(v, start + 1, length)


def to_uint8(v: Column) -> Column:
    """Components of -1 to 1 as 0 to 255; Spark has no unsigned byte, so as smallint."""
    return F.transform(v, lambda x: F.floor((x + 1.0) * 127.5).cast("smallint"))


def to_int8(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(x * 127.0).cast("tinyint"))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def pack_block_id(cluster: Column, block: Column) -> Column:
    """A cluster (8 bits) over a block (24 bits)."""
    low = block.cast("bigint").bitwiseAND(F.lit(0xFFFFFF))
    return F.shiftleft(cluster.cast("bigint").bitwiseAND(F.lit(0xFF)), 24).bitwiseOR(low)


def unpack_block_id(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 24).bitwiseAND(F.lit(0xFF)), packed.bitwiseAND(F.lit(0xFFFFFF))


def pack_node_id(cluster: Column, block: Column, offset: Column) -> Column:
    """A packed block id over a 32-bit offset; a signed long, negative from cluster 128 on."""
    return F.shiftleft(pack_block_id(cluster, block), 32).bitwiseOR(offset.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_node_id(packed: Column) -> tuple[Column, Column, Column]:
    return (*unpack_block_id(F.shiftrightunsigned(packed, 32)), packed.bitwiseAND(F.lit(0xFFFFFFFF)))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2_kernel(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    # the expanded form loses digits where two vectors are close, so those are taken anew
    out = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * (q @ v.T)
    close = np.argwhere(out < 1e-6 * (1 + (q * q).sum(axis=1)[:, None]))
    for a in range(0, len(close), 65_536):
        i, j = close[a : a + 65_536].T
        out[i, j] = ((q[i] - v[j]) ** 2).sum(axis=1)
    return out


def ip_kernel(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return q @ v.T


def manhattan_kernel(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(v)))
    step = max(1, (1 << 15) // max(1, len(v)))  # what is worked on stays in a core's cache
    for a in range(0, len(q), step):
        some = out[a : a + step]
        apart = np.empty_like(some)
        for x, y in zip(q[a : a + step].T, v.T, strict=True):  # a dimension at a time, so no array has three
            np.abs(np.subtract(x[:, None], y[None, :], out=apart), out=apart)
            some += apart
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def l2_bound(q: np.ndarray, c: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """By the triangle inequality."""
    return np.maximum(np.sqrt(np.maximum(l2_kernel(q, c), 0.0)) - reach, 0.0) ** 2


def ip_bound(q: np.ndarray, c: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The product with the centroid, and that of the lengths of the query and of what a row adds to the centroid."""
    return q @ c.T + _norms(q)[:, None] * reach


def manhattan_bound(q: np.ndarray, c: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """By the triangle inequality; a row's steps away from the centroid are at most its reach times the root of the dimensions."""
    return np.maximum(manhattan_kernel(q, c) - reach * np.sqrt(q.shape[1]), 0.0)


Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Metric(NamedTuple):
    """A distance (``ascending``: the least is best) or a likeness.

    ``column`` scores one pair in the JVM.  ``kernel`` scores rows of queries against rows of vectors as a
    matrix; searches in blocks and cells want one.  ``bound`` gives, for queries, centroids and how far
    (in Euclidean distance) a cell's rows are from each, the best score that such a row can have; a range
    search leaves out cells by it.  Both are sent to the executors with the job.
    """

    column: Callable[[Column, Column], Column] | None
    ascending: bool
    kernel: Kernel | None = None
    bound: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None

    def within(self, scores: np.ndarray, radius: float) -> np.ndarray:
        return scores < radius if self.ascending else scores > radius

    def may_hold(self, q: np.ndarray, c: np.ndarray, reach: np.ndarray, radius: float) -> np.ndarray:
        """Whether a cell can hold a row within the radius, with room for rounding."""
        best = self.bound(q, c, reach)
        room = 1e-9 * (1.0 + abs(radius) + np.abs(best))
        return best <= radius + room if self.ascending else best >= radius - room


METRICS: dict[str, Metric] = {
    "l2": Metric(l2_sq, True, l2_kernel, l2_bound),
    "ip": Metric(inner_product, False, ip_kernel, ip_bound),
    "manhattan": Metric(manhattan, True, manhattan_kernel, manhattan_bound),
}


def register_metric(name: str, column: Callable[[Column, Column], Column], ascending: bool, kernel: Kernel | None = None, bound: Callable | None = None) -> None:
    """Make a metric of one's own known to all searches; without a kernel only ``search.knn_by`` takes it."""
    METRICS[name] = Metric(column, ascending, kernel, bound)


def metric(name: str | Metric) -> Metric:
    """A registered metric by its name; a metric itself is what it is."""
    if isinstance(name, Metric):
        return name
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]
