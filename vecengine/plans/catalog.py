"""Every query of the engine over the table ``embeddings``, and its SQL.

All rows are searched; the queries of a search are the rows whose id is divisible by 50.  An
index's centroids are a bounded sample: the rows of least id, the square root of the row count of
them.  Scores are rounded to six digits at the edge.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..index import IndexParams, VectorIndex
from ..operators import cluster, evaluate, graph, quantize, search
from ..session import checkpoint_dir
from ..sources import split

K, NPROBE, RADIUS, CAPACITY, DEGREE = 10, 5, 1.3, 15, 8
#: A radius of sums of absolute differences.
RADIUS_L1 = 7.5
#: Rows of a piece of a transposed matrix.
TILE = 256

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Tables:
    """The views that the queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        self.e = rows.select("vec_id", "label", V.doubles("embedding").alias("v"))
        self.q = self.e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))

    @property
    def first(self) -> Column:
        """The vector of least id, as a constant."""
        return F.array(*[F.lit(x) for x in self.e.orderBy("vec_id").first().v])

    @property
    def c(self) -> DataFrame:
        n = math.ceil(math.sqrt(self.e.count()))
        return self.e.orderBy("vec_id").limit(n).select(F.col("vec_id").alias("cid"), F.col("v").alias("c"))

    @property
    def a(self) -> DataFrame:
        return search.assign(self.e, self.c)

    @property
    def scaled(self) -> DataFrame:
        return self.e.select("vec_id", V.scaled(F.col("v"), F.col("label") + 1.0).alias("v"))

    def bounds(self) -> tuple[list[float], list[float]]:
        return quantize.bounds(quantize.train(self.e))

    def exact(self) -> DataFrame:
        return search.knn(self.q, self.e, K)

    def ivf(self, nprobe: int = NPROBE) -> DataFrame:
        return search.ivf_knn(self.q, self.a, self.c, K, nprobe)


def answer(df: DataFrame) -> DataFrame:
    """The score rounded, under the name ``dist``."""
    return df.withColumn("dist", F.round("score", 6)).drop("score")


def unpacked(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A row a component: ``dim`` and ``value``, rounded; a negative zero is zero."""
    return df.select(*keys, F.posexplode(column).alias("dim", "value")).select(*keys, F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


# The shared views in SQL.
_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_Q = "q AS (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id % 50 = 0)"
_R = "r AS (SELECT v AS rv FROM e ORDER BY vec_id LIMIT 1)"
_C = "c AS (SELECT vec_id AS cid, v AS c FROM (SELECT *, row_number() OVER (ORDER BY vec_id) AS rn FROM e) WHERE rn <= ceil(sqrt((SELECT count(*) FROM e))))"
_B = "b AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e) GROUP BY dim)"
_LH = "lh AS (SELECT list(lo ORDER BY dim) AS lo, list(hi ORDER BY dim) AS hi FROM b)"
_CODE = "code AS (SELECT vec_id, list_transform(v, lambda x, i: greatest(0, least(255, floor((x - lo[i]) / (hi[i] - lo[i] + 1) * 256)))) AS y, v FROM e, lh)"
_DEC = "dec AS (SELECT vec_id, list_transform(y, lambda z, i: z * (hi[i] - lo[i] + 1) / 256 + lo[i]) AS v, v AS raw FROM code, lh)"


def _l2(a: str, b: str) -> str:
    return f"power(list_distance({a}, {b}), 2)"


def _ip(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def _l1(a: str, b: str) -> str:
    return f"list_sum(list_transform({a}, lambda x, i: abs(x - {b}[i])))"


def _nearest(source: str, cents: str, out: str) -> str:
    """Each row of ``source`` with its nearest of ``cents``."""
    return (
        f"{out} AS (SELECT vec_id, v, cid, dist FROM (SELECT s.vec_id, s.v, k.cid, {_l2('s.v', 'k.c')} AS dist, "
        f"row_number() OVER (PARTITION BY s.vec_id ORDER BY {_l2('s.v', 'k.c')}, k.cid) AS rn FROM {source} s, {cents} k) WHERE rn = 1)"
    )


_A = _nearest("e", "c", "a")


def _sql(body: str, *views: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(views)}\n{body}"


def _top(name: str, source: str, score: str, k: int, order: str = "ASC") -> str:
    """The k best of ``source`` (which has qid, vec_id) by a score, as a view."""
    return (
        f"{name} AS (SELECT qid, rank, vec_id, score FROM (SELECT qid, vec_id, {score} AS score, "
        f"row_number() OVER (PARTITION BY qid ORDER BY {score} {order}, vec_id) AS rank FROM {source}) WHERE rank <= {k})"
    )


_PAIRS = "(SELECT qid, qv, vec_id, v FROM q, e)"
_EXACT = _top("exact", _PAIRS, _l2("qv", "v"), K)


def _probe(n: int | str, name: str = "p", order: str = "ASC", score: str | None = None) -> str:
    score = score or _l2("qv", "c")
    return (
        f"{name} AS (SELECT qid, qv, cid, rank, score FROM (SELECT qid, qv, cid, {score} AS score, "
        f"row_number() OVER (PARTITION BY qid ORDER BY {score} {order}, cid) AS rank FROM q, c) WHERE rank <= {n})"
    )


def _ivf(name: str, probes: str, k: int = K, order: str = "ASC", members: str = "a", score: str | None = None) -> str:
    return _top(name, f"(SELECT p.qid, p.qv, m.vec_id, m.v FROM {probes} p JOIN {members} m USING (cid))", score or _l2("qv", "v"), k, order)


_ROUNDED = "SELECT qid, rank, vec_id, round(score, 6) AS dist FROM "
_COMPONENTS = "unnest(generate_series(0, len({0}) - 1)) AS dim, round(unnest({0}), 6) + 0::DOUBLE AS value"


# Scalars: every row against the vector of least id.


@query(_sql(f"SELECT vec_id, round({_l2('v', 'rv')}, 6) AS dist FROM e, r", _E, _R))
def l2_sq(t):
    return t.e.select("vec_id", F.round(V.l2_sq(F.col("v"), t.first), 6).alias("dist"))


@query(_sql(f"SELECT vec_id, round({_ip('v', 'rv')}, 6) AS ip FROM e, r", _E, _R))
def inner_product(t):
    return t.e.select("vec_id", F.round(V.inner_product(F.col("v"), t.first), 6).alias("ip"))


@query(_sql(f"SELECT vec_id, round(1 - {_ip('v', 'rv')}, 6) + 0::DOUBLE AS dist FROM e, r", _E, _R))
def ip_distance(t):
    return t.e.select("vec_id", (F.round(V.ip_distance(F.col("v"), t.first), 6) + 0.0).alias("dist"))


@query(_sql(f"SELECT vec_id, round(sqrt({_ip('v', 'v')}), 6) AS norm FROM e", _E))
def vector_norm(t):
    return t.e.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"))


@query(_sql("SELECT vec_id, " + _COMPONENTS.format("v[33:64]") + " FROM e", _E))
def dim_slice(t):
    return unpacked(t.e.select("vec_id", V.dim_slice(F.col("v"), 32, 32).alias("s")), ["vec_id"], "s")


@query(_sql("SELECT vec_id, " + _COMPONENTS.format("list_transform(v, lambda x, i: x - rv[i])") + " FROM e, r", _E, _R))
def residual(t):
    return unpacked(t.e.select("vec_id", V.residual(F.col("v"), t.first).alias("s")), ["vec_id"], "s")


def _integers(kind: str) -> str:
    code = {"uint8": "floor((x + 1) * 127.5)", "int8": "floor(x * 127)"}[kind]
    return f"i AS (SELECT vec_id, list_transform(v, lambda x: {code}::BIGINT) AS w FROM e), iw AS (SELECT w AS rw FROM i ORDER BY vec_id LIMIT 1)"


_INTEGERS = "SELECT vec_id, list_sum(list_transform(w, lambda x, i: (x - rw[i]) * (x - rw[i])))::BIGINT AS dist FROM i, iw"


@query(_sql(_INTEGERS, _E, _integers("uint8")))
def l2_sq_uint8(t):
    return t.e.select("vec_id", V.l2_sq_integers(V.to_uint8(F.col("v")), V.to_uint8(t.first)).alias("dist"))


@query(_sql(_INTEGERS, _E, _integers("int8")))
def l2_sq_int8(t):
    return t.e.select("vec_id", V.l2_sq_integers(V.to_int8(F.col("v")), V.to_int8(t.first)).alias("dist"))


@query(_sql("SELECT vec_id, (label * 16777216 + vec_id)::BIGINT AS packed, label::BIGINT AS cluster, vec_id AS block FROM e", _E))
def block_id_pack(t):
    packed = t.e.select("vec_id", V.pack_block_id(F.col("label"), F.col("vec_id")).alias("packed"))
    cid, block = V.unpack_block_id(F.col("packed"))
    return packed.select("vec_id", "packed", cid.alias("cluster"), block.alias("block"))


@query(_sql("SELECT vec_id, ((label * 16777216 + vec_id)::BIGINT * 4294967296 + vec_id + 1)::BIGINT AS packed, label::BIGINT AS cluster, vec_id AS block, vec_id + 1 AS off FROM e", _E))
def node_id_pack(t):
    packed = t.e.select("vec_id", V.pack_node_id(F.col("label"), F.col("vec_id"), F.col("vec_id") + 1).alias("packed"))
    cid, block, off = V.unpack_node_id(F.col("packed"))
    return packed.select("vec_id", "packed", cid.alias("cluster"), block.alias("block"), off.alias("off"))


def _product(metric: str) -> str:
    views = "w AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS code, v FROM (SELECT * FROM e ORDER BY vec_id LIMIT 32)), parts AS (SELECT unnest(generate_series(0, 7)) AS part)"
    score = (_l2 if metric == "l2" else _ip)("q.qv[part * 8 + 1:part * 8 + 8]", "w.v[part * 8 + 1:part * 8 + 8]")
    return _sql(f"SELECT qid AS vec_id, part::BIGINT AS part, code::BIGINT AS code, round({score}, 6) AS score FROM q, w, parts", _E, _Q, views)


def _lut(t, metric: Callable) -> DataFrame:
    words = t.e.orderBy("vec_id").limit(32).select("vec_id", "v")
    ranked = words.sparkSession.createDataFrame([(i, r.v) for i, r in enumerate(sorted(words.collect()))], "code int, v array<double>")
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.slice("v", p * 8 + 1, 8)))
    codewords = ranked.select("code", cut.alias("part", "w"))
    found = quantize.product_tables(t.q.select(F.col("qid").alias("vec_id"), F.col("qv").alias("v")), codewords, 8, metric)
    return found.withColumn("score", F.round("score", 6))


@query(_product("l2"))
def pq_lut_l2(t):
    return _lut(t, V.l2_sq)


@query(_product("ip"))
def pq_lut_ip(t):
    return _lut(t, V.inner_product)


# Figures of norms.

_NORMS = f"n AS (SELECT vec_id, sqrt({_ip('v', 'v')}) AS x FROM e)"


@query(_sql("SELECT round(max(x), 6) AS max_norm, round(min(x), 6) AS min_norm, round(avg(x), 6) AS avg_norm FROM n", _E, _NORMS))
def norm_stats(t):
    return evaluate.norm_stats(t.e).select(*[F.round(c, 6).alias(c) for c in ("max_norm", "min_norm", "avg_norm")])


@query(_sql("SELECT round(min(x * x), 6) AS lo, round(max(x * x), 6) AS hi FROM n", _E, _NORMS))
def norm_sq_minmax(t):
    sq = t.e.select(V.inner_product(F.col("v"), F.col("v")).alias("x"))
    return sq.agg(F.round(F.min("x"), 6).alias("lo"), F.round(F.max("x"), 6).alias("hi"))


@query(_sql("SELECT round(avg(m), 6) AS avg_norm, count(*) AS batches FROM (SELECT vec_id // 64 AS b, avg(x) AS m FROM n GROUP BY b HAVING count(*) = 64)", _E, _NORMS))
def norm_stats_batched(t):
    batches = t.e.groupBy(F.floor(F.col("vec_id") / 64)).agg(F.avg(V.norm(F.col("v"))).alias("m"), F.count("*").alias("n")).where("n = 64")
    return batches.agg(F.round(F.avg("m"), 6).alias("avg_norm"), F.count("*").alias("batches"))


# Quantisation.


@query(_sql("SELECT dim::BIGINT AS dim, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b", _E, _B))
def sq_train(t):
    return quantize.train(t.e).select(F.col("dim").cast("long").alias("dim"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _codes(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("y").alias("dim", "code")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.col("code").cast("long").alias("code"))


@query(_sql("SELECT vec_id, unnest(generate_series(0, len(y) - 1)) AS dim, unnest(y)::BIGINT AS code FROM code", _E, _B, _LH, _CODE))
def sq_encode(t):
    return _codes(t.e.select("vec_id", quantize.encode(F.col("v"), *t.bounds()).alias("y")))


@query(_sql("SELECT vec_id, " + _COMPONENTS.format("v") + " FROM dec", _E, _B, _LH, _CODE, _DEC))
def sq_decode(t):
    b = t.bounds()
    return unpacked(t.e.select("vec_id", quantize.decode(quantize.encode(F.col("v"), *b), *b).alias("y")), ["vec_id"], "y")


@query(_sql(f"SELECT vec_id, round({_l2('v', 'raw')}, 6) AS err FROM dec", _E, _B, _LH, _CODE, _DEC))
def sq_reconstruction_error(t):
    return quantize.errors(t.e, *t.bounds()).withColumn("err", F.round("err", 6))


_EVEN = "code AS (SELECT vec_id, list_transform(v, lambda x, i: floor(greatest(0, least(1, (x - lo[i]) / (hi[i] - lo[i]))) * 255)) AS y FROM e, lh)"


@query(_sql("SELECT vec_id, unnest(generate_series(0, len(y) - 1)) AS dim, unnest(y)::BIGINT AS code FROM code", _E, _B, _LH, _EVEN))
def sq_encode_v2(t):
    return _codes(t.e.select("vec_id", quantize.encode_even(F.col("v"), *t.bounds()).alias("y")))


@query(_sql("SELECT vec_id, " + _COMPONENTS.format("list_transform(y, lambda z, i: lo[i] + (z + 0.5::DOUBLE) / 255 * (hi[i] - lo[i]))") + " FROM code, lh", _E, _B, _LH, _EVEN))
def sq_decode_v2(t):
    b = t.bounds()
    return unpacked(t.e.select("vec_id", quantize.decode_even(quantize.encode_even(F.col("v"), *b), *b).alias("y")), ["vec_id"], "y")


@query(_sql(_ROUNDED + "found", _E, _Q, _B, _LH, _CODE, _DEC, _top("found", "(SELECT qid, qv, vec_id, v FROM q, dec)", _l2("qv", "v"), K)))
def sq_asym_knn(t):
    b = t.bounds()
    decoded = t.e.select("vec_id", quantize.decode(quantize.encode(F.col("v"), *b), *b).alias("v"))
    return answer(search.knn(t.q, decoded, K))


@query(_sql(_ROUNDED + "found", _E, _B, _LH, _CODE, _DEC, _top("found", "(SELECT a.vec_id AS qid, a.v AS qv, b.vec_id, b.v FROM dec a, dec b WHERE a.vec_id % 50 = 0)", _l2("qv", "v"), K)))
def sq_symmetric_knn(t):
    """Distances between codes: neither side is known but by its codes."""
    lo, hi = t.bounds()
    table = np.array([[c * (b - a + 1.0) / 256.0 + a for c in range(256)] for a, b in zip(lo, hi, strict=True)])
    code = lambda df, v: df.withColumn(v, quantize.encode(F.col(v), lo, hi))
    return answer(search.knn(code(t.q, "qv"), code(t.e, "v"), K, quantize.code_metric(table)))


@query(
    _sql(
        "SELECT vec_id, dim::BIGINT AS dim, code::BIGINT AS code FROM (SELECT vec_id, x.dim, code, row_number() OVER (PARTITION BY vec_id, x.dim ORDER BY abs(x - value), code) AS rn FROM x JOIN w USING (dim)) WHERE rn = 1",
        _E,
        "x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e)",
        "w AS (SELECT dim, value, row_number() OVER (PARTITION BY dim ORDER BY value) - 1 AS code FROM (SELECT DISTINCT dim, x AS value FROM x WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 16)))",
    )
)
def codebook_encode(t):
    few = t.e.orderBy("vec_id").limit(16).select(F.posexplode("v").alias("dim", "value"))
    words = few.groupBy("dim").agg(F.array_sort(F.collect_set("value")).alias("w")).select("dim", F.posexplode("w").alias("code", "value"))
    return quantize.codebook_encode(t.e, words)


# Searches.


@query(_sql(_ROUNDED + "exact", _E, _Q, _EXACT))
def knn_exact_l2(t):
    return answer(t.exact())


@query(_sql(_ROUNDED + "found", _E, _Q, _top("found", "(SELECT qid, qv, vec_id, v FROM q, e)", _l1("qv", "v"), K)))
def knn_exact_manhattan(t):
    return answer(search.knn(t.q, t.e, K, "manhattan"))


_SCALED = "s AS (SELECT vec_id, list_transform(v, lambda x: x * (1 + label)) AS v FROM e)"


@query(_sql(_ROUNDED + "found", _E, _Q, _SCALED, _top("found", "(SELECT qid, qv, vec_id, v FROM q, s)", _ip("qv", "v"), K, "DESC")))
def knn_exact_ip(t):
    return answer(search.knn(t.q, t.scaled, K, "ip"))


@query(_sql("SELECT qid, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS ids FROM exact GROUP BY qid", _E, _Q, _EXACT))
def knn_closer_first(t):
    best = t.exact().groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("r"))
    return best.select("qid", F.array_join(F.transform("r", lambda x: x["vec_id"].cast("string")), ",").alias("ids"))


@query(_sql(_ROUNDED + "exact", _E, _Q, _EXACT))
def knn_two_phase(t):
    parts = [search.knn(t.q, t.e.where(F.col("vec_id") % 2 == k), K).drop("rank") for k in (0, 1)]
    return answer(search.ranked(parts[0].unionByName(parts[1]), K))


@query(_sql(_ROUNDED + "found", _E, _Q, _top("found", "(SELECT qid, qv, vec_id, v FROM q, e WHERE vec_id % 7 <> 3)", _l2("qv", "v"), K)))
def knn_with_deletes(t):
    tombstones = t.e.where("vec_id % 7 = 3").select("vec_id")
    return answer(search.knn(t.q, t.e.join(tombstones, "vec_id", "left_anti"), K))


@query(_sql(f"SELECT qid, round(sqrt({_ip('v', 'v')}), 6) AS norm FROM q JOIN e ON qid = vec_id", _E, _Q))
def point_lookup(t):
    found = t.q.select("qid").join(t.e, F.col("qid") == F.col("vec_id"))
    return found.select("qid", F.round(V.norm(F.col("v")), 6).alias("norm"))


@query(_sql("SELECT vec_id, label FROM e ORDER BY vec_id LIMIT 100", _E))
def first_n(t):
    return t.e.select("vec_id", "label").orderBy("vec_id").limit(100)


@query(
    """
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, len(embedding)::INTEGER AS dim,
       embedding[1]::DOUBLE AS head, embedding[-1]::DOUBLE AS tail
FROM embeddings
"""
)
def vector_files_scan(t):
    """All vectors written as vector files by the executors, and read back in splits of 64 KB."""
    path = f"{checkpoint_dir(t.spark)}/vectors-{uuid.uuid4().hex}.fbin"
    split.write_vectors(t.e.withColumnRenamed("v", "embedding"), path)
    back = split.scan_vectors(t.spark, path, split_bytes=64 << 10)
    head, tail = (F.element_at("embedding", k).cast("double") for k in (1, -1))
    return back.select("vec_id", F.size("embedding").alias("dim"), head.alias("head"), tail.alias("tail"))


@query(
    f"""
WITH x AS (SELECT vec_id, vec_id // {TILE} AS block, embedding, unnest(range(len(embedding))) AS dim FROM embeddings)
SELECT block, dim::INTEGER AS dim, count(*) AS n, string_agg(floor(embedding[dim + 1]::DOUBLE * 1000000)::BIGINT::VARCHAR, ',' ORDER BY vec_id) AS millionths
FROM x GROUP BY block, dim
"""
)
def matrix_transpose(t):
    """Columns of the matrix of vectors, in pieces of the rows of a block of ids; values as text, in millionths."""
    text = F.array_join(F.transform("column_values", lambda x: F.floor(x * 1000000).cast("string")), ",")
    return cluster.transposed(t.e, TILE).select("block", "dim", "n", text.alias("millionths"))


# Clustering.

_LEN = f"len AS (SELECT avg(sqrt({_ip('v', 'v')})) AS l FROM e)"


def _means(source: str, out: str, length: bool = False, key: str = "cid") -> str:
    """The centroids of a view with ``key`` and v: means, or sums scaled to the mean norm."""
    sums = f"SELECT {key}, list(s ORDER BY i) AS s, max(n) AS n FROM (SELECT {key}, i, sum(x) AS s, count(*) AS n FROM (SELECT {key}, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {source}) GROUP BY {key}, i) GROUP BY {key}"
    scale = "(SELECT l FROM len) / z" if length else "1 / n"
    return f"{out} AS (SELECT {key}, n, list_transform(s, lambda x: x * {'zz' if length else '(1::DOUBLE / n)'}) AS c FROM (SELECT *, {scale if length else '0'} AS zz FROM (SELECT *, sqrt({_ip('s', 's')}) AS z FROM ({sums}))))"


@query(_sql("SELECT vec_id, cid, round(dist, 6) AS dist FROM a", _E, _C, _A))
def assign_nearest(t):
    return t.a.select("vec_id", "cid", F.round("dist", 6).alias("dist"))


@query(_sql("SELECT cid, count(*) AS n FROM a GROUP BY cid", _E, _C, _A))
def cluster_sizes(t):
    return t.a.groupBy("cid").agg(F.count("*").alias("n"))


@query(_sql("SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, count(*) - count(nullif(n, 0)) AS empty FROM (SELECT c.cid, count(a.vec_id) AS n FROM c LEFT JOIN a USING (cid) GROUP BY c.cid)", _E, _C, _A))
def cluster_size_stats(t):
    sizes = t.c.select("cid").join(t.a.groupBy("cid").agg(F.count("*").alias("n")), "cid", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") == 0).alias("empty"))


@query(_sql("SELECT round(sum(dist), 4) AS inertia FROM a", _E, _C, _A))
def kmeans_inertia(t):
    return t.a.agg(F.round(F.sum("dist"), 4).alias("inertia"))


def _by_label(t, length: float | None) -> DataFrame:
    return unpacked(cluster.centroids(t.e.withColumnRenamed("label", "cid"), length), ["cid", "n"], "c").withColumnRenamed("cid", "label")


@query(_sql("SELECT label, n, " + _COMPONENTS.format("c") + " FROM m", _E, _means("e", "m", key="label")))
def centroid_mean(t):
    return _by_label(t, None)


@query(_sql("SELECT label, n, " + _COMPONENTS.format("c") + " FROM m", _E, _LEN, _means("e", "m", length=True, key="label")))
def centroid_normalized(t):
    return _by_label(t, cluster.mean_norm(t.e))


@query(_sql("SELECT cid, n, " + _COMPONENTS.format("c") + " FROM m", _E, _C, _A, _means("a", "m")))
def kmeans_step(t):
    return unpacked(cluster.centroids(t.a), ["cid", "n"], "c")


@query(
    _sql(
        "SELECT vec_id, cid, round(dist, 6) AS dist FROM a3",
        _E, _C, _LEN, _A, _means("a", "m1", True), _nearest("e", "m1", "a1"), _means("a1", "m2", True), _nearest("e", "m2", "a2"), _means("a2", "m3", True), _nearest("e", "m3", "a3"),
    )
)
def kmeans_3iter(t):
    cents = cluster.lloyd(t.e, t.c, 3, cluster.mean_norm(t.e))
    return search.assign(t.e, cents).select("vec_id", "cid", F.round("dist", 6).alias("dist"))


_LEAST = 20


@query(
    _sql(
        "SELECT vec_id, cid FROM a WHERE cid IN (SELECT cid FROM l) UNION ALL SELECT vec_id, cid FROM m",
        _E, _C, _A, f"l AS (SELECT cid, c.c FROM c WHERE cid IN (SELECT cid FROM a GROUP BY cid HAVING count(*) >= {_LEAST}))",
        "o AS (SELECT vec_id, v FROM a WHERE cid NOT IN (SELECT cid FROM l))", _nearest("o", "l", "m"),
    )
)
def merge_small_clusters(t):
    return cluster.merge_small(t.a, t.c, _LEAST)


# Blocks.

_PACK = f"k AS (SELECT cid, (rn // {CAPACITY})::BIGINT AS block_id, (rn % {CAPACITY})::BIGINT AS slot, vec_id, v FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY dist, vec_id) - 1 AS rn FROM a))"
_BLOCKS = _means("k", "bc", key="cid, block_id")


@query(_sql("SELECT cid, block_id, slot, vec_id FROM k", _E, _C, _A, _PACK))
def block_pack(t):
    return cluster.pack_in_order(t.a, CAPACITY).select("cid", "block_id", "slot", "vec_id")


def _block_centroids(t) -> tuple[DataFrame, DataFrame]:
    packed = cluster.pack_in_order(t.a, CAPACITY)
    keyed = packed.select(F.struct("cid", "block_id").alias("cid"), "vec_id", "v")
    return packed, cluster.centroids(keyed).select("cid.cid", "cid.block_id", "c", "n")


@query(_sql("SELECT cid, block_id, n, " + _COMPONENTS.format("c") + " FROM bc", _E, _C, _A, _PACK, _BLOCKS))
def block_centroids(t):
    return unpacked(_block_centroids(t)[1], ["cid", "block_id", "n"], "c")


def _farthest(score: Callable[[str, str], str], order: str) -> str:
    far = score("k.v", "bc.c")
    ranks = f"row_number() OVER (PARTITION BY k.cid, k.block_id ORDER BY round({far}, 9) {order}, k.vec_id) AS rep"
    return _sql(f"SELECT cid, block_id, rep, vec_id, round(dist, 6) + 0::DOUBLE AS dist FROM (SELECT k.cid, k.block_id, k.vec_id, {far} AS dist, {ranks} FROM k JOIN bc USING (cid, block_id)) WHERE rep <= 2", _E, _C, _A, _PACK, _BLOCKS)


@query(_farthest(_l2, "DESC"))
def block_representatives(t):
    return cluster.representatives(*_block_centroids(t), 2).withColumn("dist", F.round("dist", 6))


@query(_farthest(_ip, "ASC"))
def block_representatives_ip(t):
    """The two rows of each block that are least like its centroid."""
    return cluster.representatives(*_block_centroids(t), 2, "ip").withColumn("dist", F.round("dist", 6) + 0.0)


@query(_sql("SELECT cid, count(DISTINCT qid) AS queries FROM p GROUP BY cid", _E, _Q, _C, _probe(NPROBE)))
def block_reads_dedup(t):
    return search.probe(t.q, t.c, NPROBE).select("qid", "cid").distinct().groupBy("cid").agg(F.count("*").alias("queries"))


# Inverted lists.


@query(_sql("SELECT qid, rank, cid, round(score, 6) AS dist FROM p", _E, _Q, _C, _probe(NPROBE)))
def ivf_probe(t):
    return answer(search.probe(t.q, t.c, NPROBE))


@query(_sql(_ROUNDED + "found", _E, _Q, _C, _A, _probe(NPROBE), _ivf("found", "p")))
def ivf_knn_l2(t):
    return answer(t.ivf())


@query(_sql(_ROUNDED + "found", _E, _Q, _C, _A, _probe(NPROBE, order="DESC", score=_ip("qv", "c")), _ivf("found", "p", order="DESC", score=_ip("qv", "v"))))
def ivf_knn_ip(t):
    return answer(search.ivf_knn(t.q, t.a, t.c, K, NPROBE, "ip"))


@query(_sql(_ROUNDED + "found", _E, _Q, _C, _A, _probe(NPROBE, score=_l1("qv", "c")), _ivf("found", "p", score=_l1("qv", "v"))))
def ivf_knn_manhattan(t):
    return answer(search.ivf_knn(t.q, t.a, t.c, K, NPROBE, "manhattan"))


@query(_sql(_ROUNDED + "found", _E, _Q, _C, _A, _probe(2), _ivf("found", "p")))
def ivf_flat_knn(t):
    return answer(t.ivf(2))


@query(_sql(_ROUNDED + "found", _E, _Q, _C, _A, _B, _LH, _CODE, _DEC, _probe(NPROBE), "m AS (SELECT a.cid, dec.vec_id, dec.v FROM a JOIN dec USING (vec_id))", _ivf("found", "p", members="m")))
def ivf_knn_sq(t):
    b = t.bounds()
    members = t.a.withColumn("v", quantize.decode(quantize.encode(F.col("v"), *b), *b))
    return answer(search.ivf_knn(t.q, members, t.c, K, NPROBE))


@query(_sql(_ROUNDED + "exact", _E, _Q, _EXACT))
def ivf_knn_probe_all(t):
    return answer(t.ivf(65_536))


# Ranges.

_RANGE = f"found AS (SELECT qid, vec_id, {_l2('qv', 'v')} AS score FROM q, e WHERE {_l2('qv', 'v')} < {RADIUS})"
_FOUND = "SELECT qid, vec_id, round(score, 6) AS dist FROM found"


def _within(t) -> DataFrame:
    return search.within(t.q, t.e, RADIUS)


@query(_sql(_FOUND, _E, _Q, _RANGE))
def range_exact(t):
    return answer(_within(t))


_RANGE_IP = f"found AS (SELECT qid, vec_id, {_ip('qv', 'v')} AS score FROM q, s WHERE {_ip('qv', 'v')} > 1.5)"


@query(_sql(_FOUND, _E, _Q, _SCALED, _RANGE_IP))
def range_ip(t):
    return answer(search.within(t.q, t.scaled, 1.5, "ip"))


_RANGE_L1 = f"found AS (SELECT qid, vec_id, {_l1('qv', 'v')} AS score FROM q, e WHERE {_l1('qv', 'v')} < {RADIUS_L1})"


@query(_sql(_FOUND, _E, _Q, _RANGE_L1))
def range_manhattan(t):
    return answer(search.within(t.q, t.e, RADIUS_L1, "manhattan"))


@query(
    _sql(
        _FOUND, _E, _Q, _C, _A, f"p AS (SELECT qid, qv, cid FROM q, c WHERE {_l2('qv', 'c')} < {RADIUS * 1.2})",
        f"found AS (SELECT p.qid, a.vec_id, {_l2('p.qv', 'a.v')} AS score FROM p JOIN a USING (cid) WHERE {_l2('p.qv', 'a.v')} < {RADIUS})",
    )
)
def range_ivf(t):
    return answer(search.ivf_range(t.q, t.a, t.c, RADIUS, 1.2))


@query(_sql(_FOUND, _E, _Q, _RANGE))
def range_pruned_exact(t):
    return answer(search.range_pruned(t.q, t.a, t.c, RADIUS))


_COUNTS = "n AS (SELECT q.qid, count(found.vec_id) AS n FROM q LEFT JOIN found ON q.qid = found.qid AND found.vec_id <> q.qid GROUP BY q.qid)"


@query(_sql("SELECT qid, n, (sum(n) OVER (ORDER BY qid))::BIGINT AS lim FROM n", _E, _Q, _RANGE, _COUNTS))
def range_lims(t):
    return evaluate.lims(t.q, _within(t).where("qid <> vec_id"))


@query(_sql("SELECT n, count(*) AS queries FROM n GROUP BY n", _E, _Q, _RANGE, _COUNTS))
def range_size_histogram(t):
    return evaluate.size_histogram(t.q, _within(t).where("qid <> vec_id"))


@query(_sql(f"SELECT qid, count_if({_l2('qv', 'v')} < 0.8)::BIGINT AS near, count_if({_l2('qv', 'v')} < {RADIUS})::BIGINT AS within FROM exact JOIN q USING (qid) JOIN e USING (vec_id) GROUP BY qid", _E, _Q, _EXACT))
def gt_radius_check(t):
    looked = t.exact().select("qid", "vec_id").join(t.q, "qid").join(t.e.select("vec_id", "v"), "vec_id")
    d = V.l2_sq(F.col("qv"), F.col("v"))
    return looked.groupBy("qid").agg(F.count_if(d < 0.8).alias("near"), F.count_if(d < RADIUS).alias("within"))


# Evaluation.

_ANSWER = (_E, _Q, _C, _A, _EXACT, _probe(NPROBE), _ivf("found", "p"))


@query(_sql("SELECT e.qid, count(f.vec_id) AS hits, count(*) AS wanted, round(count(f.vec_id) / count(*), 6) AS recall FROM exact e LEFT JOIN found f ON e.qid = f.qid AND e.vec_id = f.vec_id GROUP BY e.qid", *_ANSWER))
def recall_at_k(t):
    return evaluate.recall(t.ivf(), t.exact()).withColumn("recall", F.round("recall", 6))


@query(_sql("SELECT x.qid, least(count_if(f.score <= x.edge + 1e-12), x.wanted)::BIGINT AS hits, x.wanted FROM (SELECT qid, max(score) AS edge, count(*) AS wanted FROM exact GROUP BY qid) x LEFT JOIN found f USING (qid) GROUP BY x.qid, x.wanted", *_ANSWER))
def recall_by_distance(t):
    truth = t.exact().withColumn("score", F.col("score") + 1e-12)
    return evaluate.recall_by_distance(t.ivf(), truth)


@query(_sql("SELECT qid, vec_id FROM exact INTERSECT SELECT qid, vec_id FROM found", *_ANSWER))
def truth_intersection(t):
    return evaluate.shared(t.ivf(), t.exact())


@query(_sql("SELECT qid, vec_id FROM exact EXCEPT SELECT qid, vec_id FROM found", *_ANSWER))
def missed_neighbors(t):
    return evaluate.missed(t.ivf(), t.exact())


_SWEEP = (1, 2, 5, 10, 20)
_RECALLS = "rc AS (" + " UNION ALL ".join(f"SELECT {n}::BIGINT AS nprobe, round(count(f.vec_id) / count(*), 6) AS recall FROM exact e LEFT JOIN f{n} f ON e.qid = f.qid AND e.vec_id = f.vec_id" for n in _SWEEP) + ")"
_SWEPT = (_E, _Q, _C, _A, _EXACT, *[x for n in _SWEEP for x in (_probe(n, f"p{n}"), _ivf(f"f{n}", f"p{n}"))], _RECALLS)


def _recalls(t) -> DataFrame:
    """One search of the most cells: the best of those of rank n at most are the answer of n cells."""
    most = search.ivf_candidates(t.q, t.a, t.c, K, max(_SWEEP))
    swept = most.join(F.broadcast(t.spark.createDataFrame([(n,) for n in _SWEEP], "nprobe long")), F.col("probe") <= F.col("nprobe"))
    best = Window.partitionBy("nprobe", "qid").orderBy("score", "vec_id")
    found = swept.withColumn("at", F.row_number().over(best)).where(F.col("at") <= K).select("nprobe", "qid", "vec_id")
    truth = t.exact().select("qid", "vec_id")
    hits = found.join(truth, ["qid", "vec_id"]).groupBy("nprobe").agg(F.count("*").alias("hits"))
    return hits.join(truth.agg(F.count("*").alias("wanted")), F.lit(True)).select("nprobe", F.round(F.col("hits") / F.col("wanted"), 6).alias("recall"))


@query(_sql("SELECT nprobe, recall FROM rc", *_SWEPT))
def recall_vs_nprobe(t):
    return _recalls(t)


@query(_sql("SELECT nprobe, recall FROM (SELECT *, max(recall) OVER (ORDER BY nprobe, recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM rc) WHERE b IS NULL OR recall > b", *_SWEPT))
def pareto_frontier(t):
    return evaluate.frontier(_recalls(t), "nprobe", "recall")


_RUN = (
    "SELECT 'ivf {0}' AS run, {0}::BIGINT AS nprobe, (SELECT count(DISTINCT qid) FROM f{0}) AS queries, (SELECT count(*) FROM f{0}) AS found, "
    "(SELECT count(*) FROM p{0} JOIN a USING (cid)) AS distances, count(f.vec_id) AS hits, count(*) AS wanted, round(count(f.vec_id) / count(*), 6) AS recall "
    "FROM exact e LEFT JOIN f{0} f ON e.qid = f.qid AND e.vec_id = f.vec_id"
)


@query(_sql(" UNION ALL ".join(_RUN.format(n) for n in _SWEEP), *_SWEPT[:-1]))
def run_metrics(t):
    """A row a run of a sweep over the cells probed: what was found, what it took, as the kernels tell, and the recall."""
    runs = {f"ivf {n}": lambda seen, n=n: search.ivf_knn(t.q, t.a, t.c, K, n, seen=seen) for n in _SWEEP}
    nprobe = F.split_part("run", F.lit(" "), F.lit(2)).cast("long").alias("nprobe")
    return evaluate.run_table(runs, t.exact()).select("run", nprobe, "queries", "found", "distances", "hits", "wanted", F.round("recall", 6).alias("recall"))


# Graphs: edges are within cells.

_GRAPH = f"g AS (SELECT src, dst, dist FROM (SELECT x.vec_id AS src, y.vec_id AS dst, {_l2('x.v', 'y.v')} AS dist, row_number() OVER (PARTITION BY x.vec_id ORDER BY {_l2('x.v', 'y.v')}, y.vec_id) AS rn FROM a x JOIN a y ON x.cid = y.cid AND x.vec_id <> y.vec_id) WHERE rn <= {DEGREE})"
_BOTH = f"h AS (SELECT src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rn FROM (SELECT src, dst, min(dist) AS dist FROM (SELECT * FROM g UNION ALL SELECT dst, src, dist FROM g) GROUP BY src, dst)) WHERE rn <= {2 * DEGREE})"


def _graph(t) -> DataFrame:
    return graph.knn_graph(t.a, DEGREE)


@query(_sql("SELECT src, dst, round(dist, 6) AS dist FROM g", _E, _C, _A, _GRAPH))
def knn_graph(t):
    return _graph(t).withColumn("dist", F.round("dist", 6))


@query(_sql("SELECT src, dst, round(dist, 6) AS dist FROM h", _E, _C, _A, _GRAPH, _BOTH))
def graph_symmetrize(t):
    return graph.symmetrize(_graph(t), 2 * DEGREE).withColumn("dist", F.round("dist", 6))


@query(_sql("SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, count(*) AS nodes FROM (SELECT e.vec_id, count(h.dst) AS n FROM e LEFT JOIN h ON h.src = e.vec_id GROUP BY e.vec_id)", _E, _C, _A, _GRAPH, _BOTH))
def graph_degree_stats(t):
    out = graph.symmetrize(_graph(t), 2 * DEGREE).groupBy(F.col("src").alias("vec_id")).agg(F.count("*").alias("n"))
    n = t.e.select("vec_id").join(out, "vec_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.count("*").alias("nodes"))


@query(
    _sql(
        "SELECT (SELECT count(*) FROM g) AS edges, (SELECT count(*) FROM g WHERE src = dst) AS self_loops, (SELECT count(*) - count(DISTINCT (src, dst)) FROM g) AS repeated, "
        "(SELECT count(*) FROM g WHERE dst NOT IN (SELECT vec_id FROM e)) AS dangling, (SELECT count(*) FROM e WHERE vec_id NOT IN (SELECT dst FROM g)) AS no_edge_in",
        _E, _C, _A, _GRAPH,
    )
)
def graph_integrity(t):
    return graph.integrity(_graph(t), t.e)


@query(
    _sql(
        f"SELECT qid, vec_id, round({_l2('qv', 'v')}, 6) AS dist FROM w JOIN q USING (qid) JOIN e USING (vec_id)",
        _E, _Q, _C, _A, _GRAPH, _BOTH,
        f"w AS (SELECT qid, qid AS vec_id FROM q UNION SELECT w.qid, h.dst FROM w JOIN h ON h.src = w.vec_id JOIN q ON q.qid = w.qid JOIN e ON e.vec_id = h.dst WHERE {_l2('q.qv', 'e.v')} < 1.6)",
        recursive=True,
    )
)
def graph_radius_expand(t):
    edges = graph.symmetrize(_graph(t), 2 * DEGREE)
    seeds = t.q.select("qid", F.col("qid").alias("vec_id"))
    return answer(graph.radius_expand(seeds, edges, t.e, t.q, 1.6))


@query()
def knn_graph_descent(t):
    """Each row's nearest others wherever they are, by neighbour descent."""
    return graph.descent(t.e, DEGREE).withColumn("dist", F.round("dist", 6))


# The index.


def _index(t, rows: DataFrame | None = None, **params) -> VectorIndex:
    path = f"{checkpoint_dir(t.spark)}/index-{uuid.uuid4().hex}"
    return VectorIndex.build(t.e if rows is None else rows, path, IndexParams(clusters=math.ceil(math.sqrt(t.e.count())), **params))


@query("SELECT count(*) AS rows, true AS fit, true AS once FROM embeddings")
def index_build_summary(t):
    """Rows of the index, and whether all blocks fit their bytes and every row is in one of them."""
    rows = _index(t).members()
    blocks = rows.groupBy("cid", "block_id").agg(F.count("*").alias("n"))
    one = blocks.agg(F.sum("n").alias("rows"), (F.max("n") <= CAPACITY).alias("fit"))
    return one.join(rows.agg((F.count_distinct("vec_id") == F.count("*")).alias("once")), F.lit(True))


@query()
def index_knn(t):
    index = _index(t)
    return answer(index.knn(t.q, K, index.probes_for(K)))


@query(_sql(_ROUNDED + "exact", _E, _Q, _EXACT))
def index_knn_probe_all(t):
    index = _index(t)
    return answer(index.knn(t.q, K, index.blocks().count()))


@query(_sql(_FOUND, _E, _Q, _RANGE))
def index_range(t):
    return answer(_index(t).range(t.q, RADIUS))


@query(_sql(_FOUND, _E, _Q, _SCALED, _RANGE_IP))
def index_range_ip(t):
    """Every row with a product over 1.5, from the blocks that can hold one."""
    return answer(_index(t, t.scaled, metric="ip").range(t.q, 1.5))


@query(_sql(_FOUND, _E, _Q, _RANGE_L1))
def index_range_manhattan(t):
    return answer(_index(t, metric="manhattan").range(t.q, RADIUS_L1))


@query()
def graph_beam_knn(t):
    index = _index(t)
    return answer(index.knn_by_graph(t.q, K, index.probes_for(K)))


@query()
def sq_graph_knn(t):
    """A beam over codes finds blocks, whose centroids are scored anew, and their rows are searched exactly."""
    index = _index(t, graph_codes=64)
    return answer(index.knn_by_graph(t.q, K, index.probes_for(K)))


@query()
def graph_range(t):
    index = _index(t)
    return answer(index.range_by_graph(t.q, RADIUS, factor=1.2))


@query(_sql("SELECT cid, count(*) AS rows, true AS fit FROM a GROUP BY cid", _E, _C, _A))
def balanced_block_sizes(t):
    """Rows of each cluster after it is cut into balanced blocks, and whether all of those fit their bytes."""
    blocks = cluster.pack_clusters(t.a, CAPACITY).groupBy("cid", "block_id").agg(F.count("*").alias("n"))
    return blocks.groupBy("cid").agg(F.sum("n").alias("rows"), (F.max("n") <= CAPACITY).alias("fit"))


@query("SELECT count(*) AS rows, true AS fit, 0::BIGINT AS small_clusters, 0::BIGINT AS mergeable FROM embeddings")
def merged_block_sizes(t):
    """Rows after small clusters are dissolved and small blocks merged, and how many are left that could have been.

    Of a part's blocks the two smallest tell whether one under the least rows still fits another.
    """
    least = CAPACITY // 2
    blocks = cluster.pack_clusters(cluster.dissolve(t.a, t.c, _LEAST), CAPACITY, least=least).groupBy("cid", "block_id").agg(F.count("*").alias("n"))
    parts = blocks.groupBy("cid", F.shiftright("block_id", 20).alias("part")).agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.array_sort(F.collect_list("n")).alias("n"))  # 20,000 rows a part
    both = (F.size("n") > 1) & (F.col("n")[0] < least) & (F.get("n", F.lit(0)) + F.get("n", F.lit(1)) <= CAPACITY)
    sizes = parts.groupBy("cid").agg(F.sum("rows").alias("rows"), F.max("most").alias("most"), F.count_if(both).alias("mergeable"))
    return sizes.agg(F.sum("rows").alias("rows"), (F.max("most") <= CAPACITY).alias("fit"), F.count_if(F.col("rows") < F.least(F.lit(_LEAST), F.lit(t.e.count()))).alias("small_clusters"), F.sum("mergeable").alias("mergeable"))


@query(_sql("SELECT vec_id, label FROM e ORDER BY md5('1234:' || vec_id), vec_id LIMIT (SELECT greatest(count(*) // 100, least(count(*), 390)) FROM e)", _E))
def hash_sample(t):
    return cluster.hash_sample(t.e.select("vec_id", "label"), cluster.sample_size(t.e.count(), 10))


# Without SQL: what depends on seeds.


@query()
def kmeanspp_seed(t):
    """Ten rows to start k-means from, drawn by distance in rounds over all rows."""
    return cluster.seeds(t.e, 10).select(F.col("cid").cast("int").alias("cid"), "vec_id")
