"""An index of vectors as Parquet tables: build, load, k nearest and range searches."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .functions.vectors import l2_sq
from .operators import cluster, evaluate, graph, quantize, search
from .session import stored

#: Nodes of the graph that a part has, about; and parts at most (beyond, they grow and are split by distance).
PART_NODES, MOST_ROUTES = 512, 65_536
#: Bytes of the vectors that clusters are trained on.
SEED_BYTES = 256 << 20


@dataclass(frozen=True)
class IndexParams:
    """What an index is built with; all of it is kept in the index's manifest.

    ``least_rows``: smaller clusters are dissolved, parts of split clusters and blocks merged where there is room.
    ``graph_codes``: codewords a dimension; over 0, the graph is walked over codes, and what is found ranked anew.
    """

    metric: str = "l2"
    clusters: int = 20
    block_bytes: int = 4096
    rounds: int = 10
    coded: bool = False
    seed: int = 1234
    sample_rate: float = 0.01
    degree: int = 16
    beam: int = 64
    sample: int = 1
    least_rows: int = 0
    graph_codes: int = 0

    def __post_init__(self):
        search.kernel_of(self.metric)
        if self.clusters < 1:
            raise ValueError("an index has one cluster or more")
        if not 1 <= self.sample <= 16:
            raise ValueError("a block has 1 to 16 nodes in the graph: its centroid and its farthest rows")
        if not (self.graph_codes == 0 or 2 <= self.graph_codes <= 256):
            raise ValueError("a codebook has 2 to 256 codewords a dimension, or 0 for none")


class VectorIndex:
    """Tables ``members``, ``blocks``, ``graph``, ``routes``, ``clusters``, ``bounds`` and ``manifest`` in one folder.

    A block's key is its cluster times 2 ** 40 plus its number.  ``members`` is sorted by key, in
    small row groups, so that a search reads the pages of the blocks that it probes.  The graph is over
    blocks' centroids (and with ``sample`` over 1 over as many of their farthest rows less one), by
    neighbour descent, whatever their clusters.  Its nodes are put together in parts of close ones,
    some hundreds each; ``routes`` has the parts' centroids, so that a query starts in a few
    parts, however many there are, and goes on where edges lead.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._checked = spark, path, False
        row = spark.read.parquet(f"{path}/manifest").first()
        self.dim, self.rows = row.dim, row.rows
        told = row.asDict()
        self.params = IndexParams(**{k: told[k] for k in IndexParams.__dataclass_fields__ if k in told})

    load = classmethod(lambda cls, spark, path: cls(spark, path))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, params: IndexParams = IndexParams()) -> VectorIndex:  # noqa: B008
        """Index ``(vec_id, v)``: cluster a bounded sample, deal all rows out, and cut clusters into blocks.

        Null vectors and ids are left out.  Clusters are those of squared distance whatever the metric.
        """
        spark = vectors.sparkSession
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
        told = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.min(F.size("v")).alias("least")).first()
        if told.n == 0 or told.dim != told.least:
            raise ValueError("vectors of one length are wanted")
        k = min(params.clusters, told.n)
        taken = min(cluster.sample_size(told.n, k, params.sample_rate), 256 * k, max(k, SEED_BYTES // (8 * told.dim)))
        sample = cluster.hash_sample(rows, taken, params.seed)
        sample = sample.cache()
        start = cluster.seeds(sample, k, params.seed).select("cid", "c")
        trained = cluster.lloyd(sample, start, params.rounds, cluster.mean_norm(sample), stop=0.01, repair=True)
        sample.unpersist()
        size = cluster.capacity(told.dim, params.block_bytes, coded=params.coded)
        dealt = search.assign(rows, trained)
        if params.least_rows:
            dealt = stored(cluster.dissolve(dealt, trained, params.least_rows), "index-dealt")
        packed = stored(cluster.pack_clusters(dealt, size, params.seed, min(params.least_rows, size)), "index-packed")
        lo, hi = quantize.bounds(quantize.train(rows)) if params.coded else ([], [])
        kept = packed.withColumn("v", quantize.encode(F.col("v"), lo, hi)) if params.coded else packed
        laid = kept.select((F.col("cid") * F.lit(1 << 40) + F.col("block_id")).alias("key"), "vec_id", "v").repartitionByRange("key").sortWithinPartitions("key", "vec_id")
        laid.write.option("parquet.block.size", 4 << 20).option("parquet.page.size", 64 << 10).option("parquet.page.row.count.limit", 256).parquet(f"{path}/members")
        keyed = packed.select((F.col("cid") * F.lit(1 << 40) + F.col("block_id")).alias("cid"), "vec_id", "v")
        near = quantize.decode(quantize.encode(F.col("v"), lo, hi), lo, hi) if params.coded else F.col("v")
        blocks = stored(cluster.centroids(keyed).withColumnRenamed("cid", "key"), "index-blocks")
        far = keyed.withColumnRenamed("cid", "key").join(blocks, "key").select("key", "vec_id", "c", "n", "v", near.alias("near"))
        # how far a block's rows, as they are read, lie from its centroid
        far = far.withColumn("d", F.aggregate(F.zip_with("near", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
        reach = far.groupBy("key").agg(F.sqrt(F.max("d")).alias("reach"))
        cells = {"cid": F.shiftright("key", 40), "block_id": F.col("key").bitwiseAND((1 << 40) - 1)}
        blocks.join(reach, "key").select(*[c.alias(n) for n, c in cells.items()], "c", "n", "reach").write.parquet(f"{path}/blocks")
        nodes = blocks.select(F.shiftright("key", 20).alias("cid"), (F.col("key") * 16).alias("vec_id"), F.col("c").alias("v"))
        if params.sample > 1:
            at = F.row_number().over(Window.partitionBy("key").orderBy(F.col("d").desc(), "vec_id"))
            others = far.withColumn("at", at).where(F.col("at") < params.sample)
            nodes = nodes.unionByName(others.select(F.shiftright("key", 20).alias("cid"), (F.col("key") * 16 + F.col("at")).alias("vec_id"), "v"))
        nodes = stored(nodes, "index-nodes")
        near_by = graph.knn_graph(nodes, params.degree)
        edges = graph.descent(nodes.select("vec_id", "v"), params.degree, start=near_by, width=2 * params.degree, seed=params.seed)
        edges = graph.symmetrize(graph.diverse(edges, nodes, params.degree), 2 * params.degree)
        parted = stored(_parted(nodes.select("vec_id", "v"), params.seed), "index-parts")
        cluster.centroids(parted).write.parquet(f"{path}/routes")
        held = graph.adjacency(parted, edges)
        if params.graph_codes:
            quantize.train_codebook(nodes, params.graph_codes).write.parquet(f"{path}/codebook")
            held = quantize.code_rows(held, quantize.table_of(spark.read.parquet(f"{path}/codebook")))
            nodes.select("vec_id", "v").repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.parquet(f"{path}/nodes")
        held.repartitionByRange("cid").sortWithinPartitions("cid", "vec_id").write.option("parquet.block.size", 4 << 20).parquet(f"{path}/graph")
        trained.write.parquet(f"{path}/clusters")
        spark.createDataFrame(list(enumerate(zip(lo, hi, strict=True))) or [], "dim int, range struct<lo:double,hi:double>").write.parquet(f"{path}/bounds")
        manifest = asdict(params) | {"dim": int(told.dim), "rows": int(told.n)}
        spark.createDataFrame([tuple(manifest.values())], "metric string, clusters int, block_bytes int, rounds int, coded boolean, seed int, sample_rate double, degree int, beam int, sample int, least_rows int, graph_codes int, dim int, rows long").write.parquet(f"{path}/manifest")
        return cls(spark, path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def blocks(self) -> DataFrame:
        """``(cid, block_id, c, n, reach)`` of every block."""
        return self._table("blocks")

    def graph(self) -> DataFrame:
        """``(cid, vec_id, v, links, parts)`` of every node: its part, its number (16 times its block's key, and which of the block's), its edges' ends and their parts.

        The edges are checked once a loaded index.
        """
        found = self._table("graph")
        if not self._checked:
            dangling = found.select(F.explode("links").alias("vec_id")).join(found.select("vec_id"), "vec_id", "left_anti")
            if not dangling.isEmpty():
                raise ValueError("the graph has edges to nodes that are not there")
            self._checked = True
        return found

    def members(self) -> DataFrame:
        """``(cid, block_id, vec_id, v)`` of every row; codes are decoded."""
        return self._rows().select(F.shiftright("key", 40).alias("cid"), F.col("key").bitwiseAND((1 << 40) - 1).alias("block_id"), "vec_id", "v")

    def _rows(self) -> DataFrame:
        rows = self._table("members")
        if not self.params.coded:
            return rows
        told = [r["range"] for r in self._table("bounds").orderBy("dim").collect()]
        return rows.withColumn("v", quantize.decode(F.col("v"), [r.lo for r in told], [r.hi for r in told]))

    def _keyed(self) -> tuple[DataFrame, DataFrame]:
        """Members and block centroids under one number a block, which the members' files are sorted by."""
        key = F.col("cid") * F.lit(1 << 40) + F.col("block_id")
        return self._rows().select(F.col("key").alias("cid"), "vec_id", "v"), self.blocks().select(key.alias("cid"), "c", "reach")

    def knn(self, queries: DataFrame, k: int, nprobe: int, seen: Observation | None = None) -> DataFrame:
        """``(qid, rank, vec_id, score)``: the k best in the nprobe best blocks of each query; ``seen`` is told the distances made.

        Where that is every block there is nothing to choose, and all rows are searched without a table of probes.
        """
        members, blocks = self._keyed()
        if seen is None and nprobe >= blocks.count():
            return search.knn(queries, members.select("vec_id", "v"), k, self.params.metric)
        return search.ivf_knn(queries, members, blocks, k, nprobe, self.params.metric, True, seen)

    def probes_for(self, k: int, recall: float = 0.9, queries: int = 64) -> int:
        """How many blocks to probe for ``recall`` of the k best: doubled until rows of the index, asked as queries, reach it.

        The queries are chosen by a hash, their exact answers are searched among all rows, and
        their own rows do not count.
        """
        members, _ = self._keyed()
        asked = stored(cluster.hash_sample(members, queries, self.params.seed).select(F.col("vec_id").alias("qid"), F.col("v").alias("qv")), "index-queries")
        own = lambda df: df.where("qid <> vec_id")
        truth = stored(own(search.knn(asked, members, k + 1, self.params.metric)), "index-truth")
        most, n = self.blocks().count(), 16
        while n < most:
            met = evaluate.recall(own(self.knn(asked, k + 1, n)), truth).agg(F.sum("hits") / F.sum("wanted")).first()[0]
            if met is None or met >= recall + (1 - recall) / 4:
                return n
            n *= 2
        return most

    def walk(self, queries: DataFrame, parts: int, width: int, told: list | None = None) -> DataFrame:
        """``(qid, rank, vec_id, score)``: the nodes that a beam of ``width`` finds from the ``parts`` nearest parts, and as many that edges lead to.

        Over codes the beam goes by distances between codes; the nodes found are scored by their vectors.
        """
        near = search.probe(queries, self._table("routes"), parts).select("qid", "cid")
        if not self.params.graph_codes:
            return graph.beam_knn(near, queries, self.graph(), width, width, parts=parts, told=told)
        found = graph.beam_knn(near, queries, self.graph(), width, width, parts=parts, told=told, book=quantize.table_of(self._table("codebook")))
        pairs = found.select("qid", "vec_id").join(queries.select(F.col("qid").cast("long").alias("qid"), "qv"), "qid").join(self._nodes(), "vec_id")
        return search.ranked(pairs.select("qid", "vec_id", l2_sq(F.col("qv"), F.col("v")).alias("score")), width)

    def _nodes(self) -> DataFrame:
        """``(vec_id, v)``: the nodes' vectors, whether the graph has codes or not."""
        return self._table("nodes") if self.params.graph_codes else self.graph().select("vec_id", "v")

    def knn_by_graph(self, queries: DataFrame, k: int, nprobe: int, parts: int = 4, told: list | None = None) -> DataFrame:
        """``(qid, rank, vec_id, score)``: the k best in up to ``nprobe`` blocks that a beam finds in the graph from ``parts`` parts."""
        if self.params.metric != "l2":
            raise ValueError("the graph has squared distances; use knn for inner products")
        found = self.walk(queries, parts, max(self.params.beam, nprobe * self.params.sample), told)
        blocks = found.groupBy("qid", F.shiftright("vec_id", 4).alias("cid")).agg(F.min("score").alias("score"))
        at = F.row_number().over(Window.partitionBy("qid").orderBy("score", "cid"))
        probes = stored(blocks.withColumn("at", at).where(F.col("at") <= nprobe).select("qid", "cid"), "index-probes")
        return search.in_cells(probes, queries, self._keyed()[0], k, "l2", True)

    def range(self, queries: DataFrame, radius: float, factor: float | None = None) -> DataFrame:
        """``(qid, vec_id, score)``: all rows with a distance below ``radius``, or a likeness above it.

        Only blocks that can hold one are read, by the metric's bound over each block's reach.  With
        ``factor`` it is the blocks whose centroid is within ``radius * factor``, and rows of others are
        missed; that is for distances.
        """
        members, blocks = self._keyed()
        if factor is not None:
            if self.params.metric != "l2":
                raise ValueError("a factor is for squared distances")
            return search.ivf_range(queries, members, blocks, radius, factor, True)
        return search.range_pruned(queries, members, blocks, radius, blocks.select("cid", "reach"), True, self.params.metric)

    def range_by_graph(self, queries: DataFrame, radius: float, parts: int = 4, seeds: int = 20, factor: float = 1.0) -> DataFrame:
        """``(qid, vec_id, score)``: rows within ``radius`` in the blocks that the graph leads to.

        A beam finds ``seeds`` nodes a query; from them the edges are followed over nodes within
        ``radius * factor``.  The blocks of all those nodes are read, but for blocks whose centroid is
        farther than the radius and the block's reach together, which hold nothing within it.
        """
        if self.params.metric != "l2":
            raise ValueError("a range search wants squared distances")
        found = self.walk(queries, parts, max(self.params.beam, seeds)).where(F.col("rank") <= seeds).select("qid", "vec_id", "score")
        start = stored(found, "index-seeds")
        nodes = self.graph()
        edges = nodes.select(F.col("vec_id").alias("src"), F.explode("links").alias("dst"))
        met = graph.radius_expand(start.select("qid", "vec_id"), edges, self._nodes(), queries, radius * factor).select("qid", "vec_id", "score").unionByName(start)
        members, blocks = self._keyed()
        near = met.withColumn("cid", F.shiftright("vec_id", 4)).join(blocks.select("cid", "reach"), "cid")
        apart = F.sqrt(F.greatest("score", F.lit(0.0))) > radius**0.5 + 1e-9 + F.col("reach")
        # a block's first node is its centroid; what its other nodes tell is no bound
        probes = stored(near.where((F.col("vec_id").bitwiseAND(15) != 0) | ~apart).select("qid", "cid").distinct(), "index-probes")
        return search._cells(probes, queries, members, "l2", None, radius, True).drop("cid")


def _parted(nodes: DataFrame, seed: int) -> DataFrame:
    """``(cid, vec_id, v)``: nodes in parts of close ones, about PART_NODES each; parts are numbered from 0."""
    n = nodes.count()
    k = max(1, min(MOST_ROUTES, -(-n // PART_NODES)))
    sample = cluster.hash_sample(nodes, min(n, 64 * k), seed).cache()
    start = sample.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k)
    numbered = start.select((F.row_number().over(Window.orderBy(F.xxhash64("vec_id"), "vec_id")) - 1).cast("long").alias("cid"), F.col("v").alias("c"))  # k rows
    cents = cluster.lloyd(sample, numbered, 5)
    sample.unpersist()
    dealt = cluster._parts(search.assign(nodes, cents).select("cid", "vec_id", "v"), seed)
    known = dealt.select("cid", "part").distinct()  # a row a part
    known = known.withColumn("nth", (F.row_number().over(Window.orderBy("cid", "part")) - 1).cast("long"))
    return dealt.join(known, ["cid", "part"]).select(F.col("nth").alias("cid"), "vec_id", "v")
