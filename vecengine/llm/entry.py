"""The queries that bind the operators to the tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embeddings, html, merkle, pii, planes, ranked, sharding, simhash, substring, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the items."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("covered").alias("covered"), F.max("item_tokens").alias("item_tokens"), F.max("exact").alias("exact")
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the archive back."""
    payloads, headers = warc.archive(table(spark, sf_dir, "pages"))
    back = warc.parse(warc.records(payloads, headers))
    # a response's digest and length are those of the bytes read back; a revisit's are those its header tells
    own = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(own, F.octet_length("block").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("block", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, and decode its ids."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    back = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, decoded=True)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What substring dedup leaves of every document."""
    return substring.cut(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram
           FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)),
     f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
     c AS (SELECT DISTINCT g.doc_id, unnest(generate_series(g.i, g.i + 12)) AS k FROM g JOIN f USING (gram) WHERE f.first < g.doc_id),
     r AS (SELECT doc_id, list(k) AS ks FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(ks, []), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at a cosine of 0.95 or more."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
     u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
     l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
           WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
     r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
     c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
     n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


def op7_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids as shuffled planes, and read the table back."""
    table_ = planes.written(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return planes.checksums(table_)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a network fitted on the labels that may be learnt from."""
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(*toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return toxicity.score(docs, net).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    found = ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)
    return found.select("item_id", "rank", "doc_id", "score")


OP11_SQL = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
     f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
     d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
     a AS (SELECT count(*) AS cn, sum(n)::BIGINT AS cl FROM d),
     w AS (SELECT term, floor(1000 * ln((2 * any_value(cn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY term),
     q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
     s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * cn) // cl))))::BIGINT AS score
           FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), a GROUP BY item_id, doc_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what a check of each says after some texts lost their line breaks."""
    docs = table(spark, sf_dir, "documents")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(struck, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    now = merkle.leaf_hash(*[text if c == "text" else F.col(c) for c in merkle.FIELDS])
    found = merkle.manifest(docs.withColumn("leaf_now", now), keep=("leaf_now",))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), merkle.fold(F.col("leaf_now"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = """
WITH RECURSIVE
d AS (SELECT doc_id, coalesce('=' || source, '-') AS src,
             coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
             coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
             -- the checksum of the id's digits, bit by bit
             list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                                  lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)) AS crc
      FROM documents),
e AS (SELECT doc_id, src, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now, head FROM d),
l AS (SELECT doc_id, src, leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS leaf_now,
             row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY src) AS n FROM e),
t AS (SELECT 0 AS lvl, src, i, n, leaf AS h FROM l
      UNION ALL
      SELECT lvl + 1, src, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lvl, src, i // 3, n),
r AS (SELECT src, h AS subroot, row_number() OVER (ORDER BY src) - 1 AS i, count(*) OVER () AS n, lvl AS depth FROM t WHERE n = 1),
s AS (SELECT 0 AS lvl, i, n, subroot AS h FROM r
      UNION ALL
      SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM s WHERE n > 1 GROUP BY lvl, i // 3, n),
-- every node of both trees with what is hashed before and after it
a AS (SELECT x.lvl, x.src, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS b, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS c
      FROM t x JOIN t y ON x.lvl = y.lvl AND x.src = y.src AND x.i // 3 = y.i // 3 WHERE x.n > 1 GROUP BY x.lvl, x.src, x.i
      UNION ALL
      SELECT r.depth + x.lvl, r.src, r.i // (3 ** x.lvl)::BIGINT, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), ''), coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '')
      FROM r JOIN s x ON x.i = r.i // (3 ** x.lvl)::BIGINT JOIN s y ON x.lvl = y.lvl AND x.i // 3 = y.i // 3 WHERE x.n > 1 GROUP BY r.depth, x.lvl, r.src, r.i),
w AS (SELECT doc_id, l.src, l.i, leaf, depth, subroot, r.i AS nth, 0 AS lvl, leaf_now AS h, '' AS p FROM l JOIN r ON l.src = r.src
      UNION ALL
      SELECT doc_id, w.src, w.i, leaf, depth, subroot, nth, w.lvl + 1, sha256(b || h || c), p || b || c FROM w JOIN a ON a.lvl = w.lvl AND a.src = w.src
             AND a.i = CASE WHEN w.lvl < depth THEN w.i // (3 ** w.lvl)::BIGINT ELSE nth // (3 ** (w.lvl - depth))::BIGINT END)
SELECT doc_id, leaf, subroot, (SELECT h FROM s WHERE n = 1) AS root, sha256(p) AS proof_sha256, h AS folded_root, h = (SELECT h FROM s WHERE n = 1) AS verified
FROM w WHERE lvl = depth + (SELECT max(lvl) FROM s)
"""


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    found = pii.spans(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[of(k) for k in pii.KINDS], F.sha2(pii.told(F.col("base")), 256).alias("base_sha256"), pii.told(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_warc": op2_warc,
        "op3_bpe": op3_bpe,
        "op4_simhash": op4_simhash,
        "op5_substring": op5_substring,
        "op6_embeddings": op6_embeddings,
        "op7_planes": op7_planes,
        "op8_html": op8_html,
        "op9_toxicity": op9_toxicity,
        "op10_sharding": op10_sharding,
        "op11_ranked": op11_ranked,
        "op12_merkle": op12_merkle,
        "op13_pii": op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op5_substring": OP5_SQL, "op6_embeddings": OP6_SQL, "op11_ranked": OP11_SQL, "op12_merkle": OP12_SQL}
