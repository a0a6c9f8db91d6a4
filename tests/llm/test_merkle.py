"""The Merkle manifest against a plain one in Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vecengine.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root, and each node's siblings of every level as (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            k = at[i] - at[i] % 3
            p.append(("".join(nodes[k : at[i]]), "".join(nodes[at[i] + 1 : k + 3])))
        nodes, at = [H("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)], [a // 3 for a in at]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[b"" if row[3] is None else b"=" + row[3].encode()].append(row)
    subs, own = [], []
    for _, some in sorted(groups.items()):
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in some])
        subs.append(root)
        own.append((some, paths, root))
    if not subs:
        return []
    root, upper = tree(subs)
    return sorted((str(r[0]), leaf(r), sub, root, "".join(b + a for b, a in p + up)) for (some, paths, sub), up in zip(own, upper, strict=True) for r, p in zip(some, paths, strict=True))


def ours(docs):
    found = merkle.manifest(docs).withColumn("proof", merkle.proof(F.col("path"))).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert all(r.folded == r.root for r in found)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in found)


@pytest.mark.parametrize("case", ["large source", "odd rows", "many sources", "one row", "none"])
def test_manifest_is_the_plain_one(spark, case):
    rows = {
        "large source": [(i * 7 % 5000, f"text {i}", "en", "hot" if i % 50 else "cold", i) for i in range(4999)],
        "odd rows": [
            (1, None, None, None, None), (1, None, None, None, None), (1, "b", "en", None, 3), (None, "a", "en", "", 1), (None, "c", "en", "", 1), (2, "", "", "é", 0),
            (-5, "x\ny" * 3000, "de", "z", 2), (3, "q", "de", "Z", 2), (9, "w", "fr", "-", 2), (9, "w", "fr", "=", 2),
        ],
        "many sources": [(i, "same", "en", f"s{i % 700}", 4) for i in range(2500)],
        "one row": [(4, "alone", "en", "src", 5)],
        "none": [],
    }[case]
    assert ours(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_kept_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a\nb", "en", "s", 3) for i in range(5)], SCHEMA)
    docs = docs.withColumns({"g": F.lit(1), "pos": F.lit(2), "n": F.lit(3), "path": F.col("doc_id") * 2})
    found = merkle.manifest(docs, keep=("n", "doc_id"))
    assert found.columns[:6] == ["doc_id", "source", "leaf", "path", "subroot", "root"]
    assert {tuple(r)[6:] for r in found.collect()} == {(3, i) for i in range(5)}


def test_a_changed_text_does_not_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"line\n{i}", "en", f"s{i % 3}", 6) for i in range(40)], SCHEMA)
    changed = merkle.leaf_hash(*[F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.FIELDS])
    found = merkle.manifest(docs.withColumn("now", changed), keep=("now",))
    assert found.where(merkle.fold(F.col("now"), F.col("path")) == F.col("root")).count() == 0
