"""The pipeline on a small table with planted cases."""

import numpy as np
import pytest

import corpus_pipeline
from vecengine.llm import entry

WORDS = [f"{a}{b}" for a in "ber ka lo mi nu or pe su ta vi".split() for b in "an el in or um ya zo da fi go".split()]


def prose(seed, n):
    g = np.random.default_rng(seed)
    return " ".join(g.choice(WORDS, n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    item, passage = prose(9000, 30), prose(9001, 60)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0 and i < 240
        words = prose(i, 150).split()
        if toxic:
            for k in (20, 60, 100):
                words.insert(k, "scumlike")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(400, rows[1][1]), (401, rows[2][1].replace(rows[2][1].split()[70], "edited", 1)), (402, prose(402, 40) + " " + item + " " + prose(403, 40))]
    rows += [(410, prose(410, 50) + " " + passage), (411, prose(411, 50) + " " + passage + " " + prose(412, 20)), (500, None), (501, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(9002, 25))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_planted_cases(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns or name == "bpe"
        if name == "substring_dedup":
            cut = {r.doc_id: r for r in docs.collect()}
    clean = {i for i in range(300) if not (i % 4 == 0 and i < 240)}
    assert len(clean - seen["toxicity"]) <= 2 and len(seen["toxicity"] & (set(range(240)) - clean)) <= 3
    assert not {400, 401} & seen["simhash_near_dedup"] and clean & seen["toxicity"] <= seen["simhash_near_dedup"]
    assert len(cut[411].text.split()) == len(cut[410].text.split()) - 60 + 20 and cut[411].n_chars == len(cut[411].text)
    assert cut[1].text == prose(1, 150)
    assert 402 not in seen["benchmark_decontamination"] and seen["simhash_near_dedup"] - {402} == seen["benchmark_decontamination"]
    assert seen["bpe"] == seen["benchmark_decontamination"]


def test_nulls_repeats_clashes_and_empty_tables(spark, folder, tmp_path):
    """Every stage keeps columns of any name, repeated rows and null ids, and takes an empty table."""
    text = prose(70, 80)
    rows = [(1, text), (1, text), (2, None), (None, text), (3, ""), (4, prose(71, 3)), (5, "x " * 20_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id int, cut_id int, leak_id int, text_before string, h int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, "b", 5) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        out = stage(spark, docs, folder).collect()
        if name != "bpe":
            assert out[0].asDict().keys() == set(docs.columns) and all((r.kept_id, r.cut_id, r.leak_id, r.text_before, r.h) == (1, 2, 3, "b", 5) for r in out)
        ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in out)
        near = [(False, 0), (True, 1), (True, 1), (True, 2), (True, 4), (True, 5)]  # the empty texts are one group
        every = sorted([*near, (True, 3)])
        if name == "toxicity":  # a few labels teach it nothing, so any rows may go
            assert set(ids) <= set(every)
        else:
            assert ids == (near if name == "simhash_near_dedup" else every)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in entry.queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
