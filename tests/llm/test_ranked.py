"""Ranked search against the scores of all pairs in Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vecengine.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string"


def terms(text):
    return Counter(x.translate(LOWER) for x in TERM.findall(text or ""))


def brute(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t, sum(t.values())) for i, t in held if t]
    n, total = len(held), sum(s for _, _, s in held)
    df = Counter(x for _, t, _ in held for x in t)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc_id, tf, size in held:
            m = 100 - 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in wanted if x in tf)
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ours(spark, docs, items, k):
    d, q = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.search(d, q, k).collect()), key=str)


def corpus(n, seed=5):
    g = random.Random(seed)
    words = ["".join(g.choice("abcdefé9") for _ in range(g.randint(1, 5))) for _ in range(300)]
    text = lambda: " ".join(words[min(int(g.expovariate(0.02)), 299)] for _ in range(g.choice((3, 40, 40, 400))))
    return [(i, text()) for i in range(n)], [(i, text()) for i in range(12)]


def test_scores_are_those_of_all_pairs(spark):
    docs, items = corpus(400)
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # copies tie, and go by id
    items.append((99, docs[7][1]))
    assert ours(spark, docs, items, 10) == brute(docs, items, 10)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " .,- "), (None, "Apple pie"), (4, "Apple PIE apple"), (4, "Apple PIE apple"), (4, "pear"), (5, "ÄPPLE äpple"), (6, "x" * 70_000 + " apple"),
        (7, "apple " * 50_000), (8, "a-b_c`d[e{f\x00g/h:i@j\x7fk"), (-9, "pie pie"), (10, "pear " + "unlike " * 30),
    ]
    items = [(1, "APPLE pie"), (2, None), (3, ""), (4, "nowhere"), (5, "pear"), (5, "pie"), (None, "äpple k"), (6, "pie pie")]
    assert ours(spark, docs, items, 3) == brute(docs, items, 3)
    assert ours(spark, docs, [], 3) == [] and ours(spark, [], items, 3) == []


def test_rounds_shuffled_texts_and_loose_signatures(spark, monkeypatch):
    docs, items = corpus(200, 6)
    want = brute(docs, items, 5)
    monkeypatch.setattr(ranked, "MOST_PAIRS", 100)
    assert ours(spark, docs, items, 5) == want
    monkeypatch.setattr(ranked, "SENT", 0)
    monkeypatch.setattr(ranked, "FIRST", 1)
    assert ours(spark, docs, items, 5) == want


def test_bounds_hold_and_leave_most_documents_out(spark):
    docs, items = corpus(400, 8)
    df = spark.createDataFrame(docs, SCHEMA)
    pairs = [(i, t) for i, text in items for t in {x.encode() for x in terms(text)}]
    blocks = ranked.index(df, sorted({t for _, t in pairs}))
    n, total = ranked.totals(blocks)
    held = ranked._Items(pairs, ranked._frequencies(blocks), n, total)
    bound = {(r.item, r.doc_id): r.bound for r in ranked._bounded(blocks, held, 1, [0.0] * len(held.names)).collect()}
    exact = brute(docs, items, 400)
    nth = {x: i for i, x in enumerate(held.names)}
    assert exact and all(bound[nth[item], doc] >= score for item, _, doc, score in exact)
    near = sum(bound[nth[item], doc] <= 1.1 * score for item, _, doc, score in exact)
    assert near > 0.9 * len(exact)


@pytest.mark.parametrize("size", [1, 1 << 10])
def test_terms_of_a_text_in_pieces(size, monkeypatch):
    monkeypatch.setattr(ranked, "PIECE", size)
    text = "Ab c-é9 " * 500 + "Z"
    assert ranked.terms_of(text.encode()) == {k.encode(): v for k, v in terms(text).items()}


def test_other_columns_may_have_any_name(spark):
    docs, items = corpus(40, 9)
    d = spark.createDataFrame(docs, SCHEMA).withColumns({"item": F.lit(1), "items": F.lit(2), "p": F.lit(3), "score": F.lit(4), "bound": F.lit(5)})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "term": F.lit(2), "item": F.lit(3)})
    assert sorted((tuple(r) for r in ranked.search(d, q, 5).collect()), key=str) == brute(docs, items, 5)
