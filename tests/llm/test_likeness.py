"""Groups of like texts against exact likeness of shingle sets."""

import numpy as np
from pyspark.sql import functions as F

from vecengine.llm import likeness


def test_like_texts_are_grouped_and_others_are_not(spark):
    g = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(40):
        words = list(g.choice(vocabulary, 300))
        rows.append((10 * i, " ".join(words)))
        words[150] = "changed"
        rows.append((10 * i + 1, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1000, None)]
    found = {r.doc_id: r.component_id for r in likeness.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[10 * i + 1] == 10 * i for i in range(40)) >= 39
    assert all(found[10 * i] == 10 * i for i in range(40)) and found[1001] == 1000
    kept = likeness.first_of_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.where("doc_id = 1000").count() == 2 and kept.columns == ["doc_id", "text"]


def test_all_pairs_of_large_buckets_are_compared(spark, monkeypatch):
    """Two families in one bucket, of which a star from one member links only that member's own."""
    monkeypatch.setattr(likeness, "BLOCK", 16, raising=False)
    g = np.random.default_rng(12)
    families = [[f"w{i}" for i in g.integers(0, 4000, 400)] for _ in range(2)]
    rows = []
    for i in range(80):
        words = list(families[i % 2])
        words[5 * (i // 2) + 3] = f"own{i}"
        rows.append((i, " ".join(words)))
    sketched = likeness.sketches
    monkeypatch.setattr(likeness, "sketches", lambda *a: sketched(*a).withColumn("codes", F.expr("array_repeat(0L, 24)")))
    found = {r.doc_id: r.component_id for r in likeness.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i % 2 for i in range(80)}


def test_likeness_is_that_of_the_shingle_sets(spark):
    """Texts a little under 0.8 stay apart, those a little over are grouped, and repeats weigh once."""
    g = np.random.default_rng(14)
    line = " ".join(f"line{i}" for i in range(20))
    rows, over = [], []
    for i in range(60):
        words = [f"t{i}x{k}" for k in range(304)]  # 300 shingles; each word changed by itself costs five
        changed = list(words)
        for k in range(6 if i % 2 else 8):
            changed[10 + 30 * k] = f"new{k}"
        shared = 300 - 5 * (6 if i % 2 else 8)
        assert (shared / (600 - shared) >= 0.8) == bool(i % 2)
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(changed))]
        over.append(bool(i % 2))
    for i in range(6):
        rows.append((5000 + i, f"{line} " * 40 + " ".join(f"y{x}" for x in g.integers(0, 10**9, 60))))
    found = {r.doc_id: r.component_id for r in likeness.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[5000 + i] == 5000 + i for i in range(6))
    assert not any(found[10 * i + 1] == 10 * i for i in range(60) if not over[i])
    assert sum(found[10 * i + 1] == 10 * i for i in range(60) if over[i]) >= 27


def exact(texts, size=5):
    """The shingle sets of texts, by their words."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return sets


def test_recall_of_pairs_just_over_the_similarity(spark):
    """Copies with scattered and with joined edits, alike to 0.80 to 0.85 by brute force: at least nine in ten are grouped."""
    g = np.random.default_rng(21)
    common = [f"c{i}" for i in range(300)]
    rows, want = [], []
    for i in range(400):
        n = int(g.integers(60, 500))
        words = [str(x) for x in g.choice(common, n)]
        for k in g.choice(n, n // 3, replace=False):
            words[k] = f"own{g.integers(0, 20000)}"
        changed = list(words)
        while True:
            at, run = int(g.integers(0, n)), int(g.integers(1, 5))
            after = [*changed[:at], *(f"e{x}" for x in g.integers(0, 10**6, run)), *changed[at + run :]][:n]
            a, b = exact([" ".join(words), " ".join(after)])
            if len(a & b) < 0.8 * len(a | b):
                break
            changed = after
        a, b = exact([" ".join(words), " ".join(changed)])
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
        if len(a & b) < 0.85 * len(a | b):
            want.append(i)
    found = {r.doc_id: r.component_id for r in likeness.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 200 and all(found[2 * i] == 2 * i for i in range(400))
    assert sum(found[2 * i + 1] == 2 * i for i in want) >= 0.9 * len(want)


def test_groups_of_drifting_copies(spark, monkeypatch):
    """A family in one bucket, each member changed from the one before: the groups are the components of exact likeness."""
    sketched = likeness.sketches
    monkeypatch.setattr(likeness, "sketches", lambda *a: sketched(*a).withColumn("codes", F.expr("array_repeat(0L, 24)")))
    g = np.random.default_rng(22)
    words = [f"w{i}" for i in g.integers(0, 3000, 200)]
    texts = []
    for i in range(60):
        for k in g.choice(200, 4 if i % 10 else 40, replace=False):
            words[k] = f"d{i}x{k}"
        texts.append(" ".join(words))
    sets = exact(texts)
    label = list(range(60))
    for _ in range(60):
        label = [min(label[j] for j in range(60) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(60)]
    found = {r.doc_id: r.component_id for r in likeness.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == dict(enumerate(label)) and len(set(label)) > 3


def test_bits_and_sketches_are_those_of_every_hash():
    g = np.random.default_rng(23)
    sets = [np.unique(g.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (1, 3, 300, 1000)]
    sets.insert(2, np.zeros(0, np.uint64))
    margins = likeness.bit_margins(sets, 2)
    for s, got in zip(sets, margins, strict=True):
        for w in range(2):
            x = likeness._mixed(s + np.uint64((w + 1) * 0xD1342543DE82EF95 % 2**64))
            assert [2 * int(((x >> np.uint64(b)) & np.uint64(1)).sum()) - len(s) for b in range(64)] == got[64 * w : 64 * w + 64].tolist()
    for s, got in zip(sets, likeness.least_sketch(sets).view(np.uint64), strict=True):
        nibbles = [sum((int(got[4 * p + b // 64]) >> (b % 64) & 1) << p for p in range(4)) for b in range(256)]
        for b in range(256):
            own = [int(x) for x in s if int(x) >> 56 == b]
            assert nibbles[b] == (1 + (min(own) & 0xFFFFFF) % 15 if own else 0)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text, 1, 2), (5, text, 1, 2), (9, text.upper(), 3, 4), (None, text, 5, 6), (None, "alone", 7, 8), (12, "one two", 9, 10), (13, "one two", 9, 10), (20, "x " * 30000, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id int, KEPT_ID_ int")
    groups = likeness.similar_groups(docs)
    got = sorted((r.doc_id or 0, -1 if r.component_id is None else r.component_id) for r in groups.collect())
    assert got == [(0, -1), (0, 5), (5, 5), (5, 5), (9, 5), (12, 12), (13, 12), (20, 20)]
    kept = likeness.first_of_group(docs)
    assert kept.columns == docs.columns and sorted(r.kept_id for r in kept.collect()) == [0, 1, 1, 5, 7, 9]
    assert likeness.first_of_group(docs.limit(0)).count() == 0
