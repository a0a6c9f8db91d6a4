"""Personal data: base spans against Python's re, and the spans that the votes add."""

import random
import re
import time

from pyspark.sql import functions as F

from vecengine.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def base_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [[tuple(s) for s in r.base] for r in pii.spans(docs).orderBy("doc_id").collect()]


def test_base_spans_are_those_of_the_patterns(spark):
    g = random.Random(3)
    parts = ["a", "Z9", "@", ".", "-", "+", " ", "1", "42", "255", "256", "0", "é", "😀", "(", ")", "_", "%", "a@b.c", "1.2.3.4", "4111111111111111", "+1 (555) 123-4567", "\n", "4111 1111-1111 1111"]
    texts = ["".join(g.choice(parts) for _ in range(g.choice((3, 12, 60)))) for _ in range(1500)]
    texts += [None, "", "a@b.c_x@y.z", "a@b@c.d", "1.2.3.4.5.6.7.8.9", "1- 2 - 3", "+1((((", "00255.1.1.0001", "x@y..z", "1.2.3", "😀 a@b.co 😀 1.2.3.4"]
    assert base_of(spark, texts) == [brute(t) for t in texts]


def test_many_matches_and_long_runs_take_no_more_than_a_pass(spark):
    texts = ["1.2.3.4, a@b.c; " * 3000, "a." * 100_000, "1" * 300_000, "+1" + "(" * 200_000, "a@b" + ".c" * 50_000, "1." * 100_000, "a@" * 50_000]
    began = time.perf_counter()
    assert base_of(spark, texts) == [brute(t) for t in texts[:1]] + [[], [], [], [("email", 0, 100_003)], [("ip", 8 * i, 8 * i + 7) for i in range(25_000)], []]
    assert time.perf_counter() - began < 60


def planted(g):
    """Documents with base forms, other forms that are personal, and what only looks like them."""
    def number(n):
        d = ["4", *[str(g.randrange(10)) for _ in range(n - 2)]]
        return next("".join(d) + c for c in "0123456789" if sum(x - 9 * (x > 9) for x in [int(y) * (1 + i % 2) for i, y in enumerate(reversed("".join(d) + c))]) % 10 == 0)

    digits = lambda n: "".join(str(g.randrange(10)) for _ in range(n))
    rows, want = [], {}
    for i in range(600):
        host = g.choice(("example.com", "mail.net", "uni.de"))
        kind, hit, word = [
            (None, f"u{i}@{host}", "email"), (None, f"+1 (212) 555-{digits(4)}", "phone"), (None, number(16), "card"), (None, f"{g.randrange(11, 220)}.{g.randrange(256)}.9.77", "host"),
            ("email", f"u{i} [at] {host.replace('.', ' [dot] ')}", "mail"), ("phone", f"(212) 555-{digits(4)}", "call"), ("ip", f"{g.randrange(11, 220)}[.]{g.randrange(256)}[.]9[.]77", "server"),
            ("none", f"{digits(3)}-{digits(3)}-{digits(4)}x", "order"), ("none", f"{digits(20)}", "serial"), ("none", f"1.2.{g.randrange(300, 900)}.4", "version"),
        ][i % 10]
        before = f"Some words and {word}: "
        rows.append((i, f"{before}{hit} and more words."))
        want[i] = (kind, len(before), len(before) + len(hit))
    return rows, want


def test_other_forms_are_added_and_what_only_looks_alike_is_not(spark):
    rows, want = planted(random.Random(8))
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i, (kind, start, end) in want.items():
        extra = [s for s in found[i] if s not in brute(texts[i])]
        assert set(brute(texts[i])) <= set(found[i])
        assert extra == ([(kind, start, end)] if kind in pii.KINDS else []), texts[i]


def test_estimates_follow_the_votes(spark):
    rows, _ = planted(random.Random(9))
    model = pii.train(pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert model.reliability["phone|l2:1"] > 0  # telling words speak for a phone number
    assert model.weights["ip|check:1"] > model.weights["ip|check:-1"]


def test_odd_rows_and_names(spark):
    docs = spark.createDataFrame([(None, "a@b.c"), (1, None), (1, ""), (2, "a@b.c"), (2, "a@b.c")], "doc_id long, text string")
    docs = docs.withColumns({"found": F.lit(1), "email": F.lit(2), "spans": F.lit(3), "p": F.lit(4)})
    rows = pii.spans(docs).collect()
    assert sorted((str(r.doc_id), len(r.base), len(r.spans)) for r in rows) == [("1", 0, 0), ("1", 0, 0), ("2", 1, 1), ("2", 1, 1), ("None", 1, 1)]
    assert pii.spans(docs.limit(0)).collect() == []


def test_no_python_worker_runs(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.spans(spark.createDataFrame(docs.collect(), docs.schema).coalesce(1))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
