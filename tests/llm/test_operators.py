"""The operators against brute force, on small tables with nulls, empty and odd texts, ties and repeated rows."""

import hashlib
import math
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecengine.llm import bpe, components, decontaminate, embeddings, html, planes, sharding, simhash, substring, toxicity, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "the of and inth erer onst wh ti ble sh Ñandú łódź 日本 a I 42 don't x--y".split()


def prose(seed, n):
    g = np.random.default_rng(seed)
    return " ".join(g.choice(WORDS, n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(i, 60) for i in range(12)]
    out = [None, "", " ", "\t\n", "one", "one two", "ONE two", *base, *base[:4], base[0] + " tail", "x " + base[1][:200], base[2].upper()]
    out += ["a  b\n\n c<|endoftext|> d", "<|endoftext|>", "\x1c\x85\xa0　 .", "é" * 5000, "word " * 3000, base[5] + "\n" + base[6], "é 👍🏽 ​ z"]
    return [(i * 3 + 1, t) for i, t in enumerate(out)] + [(7, "one two"), (None, base[0]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns have names that operators use inside."""
    rows = [(i, t, "x", 1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, mark string, fp long").repartition(3)


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_components(spark):
    g = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in g.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 160)]
    label = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in range(200):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = components.connected_components(spark.createDataFrame(pairs, "u long, v long"))
    assert {r.node: r.root for r in found.collect()} == label
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 4


def slow_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps):
    label = [i if i is not None else 1 << 60 for i in ids]
    while True:
        new = [min(b for b, g in zip(label, fps, strict=True) if (f ^ g).bit_count() <= 2) for f in fps]
        if new == label:
            return [None if x == 1 << 60 else x for x in label]
        label = new


@pytest.mark.parametrize("paired", [64, 1])
def test_simhash_against_all_pairs(docs, texts, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    ids, fps = [i for i, _ in texts], [slow_fingerprint(t) for _, t in texts]
    want = sorted(zip(ids, fps, brute_components(ids, fps), strict=True), key=repr)
    got = [(i, f % 2**64, c) for i, f, c in collect(simhash.near_duplicates(docs))]
    assert sorted(got, key=repr) == want


@pytest.mark.parametrize("paired", [64, 1])
def test_links_of_close_fingerprints(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    g = np.random.default_rng(2)
    fps = {int(x) for x in g.integers(-(2**63), 2**63, 30)}
    for f in list(fps)[:10]:
        for _ in range(12):
            a, b = g.integers(0, 64, 2)
            v = (f ^ (1 << int(a)) ^ (1 << int(b))) % 2**64
            fps.add(v - 2**64 if v >= 2**63 else v)
    fps = sorted(fps)
    found = {r.node: r.root for r in components.connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    label = {f: f for f in fps}
    while True:
        new = {f: min(label[h] for h in fps if ((f ^ h) % 2**64).bit_count() <= 2) for f in fps}
        if new == label:
            break
        label = new
    assert {f: found.get(f, f) for f in fps} == label


def test_variants_of_fingerprints_are_not_broadcast(spark, monkeypatch, tmp_path):
    """2,000 fingerprints are a file below the threshold, their 128,000 variants far above it."""
    g, plans = np.random.default_rng(4), []
    spark.createDataFrame([(int(x),) for x in g.integers(-(2**63), 2**63, 2000)], "fp long").write.parquet(str(tmp_path / "fps"))

    def kept(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(simhash, "stored", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        kept(simhash.links(spark.read.parquet(str(tmp_path / "fps"))), "links")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and "BroadcastExchange" not in "".join(plans)


# 10


def test_sharding(docs, texts):
    rows = sharding.shard(docs, 5).collect()
    assert len(rows) == len(texts)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts if i is not None)
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    counts = [sum(r.shard == s for r in rows) for s in range(5)]
    assert max(counts) - min(counts) <= 1
    again = sharding.shard(docs.repartition(7), 5).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def slow_feistel(x, n, seed, hashed):
    """The network and the walk, row by row."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))
    while True:
        left, right = divmod(x, b)
        for i in range(6):
            if i % 2 == 0:
                left = (left + hashed[seed, i, right] % a) % a
            else:
                right = (right + hashed[seed, i, left] % b) % b
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 7, 100, 131])
def test_permutation_against_brute_force(spark, n):
    keys = spark.range(200).crossJoin(spark.range(6).toDF("i")).select("id", F.col("i").cast("int").alias("i"))
    hashed = {(5, r.i, r.id): r.h for r in keys.select("id", "i", F.xxhash64(F.lit(5), "i", "id").alias("h")).collect()}
    got = {r.id: r.p for r in spark.range(n).select("id", sharding.permuted(F.col("id"), n, 5).alias("p")).collect()}
    assert got == {x: slow_feistel(x, n, 5, hashed) for x in range(n)}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 99, 100, 101, 1000])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7)).collect()]
    assert sorted(got) == list(range(n))
    assert n < 99 or got != sorted(got)


# 2


def test_warc(spark):
    long_, other = "ä" * 100, "b" * 99
    rows = [(5, "http://a/1", long_), (3, "http://a/é\r\n2", long_), (9, None, long_), (4, "u", other), (6, "u", other), (7, "u", None), (8, "u", ""), (None, "u", long_), (11, "u", "c" * 5000), (11, "u", "c" * 5000), (12, "u", "x\r\n\r\ny" * 40)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    payloads, headers = warc.archive(pages)
    assert payloads.count() == len({(h or "") for _, _, h in rows})
    got = collect(warc.parse(warc.records(payloads, headers)))
    want = []
    for i, u, h in rows:
        b = (h or "").encode()
        first = min((k for k, _, g in rows if (g or "") == (h or "") and k is not None), default=None)
        again = len(b) >= 100 and i != first
        u = None if u is None else u.replace("\r", "%0D").replace("\n", "%0A")
        want.append((i, u, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None, bytearray() if again else bytearray(b)))
    assert got == sorted(want, key=repr)
    with pytest.raises(Exception, match="altered|Zstd|digest"):
        warc.records(payloads.withColumn("digest", payloads.digest.substr(2, 99)), headers).count()
        warc.records(payloads.limit(1), headers).collect()
    assert warc.parse(warc.records(*warc.archive(pages.limit(0)))).count() == 0


# 3 and 7


def test_bpe_is_that_of_the_library(docs, texts):
    library = Tokenizer.from_file(BPE)
    rows = bpe.encode(docs, BPE, decoded=True).collect()
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in texts), key=repr)
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in rows), key=repr) == want
    back = bpe.decode(bpe.encode(docs, BPE), BPE)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in texts), key=repr)


def test_trie_on_random_strings():
    library = Tokenizer.from_file(BPE)
    coder = bpe.Encoder(bpe.Vocabulary(open(BPE, encoding="utf-8").read()))
    g = np.random.default_rng(4)
    alphabet = list(" \n\taAéß'slt1٣!日\x85　.,e") + ["<|endoftext|>", "the", " in"]
    texts = ["".join(g.choice(alphabet, g.integers(0, 40))) for _ in range(3000)]
    for t, packed in zip(texts, coder.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == want and coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_a_byte_takes_one_step_and_small_tables_do_no_harm(monkeypatch):
    library, spec = Tokenizer.from_file(BPE), open(BPE, encoding="utf-8").read()
    coder = bpe.Encoder(bpe.Vocabulary(spec))
    g = np.random.default_rng(22)
    batches = [[" ".join("".join(g.choice(list("etaoinéß1-"), g.integers(1, 12))) for _ in range(60)) for _ in range(20)] for _ in range(4)]
    asked = []

    class Counted(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    coder.encode([t for ts in batches for t in ts[:19]])
    coder.vocabulary.ids = Counted(coder.vocabulary.ids)
    coder.encode([ts[19] for ts in batches])
    assert len(asked) < 0.2 * sum(len(ts[19].encode()) for ts in batches)
    for name in ("KEPT_CHUNKS", "KEPT_STEPS", "KEPT_FITS"):
        monkeypatch.setattr(bpe, name, 30)
    coder = bpe.Encoder(bpe.Vocabulary(spec))
    for ts in batches:
        for t, packed in zip(ts, coder.encode(ts), strict=True):
            assert np.frombuffer(packed, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(n, bits):
    ids = np.random.default_rng(n).integers(0, 2**32 if n == 8 else 50_257, n).astype("<u4")
    packed = planes.shuffle_block(ids, bits)
    assert len(packed) == (32 if bits else 4) and planes.unshuffle_block(packed, n).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [False, True])
def test_token_table(docs, texts, monkeypatch, bits):
    library = Tokenizer.from_file(BPE)
    table = planes.written(docs, BPE, bits=bits)
    at, want = 0, []
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    known = {r[0] for r in order}
    for i, t in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), ids))
        at += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, list(r.ids)) for r in planes.read(table).collect()), key=lambda r: r[1])
    assert None in known and [g[1] + g[2] for g in got][-1] == at
    loose = {7, None}  # rows that share an id may come in any order
    assert [g for g in got if g[0] not in loose] == [w for w in want if w[0] not in loose]
    crc = {r.doc_id: r.ids_crc32 for r in planes.checksums(table).collect()}
    assert all(crc[i] == zlib.crc32(np.array(ids, "<u4").tobytes()) for i, _, _, ids in want if i not in loose)
    assert planes.read(planes.written(docs.limit(0), BPE)).count() == 0


# 5


def slow_cut(rows, n=13):
    first = {}
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in cut:
        if i is not None:
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_against_all_windows(spark, docs, texts):
    g = np.random.default_rng(5)
    passage = prose(77, 55)
    more = [(1000 + i, prose(200 + i, int(g.integers(5, 40))) + " " + passage[int(g.integers(0, 60)) :] + " " + prose(300 + i, 20)) for i in range(25)]
    more += [(1003, "a repeated id " + passage), (2000, "the " * 40), (2001, "the " * 13), (2002, "the " * 12), (1999, "of the " * 30)]
    rows = texts + more
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    found = substring.cut(every).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert collect(found) == slow_cut(rows)
    assert substring.cut(every.limit(0)).count() == 0
    left = {r.doc_id: r.text for r in substring.cut_texts(every).collect()}
    assert left[2000] == "the " * 40 and left[2001] == "" and left[2002] == "the " * 12
    assert left[1] is None and substring.cut_texts(docs).columns == docs.columns and substring.cut_texts(every).count() == every.count()


# 6


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    g = np.random.default_rng(6)
    x = g.standard_normal((120, 16))
    x = np.concatenate([x, x[:20] + g.normal(0, 0.05, (20, 16)), x[:1] + g.normal(0, 0.03, (50, 16)), x[5:8], 3 * x[9:10]])
    rows = [(i, [float(np.float32(z)) for z in v]) for i, v in enumerate(x)]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] + [1.0] * 15), (504, [float("inf")] * 16), (505, []), (3, rows[3][1])]
    rows += [(600 + i, [float(np.float32(z)) for z in v]) for i, v in enumerate([x[0, :8], x[0, :8] + 0.01, x[1, :8], -x[0, :8]])] + [(610, [1.0] * 5)]
    found = embeddings.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, n int"))
    sound = [i for i, (_, v) in enumerate(rows) if v and all(z is not None and np.isfinite(z) for z in v) and any(v)]
    m = np.zeros((len(rows), 32))
    for i in sound:  # vectors of different lengths are at right angles
        at = {16: 0, 8: 16, 5: 24}[len(rows[i][1])]
        m[i, at : at + len(rows[i][1])] = np.array(rows[i][1]) / np.linalg.norm(rows[i][1])
    link = m @ m.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.array([r[0] for r in rows])
    while True:
        new = np.minimum(label, np.where(link, label[None, :], 1 << 60).min(axis=1))
        if (new == label).all():
            break
        label = new
    want = sorted(zip([r[0] for r in rows], link.sum(axis=1).tolist(), label.tolist(), [r[0] == c for r, c in zip(rows, label, strict=True)], strict=True), key=repr)
    assert collect(found) == want
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 1


def test_decontamination(spark):
    q = "If Tom buys 12 apples at 3 dollars each and sells 5 apples to Anna, then how many apples does Tom keep in the basket?"
    like = q.replace("Tom", "Maria").replace("12", "40").replace("Anna", "Peter")
    docs = [
        (1, prose(1, 30) + " end. " + q + " more words"), (2, "So. " + like), (3, like.replace("does Maria", "does Klaus")), (4, prose(4, 200)),
        (5, None), (6, ""), (7, "If " * 50), (1, prose(1, 30) + " end. " + q + " more words"), (None, q), (8, q.upper().replace("APPLES", "apples")), (9, " ".join(q.split()[:6])),
    ]
    bench = [(10, q), (11, prose(99, 40)), (12, None), (13, "too short"), (10, q)]
    make = lambda rows, id_: spark.createDataFrame([(*r, 0) for r in rows], f"{id_} long, text string, h int")
    found = decontaminate.matches(make(docs, "doc_id"), make(bench, "item_id"))
    got = {(r.doc_id, r.item_id): r.exact for r in found.collect()}
    assert got == {(1, 10): True, (2, 10): False, (None, 10): True, (8, 10): True}
    kept = decontaminate.clean(make(docs, "doc_id"), make(bench, "item_id"))
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 9} and kept.columns == ["doc_id", "text", "h"]
    assert decontaminate.matches(make(docs, "doc_id").limit(0), make(bench, "item_id")).count() == 0
    assert decontaminate.clean(make(docs, "doc_id"), make(bench, "item_id").limit(0)).count() == len(docs)


def test_word_runs_against_brute_force(spark):
    """Copies of 13 words of an item, or of a whole shorter one, whatever the words are: numbers, capitals, names."""
    g = np.random.default_rng(15)
    kinds = ["12", "7.5", "APPLE", "Anna", "Bo", "km", "tree", "the", "99", "Of"]
    bench = [(i, " ".join(g.choice(kinds, int(g.integers(3, 22))))) for i in range(40)]
    docs = [(i, " ".join(g.choice(kinds, 60))) for i in range(20)]
    for i in range(60):
        item = bench[int(g.integers(0, 40))][1].split()
        cut = item[: int(g.integers(3, 22))]
        docs.append((100 + i, f"lead{i} {' '.join(cut).upper()}, tail{i} " + " ".join(g.choice(kinds, 30))))
    low = lambda t: [w for w in (re.sub(r"^\W+|\W+$", "", x).lower() for x in t.split()) if w]
    want = set()
    for i, t in docs:
        w = low(t)
        for k, item in bench:
            own = low(item)
            n = min(13, len(own))
            if n >= 5:
                runs = {tuple(own[a : a + n]) for a in range(len(own) - n + 1)}
                if any(tuple(w[a : a + n]) in runs for a in range(len(w) - n + 1)):
                    want.add((i, k))
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert want <= got and len(want) > 20


def test_runs_are_consistent_both_ways():
    hits = lambda *vs: [(k, [0, a], [0, b]) for k, a, b in vs]

    def told(hits, window):
        covered, ways = decontaminate.consistent_tokens(hits, window)
        return covered, any(all(x == y for x, y in way.items()) for way in ways)

    assert told(hits((0, 1, 1), (1, 2, 2)), 8) == (9, True) and told(hits((0, 1, 5), (1, 2, 6)), 8) == (9, False)
    assert told(hits((0, 1, 5), (1, 1, 6)), 8) == (0, False)  # one value of the item for two of the document
    assert told(hits((0, 1, 5), (1, 2, 5)), 8) == (0, False)  # two values of the item on one of the document
    assert told(hits((0, 1, 5), (20, 1, 5)), 8) == (16, False)
    assert told(hits((0, 1, 5), (20, 1, 6), (21, 1, 6)), 8) == (9, False)  # two runs that go against each other
    assert told(hits((0, 1, 5), (1, 1, 6), (20, 1, 1)), 8) == (8, True)
    assert told([(0, [1, 1], [5, 6])], 8) == (0, False)


def test_short_items_match_by_whole_templates(spark):
    """Other numbers and names in a short question; its frame within other words, and mixed values, only where told."""
    bench = [(1, "What is 12 plus 7 times 3?"), (2, "Anna has 5 apples, Bob has 9."), (3, "add two and two"), (4, "Is it 4?"), (5, "Why not?"), (6, "12 7 3"), (7, "")]
    texts = [
        "Now tell. What is 14 plus 9 times 5? I ask.",
        "Then Peter has 7 apples, Tom has 3 of them",  # a frame of five tokens needs no sentence
        "Peter has 7 apples, Tom has 7.",  # 5 and 9 are both 7
        "Peter has 7 apples, Peter has 3.",
        "please add two and two now",
        "It is late. Is it 8? Yes.",
        "tell me\nis it 8\nor so",  # a line
        "but is it 8 or not",
        "Why not? Because.",
        "so why not now",
        "3 7 12", "so 12 7 3 so", "12 7 3", "what is 14 plus 9 times", None, "",
    ]
    docs = [(k, t) for k, t in enumerate(texts)]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.exact for r in found.collect()}
    want = {(0, 1): False, (1, 2): False, (4, 3): True, (5, 4): False, (6, 4): False, (8, 5): True, (12, 6): True}
    assert got == want


def test_whole_templates_against_brute_force(spark):
    """Frames of up to 24 tokens in lower-case texts: what the operator finds is what a scan of all places finds."""
    g = np.random.default_rng(16)
    draw = lambda n: [str(g.choice(["add", "to", "of", "how", "12", "7", "9", "40"])) for _ in range(n)]
    bench = [(i, " ".join(draw(int(g.integers(5, 8))))) for i in range(60)]
    swap = {"12": "31", "7": "32", "9": "33", "40": "34"}
    docs = [(i, " ".join(draw(40))) for i in range(60)]
    for i in range(60):
        item = bench[int(g.integers(0, 60))][1].split()
        docs.append((100 + i, " ".join(draw(20) + [swap.get(w, w) if i % 3 else w for w in item] + draw(20))))
    num = str.isdigit
    want = set()
    for i, t in docs:
        w = t.split()
        for k, item in bench:
            own = item.split()
            words, n = sum(not num(x) for x in own), len(own)
            for a in range(len(w) - n + 1):
                pairs = set(zip(own, w[a : a + n], strict=True))
                same = all(x == y or (num(x) and num(y)) for x, y in pairs)
                fits = len({x for x, y in pairs if num(x)}) == len({p for p in pairs if num(p[0])}) == len({y for x, y in pairs if num(x)})
                bounded = a == 0 and n == len(w)
                if all(x == y for x, y in pairs) or (same and fits and 0 < words < n and (words >= 3 or bounded)):
                    want.add((i, k))
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) > 50


def test_items_of_one_frame_are_joined_once(spark):
    """A benchmark of one question with other numbers: one class, and all its items are told."""
    ask = "If a train with {} seats and {} more in the last car is full, how many ride in it?"
    bench = spark.createDataFrame([(k, ask.format(100 + k, 900 - k)) for k in range(200)] + [(200, ask.format(5, 5))], "item_id long, text string")
    docs = spark.createDataFrame([(1, ask.format(117, 883)), (2, ask.format(1, 2)), (3, ask.format(4, 4))], "doc_id long, text string")
    assert decontaminate._item_rows(decontaminate.ids_and_texts(bench, "item_id", "text")).where("kind = 0").select("class").distinct().count() == 2
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(d, k): (d, k) == (1, 17) for d in (1, 2) for k in range(200)} | {(3, 200): False}


def test_quantities_and_names_are_slots():
    t = decontaminate.Templates(["He ran 5 km with Ann Lee today", "He ran 70 miles with Bo today"])
    assert (t.code[t.row == 0] == t.code[t.row == 1]).all() and (t.value[t.row == 0] > 0).sum() == 2


# 8

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></ul></nav><!-- <p>hidden --><div class="cookie-notice">ok?</div><div class="ad">buy</div>
<article class="post"><h1>Title &amp; more</h1><p><b>one   <i>two</i><br>three<p>four&nbsp;five<div class="comments"><p>bad</p></div><form><p>f</form><ul><li>a<li>b</ul>&lt;p&gt;</article>
<aside>side</aside><footer>&copy; f</footer>"""


def test_pages(spark):
    rows = [(1, "http://h.x/1", PAGE), (2, "http://h.x/2", None), (3, None, "just <b>text</b>"), (4, "http://h.x/3", "<div>open text</div><div class=ad>no</div>"), (1, "http://h.x/1", PAGE), (5, "bad url", "<p>" * 2000 + "deep"), (6, "http://h.x/5", "< 3 & 4 <p title='a>b'>x</p> <unclosed")]
    found = {r.page_id: (r.text, r.n_chars) for r in html.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")).collect()}
    want = "Title & more\none two three\nfour five\na\nb\n<p>"
    assert found[1] == (want, len(want))
    assert found[2] == ("", 0) and found[3][0] == "just text" and found[4][0] == "open text" and found[5][0] == "deep" and "x" in found[6][0]
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_classes_choose_slots_without_marks(spark):
    """Pages of one template give the same text whether the main part is an article or a bare div."""
    def page(i, tag):
        menu = "".join(f"<li><a href=/{k}>{prose(i + k, 2)}</a>" for k in range(6))
        body = "".join(f"<p>{prose(1000 * i + k, 30)}" for k in range(3))
        return f"<body><div><ul>{menu}</ul></div><{tag}><h1>{prose(i, 5)}</h1>{body}<div>Share this with your friends now</div></{tag}><div>{prose(i + 7, 4)}</div></body>"

    for tag in ("article", "div"):
        rows = [(i, f"http://a.b/{i}", page(i, tag)) for i in range(20)] + [(50, "http://a.b/x", page(3, tag))]
        found = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        for i in range(20):
            assert found[i] == "\n".join([prose(i, 5), *(prose(1000 * i + k, 30) for k in range(3))])
        assert found[50] == found[3]


def test_deep_pages_take_linear_work(spark):
    began = time.perf_counter()
    deep = "<div>x" * 100_000 + "</section>" * 1000 + "</div>" * 100_000
    assert html.extract(deep, set(), set(), set()).count("x") >= 90_000
    assert time.perf_counter() - began < 30


def test_template_text_goes_where_no_article_is_marked(spark):
    pages = [(i, f"http://h.x/{i}", f"<body><div id=top>Welcome to the site</div><div id=body>{prose(i, 40)}</div>") for i in range(6)]
    found = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r.text == " ".join(prose(r.page_id, 40).split()) for r in found)


# 9


def test_gradients():
    net, g = toxicity.Network.new(1), np.random.default_rng(0)
    net.p = {n: a.astype(np.float64) for n, a in net.p.items()}
    x, ids, y = g.standard_normal((9, 16)), g.integers(0, 9, (5, 32)), np.array([1.0, 0, 1, 0, 1])
    mask = np.arange(32) < np.array([32, 10, 1, 0, 20])[:, None]

    def loss():
        o = net.logits(net.project(x), ids, mask)
        return np.mean(np.log1p(np.exp(o)) - y * o)

    grads, dx = net.gradients(x, ids, mask, y)
    for a, d in [*((net.p[n], grads[n]) for n in ("Wf", "Ub", "cf", "A", "a", "v", "o", "b")), (x, dx)]:
        i = tuple(int(g.integers(s)) for s in a.shape)
        was = a[i]
        a[i] = was + 1e-4
        up = loss()
        a[i] = was - 1e-4
        assert abs((up - loss()) / 2e-4 - d[i]) < 1e-5
        a[i] = was


def test_every_word_is_in_a_window():
    for n in (0, 1, 16, 31, 32, 33, 48, 49, 500):
        _, (row, first, length), _ = toxicity.windows([np.arange(n, dtype=np.int32)])
        assert len(row) >= 1 and {k for a, m in zip(first, length, strict=True) for k in range(a, a + m)} == set(range(n))


def test_long_words_are_read_to_their_end():
    g = np.random.default_rng(18)
    prefix = "".join(chr(0x4E00 + i) for i in g.integers(0, 400, 60))
    plain, bad = prefix * 3, prefix * 2 + "\u9f98\u9f99" * 3 + prefix
    scores, at = toxicity._Scorer(toxicity.Network.new(1)).score([plain, bad, "a " + bad + " b", "a " + bad * 9 + " b"])
    assert len(set(scores.tolist())) == 4 and at[1] == 0 and at[3] in (0, 1)
    for word in (plain, "ab-" * 40, "x_" * 30 + "_" * 200, "a/b" * 50, "w" * 24, "w" * 25):
        cut, _ = toxicity.pieces(word)
        assert max(map(len, cut)) <= 2 * toxicity.LONGEST and "".join(cut).replace("_", "") == word.replace("_", "")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = [], []
    g = np.random.default_rng(8)
    for i in range(900):
        words = prose(1000 + i, int(g.integers(5, 120))).split()
        bad = i % 3 == 0
        if bad:
            words.insert(int(g.integers(len(words))), f"vile{g.choice(['', 'ness', 'st', 'r'])}")
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (2000, None), (2001, "")], "doc_id long, text string")
    sample = toxicity.labelled(docs, spark.createDataFrame([*labels, (None, 1), (5000, 1), (7, None)], "doc_id long, toxic int"))
    assert len(sample[0]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(900))
    net = toxicity.fit(*sample)
    found = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(found[i] >= 0.3) == (i % 3 == 0) for i in held]) >= 0.95
    assert 0 <= found[2000] == found[2001] <= 1 and len(found) == 902
    kept = toxicity.accepted(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in found.items() if s < 0.3}


def test_the_sample_is_bounded_and_the_same_in_every_run(spark, monkeypatch):
    rows = [(i, prose(i, 20)) for i in range(60)] + [(i, prose(500 + i, 20)) for i in range(0, 60, 3)] + [(70, None), (71, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(72)], "doc_id long, toxic int")
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    told = toxicity.labelled(make(rows), labels)
    assert told == toxicity.labelled(make(rows[::-1]).repartition(7), labels)
    assert len(told[0]) == len(told[1]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in [*range(60), 70, 71])
    assert max(len(t) for t in told[0]) < 300
    # a text over the bound costs the others nothing, and is cut only where it is needed
    monkeypatch.setattr(toxicity, "MOST_TEXT", 300)
    long = [(i, "many words " * 100 if i == 4 else t) for i, t in rows]
    assert sum(len(t) > 300 for t in toxicity.labelled(make(long), labels, most=(9, 9))[0]) == 0
    whole = toxicity.labelled(make(long), labels)
    assert len(whole[0]) == len(told[0]) and len(set(told[0]) - set(whole[0])) <= 1 and max(map(len, whole[0])) == 300


def test_the_fit_keeps_words_as_numbers():
    """The driver fits; its memory grows by few hundred bytes a distinct word."""
    g = np.random.default_rng(21)
    texts = [" ".join("".join(chr(97 + c) for c in w) for w in g.integers(0, 26, (800, 12))) for _ in range(64)]
    tracemalloc.start()
    net = toxicity.fit(texts, [i % 2 for i in range(64)], 0.5, epochs=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 800 * 64 * 800 and np.isfinite(toxicity._Scorer(net).score([*texts[:3], "", None])[0]).all()


def test_copies_of_pages_count_once_even_where_the_filter_is_full(spark, monkeypatch):
    page = lambda i: f"<html><body><div class='menu'><p>Home and news and contact</p></div><div><p>{prose(900 + i, 30)}</p></div></body></html>"
    rows = [(i, "http://a.org/x", page(i)) for i in range(6)] + [(100 + i, f"http://a.org/{i}", page(2)) for i in range(60)] + [(300, "http://a.org/x", page(2))] * 2
    make = lambda: spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {(r.page_id, r.text) for r in html.main_text(make()).collect()}
    alone = {(r.page_id, r.text) for r in html.main_text(make().where("page_id < 6")).collect()}
    assert alone <= found and len({t for i, t in found if i == 2 or i >= 100}) == 1
    monkeypatch.setattr(html, "_id_bits", lambda ids, bits: b"\xff" * (1 << bits >> 3))
    assert {(r.page_id, r.text) for r in html.main_text(make()).collect()} == found


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    net = toxicity.fit(*toxicity.labelled(docs, none))
    assert [r.score for r in toxicity.score(docs, net).collect()] == [0.0, 0.0]
    assert toxicity.accepted(docs, net).count() == 2
