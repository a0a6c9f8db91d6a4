"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is an embedding of the word beside the mean of embeddings of its character
trigrams, both hashed.  Two gated recurrent layers read a window of words from either end,
attention weighs their states, and a logistic unit scores the pooled state.  A text's score is
that of its worst window; windows overlap by half, so every run of SPAN - STEP words lies in one.
A word of over LONGEST characters, such as a text without blanks, is read as consecutive pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, ids_and_texts, map_texts, text_slices

SPAN, STEP = 32, 16
WORD_ROWS, GRAM_ROWS, WIDTH, STATES = 8192, 4096, 8, 8
#: A text with that score or more is toxic.
TOXIC = 0.3
#: The fit uses at most so many labelled rows with label 1 and with label 0, by order of a hash of the id.  A text of
#: more bytes is only taken where shorter ones do not fill that number, and then as many of its characters.
MOST_TOXIC, MOST_CLEAN, MOST_TEXT = 1000, 1600, 32 << 10
EPOCHS, RATE, BATCH, HIDE = 14, 0.01, 128, 0.5
#: Distinct words that a worker keeps the inputs of.
KEPT_WORDS = 200_000
#: Words whose trigrams' embeddings are gathered at once.
PART = 16_384
#: Characters of a word; a longer one is cut at what is no letter or digit, and else after so many.
LONGEST = 24

_EDGE = re.compile(r"^\W+|\W+$")
_PIECE = re.compile(rf"[\W_]{{0,{LONGEST}}}[^\W_]{{1,{LONGEST}}}|[\W_]{{1,{LONGEST}}}")


def pieces(text: str | None) -> tuple[list[str], np.ndarray | None]:
    """A text's words, those over LONGEST in pieces that cover them, and the place of each one's word (None: its own)."""
    words = (text or "").split()
    if max(map(len, words), default=0) <= LONGEST:
        return words, None
    cut = [[w] if len(w) <= LONGEST else [p.lstrip("_") or p for p in _PIECE.findall(w)] for w in words]
    return [p for ps in cut for p in ps], np.repeat(np.arange(len(words)), [len(ps) for ps in cut])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # exp gives inf, and so 0
        return 1 / (1 + np.exp(-x))


@dataclass
class Rows:
    """Embedding rows of words: each one's own, and those of its trigrams, end to end with their number."""

    word: np.ndarray
    grams: np.ndarray
    sizes: np.ndarray

    def __len__(self) -> int:
        return len(self.word)

    def of(self, words: np.ndarray) -> Rows:
        """The rows of some words."""
        sizes = self.sizes[words]
        starts = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[words]
        at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes, dtype=np.int64) - sizes), sizes)
        return Rows(self.word[words], self.grams[at], sizes)


#: Stands where there are no words at all.
NO_WORD = Rows(np.zeros(1, np.uint16), np.zeros(1, np.uint16), np.ones(1, np.int32))


class Words(dict):
    """Numbers distinct words as they come, and tells each one's embedding rows, kept as plain numbers."""

    def __init__(self):
        self.of_core: dict[str, int] = {}
        self._word, self._grams, self._sizes = array("H"), array("H"), array("i")

    def __missing__(self, raw: str) -> int:
        core = _EDGE.sub("", raw).lower() or raw
        n = self.of_core.get(core)
        if n is None:
            n = self.of_core[core] = len(self.of_core)
            marked = f"<{core}>".encode("utf-8", "surrogatepass")
            hashed = xxhash.xxh32_intdigest
            size = max(1, len(marked) - 2)
            self._grams.extend([hashed(marked[i : i + 3]) % GRAM_ROWS for i in range(size)])
            self._sizes.append(size)
            self._word.append(hashed(marked) % WORD_ROWS)
        self[raw] = n
        return n

    def taken(self) -> Rows:
        """The rows of the words that are new since the last call; they are not kept here any longer."""
        out = Rows(np.array(self._word, np.uint16), np.array(self._grams, np.uint16), np.array(self._sizes, np.int32))
        self._word, self._grams, self._sizes = array("H"), array("H"), array("i")
        return out

    def texts(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
        """Each text's pieces as numbers, and the places of their words as :func:`pieces` tells them."""
        number = self.__getitem__
        cut = [pieces(t) for t in texts]
        return [np.array(list(map(number, ps)), np.int32) for ps, _ in cut], [at for _, at in cut]


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words end to end padded by SPAN, and each window's text and first word; none is left out."""
    counts = np.array([len(t) for t in texts], np.int64)
    each = np.maximum(1, -(-(counts - SPAN) // STEP) + 1)
    row = np.repeat(np.arange(len(texts)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    firsts = (np.cumsum(counts) - counts)[row] + nth * STEP
    lengths = np.minimum(SPAN, counts[row] - nth * STEP)
    words = np.concatenate([*texts, np.zeros(SPAN, np.int32)]).astype(np.int32)
    return words, np.stack([row, firsts, lengths]), counts


@dataclass
class Network:
    """The weights; ``shift`` corrects the logit for the share of label 1 in the sample."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0
    constant: float | None = None

    @classmethod
    def new(cls, seed: int) -> Network:
        g = np.random.default_rng(seed)
        n = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"word": 0.1 * g.standard_normal((WORD_ROWS, WIDTH)).astype(np.float32), "gram": 0.1 * g.standard_normal((GRAM_ROWS, WIDTH)).astype(np.float32)}
        for d in "fb":
            p |= {f"W{d}": n(2 * WIDTH, 3 * STATES), f"U{d}": n(STATES, 3 * STATES), f"c{d}": np.zeros(3 * STATES, np.float32)}
        return cls(p | {"A": n(2 * STATES, STATES), "a": np.zeros(STATES, np.float32), "v": n(STATES, 1)[:, 0], "o": n(2 * STATES, 1)[:, 0], "b": np.zeros(1, np.float32)})

    def inputs(self, rows: Rows) -> np.ndarray:
        """The input of each word; PART words at a time have their trigrams' embeddings gathered."""
        out = np.empty((len(rows), 2 * WIDTH), np.float32)
        out[:, :WIDTH] = self.p["word"][rows.word]
        ends = np.cumsum(rows.sizes, dtype=np.int64)
        for at in range(0, len(rows), PART):
            sizes, starts = rows.sizes[at : at + PART], (ends - rows.sizes)[at : at + PART]
            flat = rows.grams[starts[0] : starts[-1] + sizes[-1]]
            out[at : at + PART, WIDTH:] = np.add.reduceat(self.p["gram"][flat], starts - starts[0], axis=0) / sizes[:, None]
        return out

    def read(self, d: str, pre: list[np.ndarray], mask: np.ndarray | None, keep: list | None = None) -> list[np.ndarray]:
        """The states of one layer; ``pre[t]`` is what the words of place t give to the three gates."""
        h = np.zeros((len(pre[0]), STATES), np.float32)
        states: list = [None] * len(pre)
        u = self.p[f"U{d}"]
        for t in range(len(pre)) if d == "f" else reversed(range(len(pre))):
            x, back = pre[t], h @ u
            zr = _sigmoid(x[:, : 2 * STATES] + back[:, : 2 * STATES])
            z, r = zr[:, :STATES], zr[:, STATES:]
            n = np.tanh(x[:, 2 * STATES :] + r * back[:, 2 * STATES :])
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[:, t : t + 1], new, h)
            if keep is not None:
                keep.append((t, h, z, r, n, back[:, 2 * STATES :]))
            states[t] = h = new
        return states

    def logits(self, proj: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """The logit of each window of word numbers; ``proj`` has each word's share of the gates."""
        caches = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        f, b = (self.read(d, [proj[d].take(ids[:, t], axis=0) for t in range(ids.shape[1])], mask, caches[d]) for d in "fb")
        h = np.concatenate([np.stack(f), np.stack(b)], axis=2)  # places, windows, states
        u = np.tanh(h @ self.p["A"] + self.p["a"])
        e = u @ self.p["v"]
        if mask is not None:
            e = np.where(mask.T, e, np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, h, optimize=True)
        if mask is not None:
            pooled = pooled * mask.any(axis=1)[:, None]
        if keep is not None:
            keep.update(h=h, u=u, w=w, pooled=pooled, caches=caches)
        return pooled @ self.p["o"] + self.p["b"][0]

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean log loss over windows, by the weights and by the words' inputs ``x``."""
        k: dict = {}
        out = self.logits(self.project(x), ids, mask, k)
        g = {n: np.zeros_like(a) for n, a in self.p.items() if n not in ("word", "gram")}
        d = ((_sigmoid(out) - label) / len(label)).astype(np.float32)
        h, u, w, pooled = k["h"], k["u"], k["w"], k["pooled"]
        g["o"], g["b"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * self.p["o"] * mask.any(axis=1)[:, None]
        dw = np.einsum("bh,tbh->tb", dpool, h)
        de = w * (dw - (w * dw).sum(axis=0))
        du = de[:, :, None] * self.p["v"] * (1 - u * u)
        g["v"] = np.einsum("tb,tbs->s", de, u)
        g["A"], g["a"] = np.einsum("tbh,tbs->hs", h, du), du.sum(axis=(0, 1))
        dh = w[:, :, None] * dpool + du @ self.p["A"].T
        dx = np.zeros_like(x)
        for side, name in enumerate("fb"):
            own = dh[:, :, side * STATES : (side + 1) * STATES]
            carry = np.zeros_like(own[0])
            matrix, recur = self.p[f"W{name}"], self.p[f"U{name}"]
            for t, before, z, r, n, back in reversed(k["caches"][name]):
                m = mask[:, t : t + 1]
                total = own[t] + carry
                on = total * m
                dn = on * (1 - z) * (1 - n * n)
                dz = on * (before - n) * z * (1 - z)
                dr = dn * back * r * (1 - r)
                dpre = np.concatenate([dz, dr, dn], axis=1)
                dback = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"U{name}"] += before.T @ dback
                g[f"W{name}"] += x[ids[:, t]].T @ dpre
                g[f"c{name}"] += dpre.sum(axis=0)
                np.add.at(dx, ids[:, t], dpre @ matrix.T)
                carry = total * ~m + on * z + dback @ recur.T
        return g, dx

    def scores(self, words: np.ndarray, found: np.ndarray, proj: dict[str, np.ndarray], texts: int, batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Each text's greatest logit over all its windows, and which window has it."""
        row, first, length = found
        out = np.empty(len(row), np.float32)
        whole = length == SPAN
        for part, masked in ((np.flatnonzero(whole), False), (np.flatnonzero(~whole), True)):
            for at in range(0, len(part), batch):
                k = part[at : at + batch]
                places = np.arange(SPAN)
                mask = places < length[k][:, None] if masked else None
                ids = words[first[k][:, None] + places]
                out[k] = self.logits(proj, np.where(mask, ids, 0) if masked else ids, mask)
        order = np.lexsort((np.arange(len(row)), -out, row))
        best = order[np.searchsorted(row[order], np.arange(texts))]
        return out[best], best


def fit(texts: list[str], labels: list[int], share: float, seed: int = 5, epochs: int = EPOCHS) -> Network:
    """Fit on whole texts: in each epoch a text is its worst window so far (at first, one at random)."""
    y = np.array(labels, np.float32)
    if not 0 < y.mean() < 1 if len(y) else True:
        return Network(constant=float(np.clip(share, 0, 1)))
    g = np.random.default_rng(seed)
    net, table = Network.new(seed), Words()
    words, found, _ = windows(table.texts(texts)[0])
    rows = table.taken() if table else NO_WORD
    del table  # from here on words are numbers
    row, first, length = found
    ends = np.searchsorted(row, np.arange(len(texts)), side="right")
    begins = np.searchsorted(row, np.arange(len(texts)))
    m = {n: np.zeros_like(a) for n, a in net.p.items()}
    s = {n: np.zeros_like(a) for n, a in net.p.items()}
    step = 0
    size = max(16, min(BATCH, len(texts) // 16))  # a small sample takes smaller steps, and more of them
    for epoch in range(epochs):
        chance = g.integers(begins, ends)
        if epoch >= 2:
            _, best = net.scores(words, found, net.project(net.inputs(rows)), len(texts))
            picked = np.concatenate([best, chance[y == 0]])
            target = np.concatenate([y, y[y == 0]])
        else:
            picked, target = np.concatenate([chance, g.integers(begins, ends)]), np.concatenate([y, y])
        order = g.permutation(len(picked))
        for at in range(0, len(order), size):
            k = picked[order[at : at + size]]
            mask = np.arange(SPAN) < length[k][:, None]
            ids, local = np.unique(np.where(mask, words[np.minimum(first[k][:, None] + np.arange(SPAN), len(words) - 1)], 0), return_inverse=True)
            own = rows.of(ids)
            x = net.inputs(own)
            seen = g.random(len(ids)) >= HIDE
            x[:, :WIDTH] *= seen[:, None]
            grads, dx = net.gradients(x, local.reshape(len(k), SPAN), mask, target[order[at : at + size]])
            grads["word"], grads["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(grads["word"], own.word, dx[:, :WIDTH] * seen[:, None])
            np.add.at(grads["gram"], own.grams, np.repeat(dx[:, WIDTH:] / own.sizes[:, None], own.sizes, axis=0))
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for n, d in grads.items():
                m[n] += 0.1 * (d - m[n])
                s[n] += 0.001 * (d * d - s[n])
                net.p[n] -= (rate * m[n] / (np.sqrt(s[n]) + 1e-8)).astype(np.float32)
    odds = lambda q: float(np.log(q / (1 - q)))
    net.shift = odds(np.clip(share, 1e-3, 1 - 1e-3)) - odds(float(y.mean()))
    return net


def labelled(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: tuple[int, int] = (MOST_CLEAN, MOST_TOXIC)
) -> tuple[list[str], list[int], float]:
    """A bounded sample of labelled texts, their labels, and the share of label 1 among all rows that may be learnt from.

    Rows whose crc32 of the id's digits is 2 modulo 4 are never learnt from.  At most ``most`` rows
    of either label are taken, those of at most MOST_TEXT bytes first, by order of a hash of the id;
    they alone reach the driver (so its bytes have a bound, and one long text costs the others
    nothing), as do their ids and one row of counts.  Of repeated labels the greatest counts, of
    repeated ids one text; null labels and ids are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.octet_length(text_col)), F.lit(0)).alias("b"))
    known = known.join(sizes, "doc_id").cache()
    share = known.agg(F.avg("y")).first()[0] or 0.0
    picked = [known.where(F.col("y") == k).orderBy(F.col("b") > MOST_TEXT, F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "y") for k, n in enumerate(most)]
    sample = docs.sparkSession.createDataFrame(picked[0].union(picked[1]).collect(), "doc_id long, y int")
    texts = ids_and_texts(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    # of rows of one id the text of least hash, so that the same texts are learnt from in every run
    one = texts.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("h"))
    held = docs.sparkSession.createDataFrame(one.collect(), "doc_id long, h long")
    short = F.when(F.octet_length("text") > MOST_TEXT, F.substring("text", 1, MOST_TEXT)).otherwise(F.col("text"))
    rows = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(held), ["doc_id", "h"]).select("doc_id", "y", short.alias("text")).dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    known.unpersist()
    return [r.text or "" for r in rows], [r.y for r in rows], float(share)


class _Scorer:
    """A worker's tables of words; all its tasks use them."""

    def __init__(self, net: Network):
        self.net = net
        self._start()

    def _start(self) -> None:
        self.table, self.proj = Words(), {}

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant), np.zeros(len(texts), np.int64)
        if len(self.table) > KEPT_WORDS:
            self._start()
        numbered, places = self.table.texts(texts)
        rows = self.table.taken()
        if len(rows):
            new = self.net.project(self.net.inputs(rows))
            self.proj = {d: np.concatenate([self.proj[d], new[d]]) for d in new} if self.proj else new
        proj = self.proj or self.net.project(self.net.inputs(NO_WORD))  # no words at all: every place is masked
        words, found, counts = windows(numbered)
        best, which = self.net.scores(words, found, proj, len(texts))
        firsts = np.cumsum(counts) - counts
        at = found[1][which] - firsts
        for i, words_of in enumerate(places):
            if words_of is not None:
                at[i] = words_of[at[i]]
        return _sigmoid(best.astype(np.float64) + self.net.shift), at


_SCORERS: dict[str, _Scorer] = {}


def _scorer(name: str, net: Network) -> _Scorer:
    """The worker's scorer of one network; that of another network goes."""
    claim("toxicity", _SCORERS.clear)
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = _Scorer(net)
    return _SCORERS[name]


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, worst_at)`` for every row, from all its windows; no shuffle.

    worst_at is the first word of the worst window.  Null and empty texts get the score of a
    window without words; a network that was fitted without rows of both labels scores every text
    by the share of label 1.  Repeated rows get one score each; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    name = f"{id(net)}-{np.random.default_rng().integers(1 << 60)}"

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores, at = _scorer(name, held.value).score(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(at, pa.int64())], ["doc_id", "score", "worst_at"])

    return map_texts(ids_and_texts(docs, id_col, text_col), kernel, "doc_id long, score double, worst_at long")


def accepted(docs: DataFrame, net: Network, text_col: str = "text", least: float = TOXIC) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``least``, all columns as they are; no shuffle.

    Each row is judged by its own text; null and empty texts, repeated rows and empty tables are as
    in :func:`score`.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    name = f"{id(net)}-{np.random.default_rng().integers(1 << 60)}"
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, column):
                yield part.filter(pa.array(_scorer(name, held.value).score(part.column(column).to_pylist())[0] < least))

    return docs.mapInArrow(run, docs.schema)
