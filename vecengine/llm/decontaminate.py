"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, quantities (a number and its unit) and names are replaced by
typed placeholders, other words are lower-cased and freed of punctuation.  Windows of WINDOW
template tokens are joined by hash with those of the benchmark.  Matches of a document with an
item on one alignment form a candidate; the slots of a run of them must be consistent (one value of
the item stands for one value of the document, and the other way round), so a question with other
numbers or names is caught and a chance match of its frame with mixed values is not.

An item too short for a window, or with windows of few words, is one frame of all its template
tokens (frames of FRAME tokens if it is longer), joined by hash beside the windows.  A second frame
takes the capitalised word that opens a sentence as a name.

Copies of the words themselves need no template: windows of COVERED lower-cased words, or whole
items that are shorter, are joined by hash too, whatever their words are.

Items whose templates and repeats of slot values are the same are one class, and so are items with
the same run of words; a class is joined once.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, claim, discard, free_name, ids_and_texts, map_texts, stored
from .substring import _has, _mixed, _rolled, mark_of, parted

#: Tokens of a template window; of those at least LITERALS are words; tokens that a leak covers.
WINDOW, LITERALS, COVERED = 8, 4, 13
#: Tokens of a frame at most.  A frame with fewer words than SURE, or of fewer than SURE + 2 tokens,
#: matches only where it is whole sentences or lines; so do items of up to SURE words as they are.
FRAME, SURE = 24, 3
#: log2 of the bits of the filter of benchmark windows (512 KB, whatever the benchmark's size).
FILTER_BITS = 22
KEPT_WORDS = 300_000

#: Units of measure that may follow a number.
UNITS = frozenset(
    """percent mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms
    lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min
    minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd
    eur kmh mph kph degree degrees watt watts volt volts byte bytes kb mb gb""".split()
)
WORD, NUMBER, CAPITAL, UNIT, QUANTITY, NOTHING = range(6)
_PLACE = {NUMBER: 0x1111111111111111, QUANTITY: 0x2222222222222222, CAPITAL: 0x3333333333333333}
_EDGE = re.compile(r"^\W+|\W+$")
_NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*(\D*)")
_ENDS = re.compile(r"[.!?:;]\W*$")
#: Stands for a line's end among the words; it has no letters, so it is no word.
_LINE = "\ue000"


class _Words(dict):
    """Each distinct word's number; its kind, hashes and whether a sentence ends after it."""

    def __init__(self):
        self.kind, self.code, self.value, self.ends = [], [], [], []
        self._arrays = ()

    def __missing__(self, raw: str) -> int:
        core = _EDGE.sub("", raw)
        low = core.lower()
        kind = WORD
        if not core:
            kind = NOTHING
        elif m := _NUMBER.fullmatch(core):
            unit = m[1].lower()
            kind = NUMBER if not unit else QUANTITY if unit in UNITS else WORD
        elif low in UNITS:
            kind = UNIT
        elif core[0].isupper():
            kind = CAPITAL
        n = self[raw] = len(self.kind)
        self.kind.append(kind)
        self.code.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 11))
        self.value.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 13) | 1)
        self.ends.append(bool(_ENDS.search(raw)))
        return n

    def arrays(self) -> tuple[np.ndarray, ...]:
        if not self._arrays or len(self._arrays[0]) != len(self.kind):
            self._arrays = (np.array(self.kind, np.int8), np.array(self.code, np.uint64), np.array(self.value, np.uint64), np.array(self.ends, bool))
        return self._arrays


_WORDS = _Words()


def _forget() -> None:
    global _WORDS
    _WORDS = _Words()


class Templates:
    """The template tokens of a slice of texts, end to end: ``row``, ``code`` and slot ``value`` (0: a word).

    ``opens`` and ``closes`` tell which tokens begin and end a sentence or a text, or with
    ``lines`` a line.
    """

    def __init__(self, texts: list[str | None], lines: bool = False):
        claim("decontaminate", _forget)
        if len(_WORDS) > KEPT_WORDS:
            _forget()
        number = _WORDS.__getitem__
        cut = [(t or "").replace("\n", f" {_LINE} ").split() if lines else (t or "").split() for t in texts]
        counts = np.array([len(w) for w in cut], np.int64)
        words = np.fromiter((n for ws in cut for n in map(number, ws)), np.int64, int(counts.sum()))
        row = np.repeat(np.arange(len(texts)), counts)
        line = number(_LINE)
        kinds, codes, values, ends = _WORDS.arrays()
        something = np.flatnonzero(kinds[words] != NOTHING)
        breaks = np.concatenate(([0], np.cumsum(ends[words] | (words == line))))
        words, row = words[something], row[something]
        self.word_row, self.word, self._sums = row, codes[words], {}
        self._first = np.ones(len(row), bool)
        self._first[1:] = row[1:] != row[:-1]
        self.word_opens = self._first.copy()
        self.word_opens[1:] |= breaks[something[1:]] > breaks[something[:-1]]
        self.word_closes = np.append(self.word_opens[1:], True)
        self._after = self._first.copy()
        self._after[1:] |= ends[words[:-1]]
        self._kind, self._value = kinds[words], values[words]
        self._fill(self._after)

    def named(self) -> Templates:
        """The same texts with capitalised words that open a sentence as names."""
        other = copy.copy(self)
        other._sums = {}
        other._fill(np.zeros(len(self.word), bool))
        return other

    def _fill(self, plain: np.ndarray) -> None:
        """Tokens of the words; capitals where ``plain`` are no names."""
        first, value = self._first, self._value
        kind = np.where((self._kind == CAPITAL) & plain, WORD, self._kind)
        # a unit after a number goes into the number's slot
        joins = np.zeros(len(kind), bool)
        joins[1:] = (kind[1:] == UNIT) & (kind[:-1] == NUMBER) & ~first[1:]
        kind = np.where(np.append(joins[1:], False), QUANTITY, kind) if len(kind) else kind
        # names in a row are one name; one that opens a sentence is not that of the sentence before
        again = np.zeros(len(kind), bool)
        again[1:] = (kind[1:] == CAPITAL) & (kind[:-1] == CAPITAL) & ~self._after[1:]
        kept = ~(joins | again)
        starts = np.flatnonzero(kept)
        value = np.where(np.isin(kind, list(_PLACE)), value, np.uint64(0))
        if len(value):
            value = np.add.reduceat(np.where(joins, np.uint64(0), value), starts)
        self.row, kind, code = self.word_row[kept], kind[kept], self.word[kept]
        self.opens, self.closes = self.word_opens[kept], self.word_closes[np.append(starts[1:], len(kept)) - 1] if len(starts) else self.word_closes[:0]
        for k, place in _PLACE.items():
            code = np.where(kind == k, np.uint64(place), code)
        self.code, self.value = code, value

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Of windows with enough words in them: index of the first token, hash."""
        n = len(self.code)
        if n < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = _rolled(self.code, WINDOW, 0x9E3779B97F4A7C15)[: n - WINDOW + 1]
        literal = np.concatenate(([0], np.cumsum(self.value == 0)))
        whole = self.row[WINDOW - 1 :] == self.row[: n - WINDOW + 1]
        at = np.flatnonzero(whole & (literal[WINDOW:] - literal[:-WINDOW] >= LITERALS))
        return at, h[at]

    def runs(self, n: int, bounded: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Of runs of ``n`` words of one text, whatever they are: index of the first word, hash."""
        at, h = self._hashed("words", self.word, self.word_row, n)
        kept = self.word_opens[at] & self.word_closes[at + n - 1] if bounded else slice(None)
        return at[kept], h[kept]

    def frames(self, n: int, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of runs of ``n`` template tokens of one text: index of the first token, hash."""
        at, h = self._hashed("tokens", self.code, self.row, n)
        kept = self.opens[at] & self.closes[at + n - 1] if bounded else slice(None)
        return at[kept], h[kept]

    def _hashed(self, name: str, codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        count = len(codes)
        if count < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        # sums of hashes times powers of an odd number, which has an inverse modulo 2 ** 64
        with np.errstate(over="ignore"):
            if name not in self._sums:
                one = np.ones(1, np.uint64)
                power = np.multiply.accumulate(np.concatenate((one, np.full(count, _BASE, np.uint64))))
                back = np.multiply.accumulate(np.concatenate((one, np.full(count, pow(_BASE, -1, 1 << 64), np.uint64))))
                self._sums[name] = np.concatenate((one - one, np.cumsum(codes * power[:-1], dtype=np.uint64))), back
            sums, back = self._sums[name]
            at = np.flatnonzero(row[n - 1 :] == row[: count - n + 1])
            return at, _mixed((sums[at + n] - sums[at]) * back[at] + np.uint64(n))


_BASE = 0x9E3779B97F4A7C15
#: ``kind`` is 0 for a template window, n for a run of n words, and :func:`_frame` of a frame.
_ROW = "h long, doc_id long, mark long, kind int, at int, slots array<long>, n int"
_ITEM = "class long, h long, item_id long, kind int, at int, slots array<long>, n int, given array<long>"


def _frame(n: int, named: bool, bounded: bool) -> int:
    """The kind of frames of ``n`` tokens, below 0: their variant, and whether they must be whole sentences or lines."""
    return -(4 * n + 2 * named + bounded)


def _width(kind: int) -> int:
    """Tokens or words of a match of a kind."""
    return kind if kind > 0 else -kind // 4 or WINDOW


def _item_windows(t: Templates) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """``(kind, at, h, slots)`` of the text of one item."""
    at, h = t.windows()
    found = [(0, at, h, t.value[at[:, None] + np.arange(WINDOW)])]
    size = min(COVERED, len(t.word))
    if size:
        found.append((size, *t.runs(size), None))
    if len(at) < max(1, len(t.code) - WINDOW + 1):
        for named, f in enumerate((t, t.named())):
            n = min(FRAME, len(f.code))
            if n == 0 or (named and np.array_equal(f.code, t.code)):
                continue
            at, _ = f.frames(n, False)
            words = (f.value[at[:, None] + np.arange(n)] == 0).sum(axis=1)
            sure = (words >= SURE) & (n >= SURE + 2)
            # a frame without a slot is found word by word, one without a word tells nothing
            for bounded in (False, True):
                of = at[(sure != bounded) & (words > 0) & (words < n)] if not bounded or n == len(f.code) else at[:0]
                h = f.frames(n, False)[1][of]
                found.append((_frame(n, bool(named), bounded), of, h, f.value[of[:, None] + np.arange(n)]))
    return found


def _class_of(rows: object) -> int:
    return xxhash.xxh3_64_intdigest(repr(rows).encode()) - (1 << 63)


def _item_rows(benchmark: DataFrame) -> DataFrame:
    """A row a window, frame and run of words of each item, with the item's class and its slot values.

    Slots are numbered from 1 in the order in which their values first stand in the item, so items
    that differ only in values have equal rows of one class; ``given`` are the values by number, in
    the first of them.  A run of words is a class of its own.
    """

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns: tuple[list, ...] = ([], [], [], [], [], [], [], [])
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = Templates([text], lines=True)
            number: dict[int, int] = {}
            rows = []
            for kind, at, h, slots in _item_windows(t):
                values = [[]] * len(at) if slots is None else slots.view(np.int64).tolist()
                n = len(t.word) if kind > 0 else len(t.code)
                for place, x, own in zip(at.tolist(), h.view(np.int64).tolist(), values, strict=True):
                    rows.append((kind, place, x, [number.setdefault(v, len(number) + 1) if v else 0 for v in own], n))
            frames = [r for r in rows if r[0] <= 0]
            like, given = _class_of(frames), list(number)
            for kind, place, x, own, n in rows:
                if kind > 0:
                    row = (_class_of((kind, x)), x, item, kind, place, own, n, [])
                else:
                    row, given = (like, x, item, kind, place, own, n, given), None
                for column, v in zip(columns, row, strict=True):
                    column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["class", "h", "item_id", "kind", "at", "slots", "n", "given"])

    return map_texts(benchmark, kernel, _ITEM)


def _window_rows(rows: DataFrame, kinds: list[int], held) -> DataFrame:
    """A row a window, frame or run of words of ``(doc_id, text)`` of the given kinds that the filter holds."""

    lines = any(-kind & 1 if kind < 0 else kind <= SURE for kind in kinds if kind)

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        t = Templates(texts, lines)
        named = t.named() if any(kind < 0 and -kind & 2 for kind in kinds) else t
        marks = np.array([xxhash.xxh64_intdigest((x or "").encode("utf-8", "surrogatepass"), 42) for x in texts], np.uint64).view(np.int64)
        bits = np.frombuffer(held.value, np.uint8)
        for kind in kinds:
            f = named if kind < 0 and -kind & 2 else t
            width = _width(kind)
            at, h = f.windows() if kind == 0 else f.runs(kind, kind <= SURE) if kind > 0 else f.frames(width, bool(-kind & 1))
            kept = np.flatnonzero(_has(bits, h >> np.uint64(64 - FILTER_BITS)))
            at, h = at[kept], h[kept]
            of = f.word_row if kind > 0 else f.row
            sizes = np.bincount(of, minlength=max(1, len(texts)))
            row = of[at]
            place = at - np.searchsorted(of, row)
            for lo in range(0, len(h), 50_000):
                p = slice(lo, lo + 50_000)
                each = 0 if kind > 0 else width
                values = f.value[at[p][:, None] + np.arange(width)].view(np.int64).ravel() if each else np.zeros(0, np.int64)
                ends = pa.array(np.arange(len(h[p]) + 1, dtype=np.int32) * each)
                columns = [
                    pa.array(h[p].view(np.int64)),
                    batch.column(0).take(pa.array(row[p])),
                    pa.array(marks[row[p]]),
                    pa.array(np.full(len(h[p]), kind, np.int32)),
                    pa.array(place[p].astype(np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(values)),
                    pa.array(sizes[row[p]].astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "mark", "kind", "at", "slots", "n"])

    return map_texts(rows, kernel, _ROW)


def consistent_tokens(hits: list[tuple[int, list[int], list[int]]], window: int) -> tuple[int, list[dict[int, int]]]:
    """The most tokens that consistent runs of matched windows cover, and the slots of each way to cover so many.

    ``hits`` are the place of a window in the item, its slots' numbers there (0: a word) and their
    values in the document.  Windows that overlap or touch are a run; one in which a slot stands
    for two values, or two for one, counts for nothing, and runs count together as long as they do
    not go against each other.
    """
    runs: list[list] = []
    for at, own, other in hits:
        if not runs or at - runs[-1][1] > window:
            runs.append([0, at - window, set()])
        run = runs[-1]
        run[0], run[1] = run[0] + min(window, at - run[1]), at
        run[2].update((x, y) for x, y in zip(own, other, strict=True) if x)
    fits = lambda pairs: len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
    covered, seen, ways = 0, set(), []
    for n, _, pairs in runs:
        if fits(pairs):
            ways.append((n, pairs))
            if fits(seen | pairs):
                covered, seen = covered + n, seen | pairs
    ways.append((covered, seen))
    most = max(n for n, _ in ways)
    return most, [dict(pairs) for n, pairs in ways if n == most > 0]


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """The leaked classes of each document with the ways in which slots are filled, and the table of items' windows."""
    items = stored(_item_rows(ids_and_texts(benchmark, item_col, item_text_col)), "benchmark-windows")
    low = items.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("b"))
    held = docs.sparkSession.sparkContext.broadcast(bitmap(low, "b", FILTER_BITS))
    kinds = sorted(r.kind for r in items.select("kind").distinct().collect())  # 1 + COVERED + 4 * FRAME at most
    # a class is joined once, however many items it has; a window that an item repeats counts once a place
    run = F.col("kind") > 0
    ours = items.select(
        "h", "kind", "class", F.when(run, 0).otherwise(F.col("at")).alias("item_at"), F.col("slots").alias("item_slots"), F.when(run, F.col("kind")).otherwise(F.col("n")).alias("item_tokens")
    ).distinct()
    theirs = _window_rows(ids_and_texts(docs, id_col, text_col), kinds, held)
    met = theirs.join(ours, ["h", "kind"]).select("doc_id", "mark", "class", "item_tokens", "kind", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "item_slots", "slots")
    # an item's windows on one alignment: as many as it has tokens at most
    aligned = met.groupBy("doc_id", "mark", "class", "item_tokens", "kind", "shift").agg(F.array_sort(F.collect_set(F.struct("item_at", "item_slots", "slots"))).alias("hits"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [
                consistent_tokens([(x["item_at"], x["item_slots"], x["slots"]) for x in hits], _width(kind))
                for hits, kind in zip(batch.column(5).to_pylist(), batch.column(4).to_pylist(), strict=True)
            ]
            ways = [[list(way.items()) for way in ways] for _, ways in told]
            columns = [*batch.columns[:5], pa.array([n for n, _ in told], pa.int32()), pa.array(ways, pa.list_(pa.map_(pa.int64(), pa.int64()))), batch.column(6)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "class", "item_tokens", "kind", "covered", "ways", "shift"])

    schema = "doc_id long, mark long, class long, item_tokens int, kind int, covered int, ways array<map<long, long>>, shift int"
    judged = aligned.select("doc_id", "mark", "class", "item_tokens", "kind", "hits", "shift").mapInArrow(judge, schema)
    enough = F.least(F.lit(COVERED), F.greatest(F.lit(WINDOW), F.col("item_tokens") - 2))
    return judged.where(F.col("covered") >= F.when(F.col("kind") == 0, enough).otherwise(1)), items


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``(doc_id, mark, item_id, covered, item_tokens, exact)``: each document's leaked items.

    A leak covers COVERED template tokens of the item in consistent runs on one alignment (all but
    two of a shorter item, and a frame whole), or holds COVERED words of it as they are (all of a
    shorter item; A-Z and punctuation around words do not matter); exact tells that all slot values
    are the item's own.  A short item (see SURE) counts only where it is whole sentences or lines;
    one without words of its own counts only as it is, an empty one never.  Null texts are empty;
    a null doc_id or item_id is kept as such; repeated rows give one row; empty tables give an
    empty result; extra columns do not matter.  The documents' windows pass a filter of fixed size,
    built from the benchmark, and are then joined by hash with one item of a class, so neither
    table is ever broadcast or collected, and a frame that many items share is joined once.
    """
    leaks, items = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col)
    members = items.where("given IS NOT NULL").select("class", "item_id", "given", F.col("n").alias("item_tokens"), "at").distinct()
    told = leaks.drop("item_tokens").join(members, "class")
    own = F.exists("ways", lambda way: F.forall(F.map_entries(way), lambda e: F.element_at("given", e["key"].cast("int")) == e["value"]))
    framed = told.where("kind <= 0").select("doc_id", "mark", "item_id", "covered", "item_tokens", own.alias("exact"))
    # runs of an item on one alignment count together
    copied = told.where("kind > 0").groupBy("doc_id", "mark", "item_id", "item_tokens", "kind", F.expr("shift - at")).agg(F.array_sort(F.collect_set("at")).alias("places"))
    step = "aggregate(places, named_struct('n', 0, 'last', -kind), (s, x) -> named_struct('n', s.n + least(kind, x - s.last), 'last', x), s -> s.n)"
    copied = copied.select("doc_id", "mark", "item_id", F.expr(step).alias("covered"), "item_tokens", F.lit(True).alias("exact"))
    found = framed.unionByName(copied).groupBy("doc_id", "mark", "item_id")
    return found.agg(F.max("covered").alias("covered"), F.max("item_tokens").alias("item_tokens"), F.max("exact").alias("exact"))


def clean(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, all columns as they are.

    Rows of one id are judged by their own texts; nulls and empty tables are as in :func:`matches`.
    Only rows whose id may have a leak are shuffled; a filter of fixed size tells them.
    """
    leaks, items = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col)
    found = stored(leaks.select("doc_id", "mark").distinct(), "benchmark-leaks")
    discard(items)
    maybe, rest = parted(docs, id_col, found)
    key, mark = free_name(docs, "leak_id"), free_name(docs, "leak_mark")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (mark_of(text_col) == F.col(mark))
    return rest.unionByName(maybe.join(found.toDF(key, mark), same, "left_anti"))
