"""Byte-level BPE by depth-first traversal of a trie of distinct words.

The encoding of a prefix is known from its last token alone: the encoding of a word up to some
place is that up to the start of the last token, and then the last token.  So the distinct words
of a slice are walked as a trie, in depth-first (that is, sorted) order, and each node gets the
last token of its prefix.  The token is the one that ends there, whose start's own last token may
stand before it.  Words that share a prefix share its nodes, which are computed once.  The tokens that
end at a node are those that end the longest tail of its prefix that begins a token; that tail
follows from the one before and the next byte, and so do they.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, ids_and_texts, map_texts

#: Fixed values of the byte-level format: the pattern that splits text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct chunks of text whose ids a worker keeps; above that only those that came again stay.
KEPT_CHUNKS = 300_000
#: Steps from tail to tail, and pairs of tokens, that a vocabulary keeps; above that it starts anew.
KEPT_STEPS, KEPT_FITS = 400_000, 400_000

_TWO_SPACES = re.compile(r"\s\s")


def byte_characters() -> dict[str, int]:
    """The format's character for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary, read from a tokenizer's JSON text."""

    def __init__(self, spec: str):
        told = json.loads(spec)
        model, pre = told["model"], told["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or told["normalizer"]:
            raise ValueError("not a plain byte-level BPE tokenizer")
        self.added = {x["content"]: x["id"] for x in told["added_tokens"]}
        if any(x[k] for x in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that strip or normalise are not supported")
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        byte_of = byte_characters()
        as_bytes = lambda s: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        ids = {as_bytes(s): i for s, i in model["vocab"].items() if s not in self.added}
        self.bytes_of: list[bytes] = [b""] * (max([*model["vocab"].values(), *self.added.values()]) + 1)
        for s, i in [*((b, i) for b, i in ids.items()), *((s.encode(), i) for s, i in self.added.items())]:
            self.bytes_of[i] = s
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        born: dict[int, tuple[int, int, int]] = {}  # rank, left, right
        for r, (a, b) in enumerate(pairs):
            left, right = ids[as_bytes(a)], ids[as_bytes(b)]
            self.rank[left, right] = r
            born[ids[as_bytes(a + b)]] = (r, left, right)
        #: For each token its parts that touch its right (left) edge, each with the rank at which it is merged away.
        never = len(pairs)
        self.right_edge, self.left_edge = {}, {}
        for edges, side in ((self.right_edge, 2), (self.left_edge, 1)):
            for t in ids.values():
                edge, part, gone = [], t, never
                while True:
                    edge.append((part, gone))
                    if part not in born:
                        break
                    part, gone = born[part][side], born[part][0]
                edges[t] = edge
        self._fits: dict[int, bool] = {}
        # a token that merging its own bytes does not give is never in an encoding
        self.ids = {b: i for b, i in ids.items() if i not in born or self._is_whole(i, born)}
        self.sizes = [len(b) for b in self.bytes_of]
        #: What begins a token, numbered; for each the tokens that end it, longest first, once it is reached.
        self.tails = list({b[:n]: None for b in self.ids for n in range(len(b) + 1)})
        self.tail_of = {b: n for n, b in enumerate(self.tails)}
        self.ending: list[tuple[int, ...] | None] = [None] * len(self.tails)
        self._steps: dict[int, int] = {}

    def _is_whole(self, t: int, born: dict) -> bool:
        """Whether the bytes of ``t`` merge to ``t``: nothing crosses the seam of its two parts earlier."""
        r, left, right = born[t]
        return not any(
            (q := self.rank.get((a, b))) is not None and (a, b) != (left, right) and q < gone_a and q <= gone_b and q < r
            for a, gone_a in self.right_edge[left]
            for b, gone_b in self.left_edge[right]
        ) and all(x not in born or self._is_whole(x, born) for x in (left, right))

    def fits(self, s: int, t: int) -> bool:
        """Whether ``t`` may follow ``s``: no merge across their seam comes before the parts are merged away.

        Of equal merges the leftmost comes first, so the part on the right may go in the same one.
        """
        key = s << 20 | t
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > KEPT_FITS:
                self._fits.clear()
            known = self._fits[key] = not any(
                (q := self.rank.get((a, b))) is not None and q < gone_a and q <= gone_b
                for a, gone_a in self.right_edge[s]
                for b, gone_b in self.left_edge[t]
            )
        return known

    def _step(self, tail: int, byte: int) -> int:
        """The longest tail that begins a token, after one byte more."""
        if len(self._steps) > KEPT_STEPS:
            self._steps.clear()
        found = self.tails[tail] + bytes((byte,))
        while found not in self.tail_of:
            found = found[1:]
        n = self._steps[tail << 8 | byte] = self.tail_of[found]
        if self.ending[n] is None:
            self.ending[n] = tuple(t for k in range(len(found)) if (t := self.ids.get(found[k:])) is not None)
        return n

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of each distinct word, by one traversal of their trie."""
        fits, ending, sizes, steps, known = self.fits, self.ending, self.sizes, self._steps.get, self._fits.get
        out: dict[bytes, list[int]] = {}
        last, tails = [-1], [self.tail_of[b""]]  # of the path's nodes: the last token of the prefix, and its tail
        path = b""
        for word in sorted(set(words)):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], tails[shared + 1 :]
            tail, end = tails[shared], shared
            for byte in word[shared:]:
                end += 1
                tail = now if (now := steps(tail << 8 | byte)) is not None else self._step(tail, byte)
                for token in ending[tail]:
                    start = end - sizes[token]
                    if not start or (may if (may := known(last[start] << 20 | token)) is not None else fits(last[start], token)):
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                last.append(token)
                tails.append(tail)
            path, found = word, []
            while end:
                token = last[end]
                found.append(token)
                end -= sizes[token]
            out[word] = found[::-1]
        return out


class Encoder:
    """Encodes whole texts; ids are the little-endian 32-bit integers of the bytes returned."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(WORDS).findall
        self.chunks: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        """Put the ids of chunks, each with a space before it, into the table."""
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks = {c: self.chunks[c] for c in chunks if c in self.chunks}
        new = chunks.difference(self.chunks)
        # letters alone are one word
        one = {c: (" " + c).encode() for c in new if c.isascii() and c.isalpha()}
        parts = {c: [w.encode() for w in self.split(" " + c)] for c in new if c not in one}
        packed = self._packed({*one.values(), *(w for ws in parts.values() for w in ws)})
        for c, w in one.items():
            self.chunks[c] = packed[w]
        for c, ws in parts.items():
            self.chunks[c] = b"".join([packed[w] for w in ws])

    def _packed(self, words: set[bytes]) -> dict[bytes, bytes]:
        return {w: struct.pack(f"<{len(i)}I", *i) for w, i in self.vocabulary.encode_words(words).items()}

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts without added tokens.

        A single space belongs to the word after it, so a text without two spaces in a row is cut
        there, and each distinct chunk is encoded once.  Other texts are cut into words as a whole.
        """
        spaced = [bool(_TWO_SPACES.search(t)) or t[-1:].isspace() for t in texts]
        cut = [None if odd else t.split(" ") for t, odd in zip(texts, spaced, strict=True)]
        self._learn(set().union(*(cs[1:] for cs in cut if cs)))
        whole = [self.split(t if odd else cs[0]) for t, cs, odd in zip(texts, cut, spaced, strict=True)]
        packed = {w.decode(): ids for w, ids in self._packed({w.encode() for ws in whole for w in ws}).items()}
        get = self.chunks.__getitem__
        return [b"".join([*map(packed.__getitem__, ws), *(map(get, cs[1:]) if cs else ())]) for ws, cs in zip(whole, cut, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        added = self.vocabulary.added
        if not added or not any(a in t for t in texts for a in added):
            return self._plain(texts)
        parts = [self.vocabulary.split_added.split(t) for t in texts]
        plain = iter(self._plain([p for ps in parts for p in ps[::2]]))
        return [b"".join([np.array([added[p]], "<u4").tobytes() if k % 2 else next(plain) for k, p in enumerate(ps)]) for ps in parts]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _encoder(spec: str) -> Encoder:
    """One a worker; its table of chunks serves all its tasks."""
    return Encoder(Vocabulary(spec))


def _claimed(spec: str) -> Encoder:
    claim("bpe", _encoder.cache_clear)
    return _encoder(spec)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row; the tokenizer's file is read on the driver.

    A null text is encoded as an empty one, to no ids; repeated rows and null ids stay; an empty
    table gives an empty result.  There is no shuffle: each task encodes its own distinct words.
    With ``decoded`` there is a third column, the text that the ids decode to, from the same worker.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())  # noqa: SIM115  a vocabulary file, a few MB

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = _claimed(spec.value)
        packed = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
        ends = np.cumsum([0, *[len(p) // 4 for p in packed]], dtype=np.int32)
        values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
        columns, names = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"]
        if decoded:
            columns.append(pa.array([encoder.decode(np.frombuffer(p, "<u4")) for p in packed], pa.string()))
            names.append("text")
        yield pa.RecordBatch.from_arrays(columns, names)

    return map_texts(ids_and_texts(docs, id_col, text_col), kernel, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, text)``: the text of each row's ids, added tokens included; null ids give an empty text."""
    spec = encoded.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())  # noqa: SIM115

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(1)
                ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
                tell = _claimed(spec.value).decode
                texts = [tell(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    source = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, text string")
