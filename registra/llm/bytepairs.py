"""Byte-level BPE encoding and decoding of whole texts by a file of ranks.

A text falls into the matches of a pattern, each of which is encoded by a tree reduction. Encodings of byte strings form a monoid under
"the encoding of both together": a string is encoded as its two halves, recursively, and neighbours are joined by merging the bytes around
their border anew. The window starts with one token on each side; while the outermost token of a side changes, that side of the window is doubled.

Why that is enough: a sequence of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of theirs, because merges
inside a token do not look beyond it, and a merge across a border would show up in the two tokens alone. (It takes tokens that
encode to themselves: the vocabulary is checked for that, and one that fails is merged without the tree.) Once the outermost tokens of the
window are those that stood there before, all pairs outside are old ones and all pairs inside are checked, so the tokens outside stay.

Decoding looks up the bytes of each token and concatenates them up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 16  #: bytes that are merged without a further split
SLICE = 1_000_000  #: characters of a text that are worked on at once, cut between matches
NONE = 1 << 62  #: above every rank: no token
REMEMBER, SHORT = 300_000, 64  #: matches that a task remembers, of at most so many characters
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the pattern of the vocabulary


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    """Token bytes -> rank, which is also the id; bounded by the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes and decodes byte strings by ranks."""

    def __init__(self, ranks: dict[bytes, int], whole: bool | None = None) -> None:
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        #: whether all tokens encode to themselves
        self.whole = all(len(b) == 1 or self.merge(b) == [i] for b, i in ranks.items()) if whole is None else whole

    def merge(self, raw: bytes) -> list[int]:
        """Plain merging: of all neighbours that form a token those of the least rank first, the leftmost among equals."""
        ranks, n = self.ranks, len(raw)
        if n <= 2 * SHORT:
            rank = ranks.get
            cuts = list(range(n + 1))
            scores = [rank(raw[i : i + 2], NONE) for i in range(n - 1)]
            while scores and (best := min(scores)) != NONE:
                i = scores.index(best)
                del cuts[i + 1], scores[i]
                if i < len(scores):
                    scores[i] = rank(raw[cuts[i] : cuts[i + 2]], NONE)
                if i:
                    scores[i - 1] = rank(raw[cuts[i - 1] : cuts[i + 1]], NONE)
            return [ranks[raw[a:b]] for a, b in zip(cuts, cuts[1:])]
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by the first byte of each part
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heappop(heap)
            right = end[i]
            if not alive[i] or right >= n or end[right] != stop:
                continue
            alive[right] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := ranks.get(raw[j:stop])) is not None:
                heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both byte strings together."""
        a = b = 1
        while left and right:
            inner = self.merge(self.decode(left[-a:]) + self.decode(right[:b]))
            grown = (a, b)
            if a < len(left) and inner[0] != left[-a]:
                a = min(2 * a, len(left))
            if b < len(right) and inner[-1] != right[b - 1]:
                b = min(2 * b, len(right))
            if grown == (a, b):
                return left[:-a] + inner + right[b:]
        return left or right

    def tree(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF:
            return self.merge(raw)
        half = len(raw) // 2
        first = self.tree(raw[:half])
        return self.join(first, first if raw[:half] == raw[half:] else self.tree(raw[half:]))

    def encode(self, raw: bytes) -> list[int]:
        """Token ids of one match."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        return self.tree(raw) if self.whole else self.merge(raw)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join([self.bytes_of[i] for i in ids])
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


class _Known(dict):
    """Matches and what has been made of them; what is missing is made, and kept if it is short."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, match: str):
        made = self.make(match)
        if len(match) <= SHORT:
            if len(self) >= REMEMBER:
                self.clear()
            self[match] = made
        return made


def _slices(text: str, border: regex.Pattern) -> Iterator[str]:
    """Parts of at most about SLICE characters, cut before white space that follows something else: there a match ends in any case."""
    at = 0
    while len(text) - at > SLICE:
        cut = border.search(text, at + SLICE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Texts:
    """Encodes whole texts, slice by slice."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, whole: bool | None = None) -> None:
        self.encoder = Encoder(ranks, whole)
        self.matches, self.border = regex.compile(pattern), regex.compile(r"(?<=\S)\s")
        self.ids_of = _Known(lambda m: self.encoder.encode(m.encode("utf-8", "replace")))
        self.words_of = _Known(lambda m: " ".join(map(str, self.ids_of[m])))
        self.bytes_of = _Known(lambda m: self.encoder.decode(self.ids_of[m]))

    def ids(self, text: str | None) -> np.ndarray:
        parts = [np.fromiter((i for m in self.matches.findall(s) for i in self.ids_of[m]), np.int32) for s in _slices(text or "", self.border)]
        return np.concatenate(parts)

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """How many tokens, and the SHA-256 of the ids as text and of the bytes that they decode to."""
        n, words, raw = 0, hashlib.sha256(), hashlib.sha256()
        for part in _slices(text or "", self.border):
            found = self.matches.findall(part)
            if found:
                line = " ".join(map(self.words_of.__getitem__, found))
                words.update((" " + line if n else line).encode())
                raw.update(b"".join(map(self.bytes_of.__getitem__, found)))
                n += line.count(" ") + 1
        return n, words.hexdigest(), raw.hexdigest()


def _shared(spark: SparkSession, path: str, pattern: str = PATTERN) -> Broadcast:
    ranks = load_ranks(path)
    return spark.sparkContext.broadcast((ranks, pattern, Encoder(ranks).whole))


def _with(docs: DataFrame, new: dict[str, str], make, shared) -> DataFrame:
    """``docs`` with new columns (name: type) from ``make(state, row batch)``; columns of the same names are replaced."""
    rest = docs.drop(*new)
    names = [*rest.columns, *new]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Texts(*shared.value)
        for rows in batches:
            yield rows.assign(**dict(zip(new, make(state, rows))))[names]

    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), *(f"`{c}` {t}" for c, t in new.items())]
    return docs.mapInPandas(run, ", ".join(kinds))


def encode(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the token ids of the whole text.

    Null and empty texts have none. Each row is treated on its own, so order, repeats and other columns play no part; very long texts are
    worked on in slices, an unbroken match as a whole. A column named like ``out`` is replaced. Empty tables stay empty.
    """
    shared = _shared(docs.sparkSession, path, pattern)
    return _with(docs, {out: "array<int>"}, lambda t, rows: [[t.ids(x) for x in rows[text]]], shared)


def decode(docs: DataFrame, path: str = RANKS, ids: str = "ids", out: str = "raw") -> DataFrame:
    """Adds ``out``, the bytes of the token ids; null and empty lists give no bytes, an id outside the vocabulary is an error."""
    shared = _shared(docs.sparkSession, path)
    return _with(docs, {out: "binary"}, lambda t, rows: [[t.encoder.decode([] if x is None else list(x)) for x in rows[ids]]], shared)


def digests(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 (of the decimal ids joined by a blank) and decoded_sha256 (of the bytes that the ids decode to), in one pass."""
    shared = _shared(docs.sparkSession, path, pattern)
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return _with(docs, new, lambda t, rows: list(zip(*map(t.digests, rows[text]))) or [[], [], []], shared)


def op12_byte_level_bpe(spark: SparkSession, sf_dir: str, path: str = RANKS) -> DataFrame:
    """Per document: its number of tokens and the digests of its ids and of what they decode to."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
