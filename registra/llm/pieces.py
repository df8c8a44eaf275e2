"""SentencePiece encoding and decoding of whole texts.

An Aho-Corasick automaton over the UTF-8 bytes of all pieces reads each text once. At each byte the output links list, longest
first, every piece that ends there, and the best score of a segmentation up to that byte is relaxed with each of
them (Viterbi). Characters without a piece cost the lowest piece score less ten and become byte pieces.

Where no piece holds a blank after another character, segmentations of different words cannot touch, so each distinct word is
segmented once; numpy moves all new words of a batch through the automaton side by side, one byte a step.

Scores are those of the model file. For a model that was trained as BPE they rank its merges; the best-scoring segmentation is
then what the SentencePiece library returns for the same pieces as a unigram model, not its merge order.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import spread
from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6  #: kinds of pieces in a model file
UNKNOWN_COST = 10.0
SLICE = 2_000_000  #: characters that are worked on at once
REMEMBER = 200_000  #: distinct words that are remembered in a task


# ---------------------------------------------------------------- the model file


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Numbered fields of one message in the protocol buffer format."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            n, i = number(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


def load_model(path: str = MODEL) -> dict:
    """Automaton arrays and piece bytes of a model file; a few MB, bounded by the vocabulary."""
    raw = open(path, "rb").read()
    pieces, prefix = [], 1
    for f, v in _fields(raw):
        if f == 1:
            d = dict(_fields(v))
            pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
        elif f == 3:
            d = dict(_fields(v))
            if d.get(2) or d.get(4, 1):
                raise ValueError("only models with the identity normalizer that keep white space are supported")
            prefix = d.get(3, 1)
    children: list[dict[int, int]] = [{}]
    depth, piece = [0], [-1]
    for i, (text, _, kind) in enumerate(pieces):
        if kind in (NORMAL, USER) and text:
            at = 0
            for b in text.encode():
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    piece.append(-1)
                at = children[at][b]
            piece[at] = i
    n = len(children)
    fail, link, order = [0] * n, [0] * n, [0]
    for at in order:  # breadth first; link: the longest piece that ends where this node's proper suffixes end
        for b, to in children[at].items():
            f = fail[at]
            while f and b not in children[f]:
                f = fail[f]
            fail[to] = children[f][b] if at and b in children[f] else 0
            link[to] = fail[to] if piece[fail[to]] >= 0 else link[fail[to]]
            order.append(to)
    edges = np.array([(a, b, to) for a in order for b, to in children[a].items()], np.int32)
    scores = np.array([s for _, s, _ in pieces])
    low = min(s for _, s, k in pieces if k == NORMAL)
    bytes_of = [bytes([int(t[3:5], 16)]) if k == BYTE else t.encode() if k in (NORMAL, USER) else b"" for t, _, k in pieces]
    byte_ids = np.full(256, next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0), np.int32)
    for i, (_, _, k) in enumerate(pieces):
        if k == BYTE:
            byte_ids[bytes_of[i][0]] = i
    return {
        "edges": edges, "fail": np.array(fail, np.int32), "link": np.array(link, np.int32), "depth": np.array(depth, np.int32),
        "piece": np.array(piece, np.int32), "score": np.where(np.array(piece) >= 0, scores[piece], 0.0), "unknown": low - UNKNOWN_COST,
        "bytes": b"".join(bytes_of), "sizes": np.array([len(x) for x in bytes_of]), "byte_ids": byte_ids, "prefix": bool(prefix),
        "apart": not any(BLANK in t.lstrip(BLANK) for t, _, k in pieces if k in (NORMAL, USER)),
    }


class Segmenter:
    """The automaton with all its moves filled in, and the words that it has seen."""

    def __init__(self, model: dict) -> None:
        self.m = model
        edges, fail = model["edges"], model["fail"]
        used = np.unique(edges[:, 1])
        self.kind = np.zeros(256, np.int32)  # bytes in no piece share column 0
        self.kind[used] = np.arange(1, len(used) + 1)
        self.move = np.zeros((len(fail), len(used) + 1), np.int32)
        level = model["depth"][edges[:, 2]]
        for d in range(1, int(level.max(initial=0)) + 1):
            a, b, to = edges[level == d].T
            self.move[a, self.kind[b]] = to
            self.move[to] = self.move[fail[to]]
            # moves of a level's nodes are set by the next level, on top of those of their suffixes
        self.out = np.where(model["piece"] >= 0, np.arange(len(fail)), model["link"]).astype(np.int32)
        self.starts = np.cumsum(model["sizes"]) - model["sizes"]
        self.raw = np.frombuffer(model["bytes"], np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words one after the other, and how many each has."""
        m, count = self.m, len(words)
        size = np.fromiter(map(len, words), np.int64, count)
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(words), np.uint8)
        off = (np.cumsum(size) - size)[order]
        n_of, slot = size[order], off + order  # a word of n bytes has n+1 places
        best = np.full(len(flat) + count, -np.inf)
        best[slot] = 0.0
        took, node_of = np.zeros(len(best), np.int32), np.zeros(len(best), np.int32)
        state, begin = np.zeros(count, np.int32), np.zeros(count, np.int64)
        n = count
        for t in range(int(n_of[0]) if count else 0):
            n = int(np.searchsorted(-n_of, -t, "left"))  # words longer than t
            byte = flat[off[:n] + t]
            begin[:n] = np.where(byte & 0xC0 == 0x80, begin[:n], t)
            state[:n] = self.move[state[:n], self.kind[byte]]
            top, by, nodes = np.full(n, -np.inf), np.zeros(n, np.int32), np.zeros(n, np.int32)
            least = np.zeros(n, np.int32)
            rows = np.flatnonzero(self.out[state[:n]])
            node = self.out[state[rows]]
            while len(rows):
                length = m["depth"][node]
                value = best[slot[rows] + t + 1 - length] + m["score"][node]
                up = value > top[rows]
                top[rows[up]], by[rows[up]], nodes[rows[up]] = value[up], length[up], node[up]
                least[rows] = length
                node = m["link"][node]
                rows, node = rows[node > 0], node[node > 0]
            more = n_of[:n] > t + 1
            after = flat[np.minimum(off[:n] + t + 1, len(flat) - 1)]
            whole = ~more | (after & 0xC0 != 0x80)
            width = t + 1 - begin[:n]
            bare = np.flatnonzero(whole & (least != width))
            value = best[slot[bare] + begin[bare]] + m["unknown"]
            up = value > top[bare]
            bare, value = bare[up], value[up]
            top[bare], by[bare], nodes[bare] = value, width[bare], 0
            here = slot[:n] + t + 1
            best[here], took[here], node_of[here] = top, by, nodes
        # back from the ends, again side by side
        row, pos = np.arange(count), n_of.copy()
        row, pos = row[pos > 0], pos[pos > 0]
        steps = []
        while len(row):
            at = slot[row] + pos
            steps.append((row, pos, node_of[at], took[at]))
            pos = pos - took[at]
            row, pos = row[pos > 0], pos[pos > 0]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(count, np.int64)
        row, pos, node, length = (np.concatenate(x) for x in zip(*steps))
        word = order[row]
        sort = np.lexsort((pos, word))
        row, pos, node, length, word = row[sort], pos[sort], node[sort], length[sort], word[sort]
        each = np.where(node > 0, 1, length).astype(np.int64)
        ids = np.repeat(m["piece"][node], each).astype(np.int32)
        single = np.flatnonzero(node == 0)
        if len(single):
            put = np.cumsum(each) - each
            ids[spread(put[single], each[single])] = m["byte_ids"][flat[spread(off[row[single]] + pos[single] - length[single], each[single])]]
        return ids, np.bincount(word, weights=each, minlength=count).astype(np.int64)

    def units(self, text: str) -> list[str]:
        """The parts of a text that are segmented on their own, each without its first blank mark."""
        text = text.replace(BLANK, " ")
        if not text:
            return []
        if not self.m["apart"]:
            return [(BLANK if self.m["prefix"] else "") + text.replace(" ", BLANK)]
        if not self.m["prefix"] and text[0] != " ":
            head, _, rest = text.partition(" ")
            return ["\0" + head, *(self.units(" " + rest) if _ else [])]
        if self.m["prefix"]:
            text = " " + text
        if "  " not in text and text[-1] != " ":
            return text[1:].split(" ")
        return [x[1:].replace(" ", BLANK) for x in re.findall(" +[^ ]*", text)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after the other, and how many each has."""
        parts = [self.units(t or "") for t in texts]
        if len(self.known) > REMEMBER:
            self.forget()
        known = self.known
        fresh = [u for u in dict.fromkeys(u for p in parts for u in p) if u not in known]
        if fresh:
            lead = BLANK if self.m["apart"] else ""
            ids, size = self.segment([(u[1:] if u[:1] == "\0" and not self.m["prefix"] else lead + u).encode("utf-8", "surrogatepass") for u in fresh])
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        unit = np.fromiter((known[u] for p in parts for u in p), np.int64, int(count.sum()))
        size = self.size[unit]
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(count)
        return self.ids[spread(self.at[unit], size)], total[ends] - total[ends - count]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        each = self.m["sizes"][ids]
        raw = self.raw[spread(self.starts[ids], each)].tobytes()
        total = np.concatenate([[0], np.cumsum(each)])
        ends = total[np.cumsum(sizes)].tolist()
        texts = [raw[a:b].decode("utf-8", "replace").replace(BLANK, " ") for a, b in zip([0, *ends[:-1]], ends)]
        return [t[1:] if self.m["prefix"] and t[:1] == " " else t for t in texts]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", out: str = "ids", digest: bool = False) -> DataFrame:
    """Adds ``out``, the piece ids of the whole text, and with ``digest`` the SHA-256 of the text that they decode to.

    Null and empty texts have no pieces. Each row is treated on its own, so order, repeats and other columns play no part; a
    column that is named like ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = Segmenter(shared.value)
        for rows in batches:
            texts = rows[text].tolist()
            for a, b in _slices(texts):
                ids, sizes = seg.encode(texts[a:b])
                part = rows.iloc[a:b].copy()
                part[out] = np.split(ids, np.cumsum(sizes)[:-1])
                if digest:
                    part["decoded_sha256"] = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in seg.decode(ids, sizes)]
                yield part

    rest = docs.drop(out, *(["decoded_sha256"] if digest else []))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{out}` array<int>", *(["decoded_sha256 string"] if digest else [])])
    return rest.mapInPandas(run, kinds)


def decode(docs: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds ``out``, the text of the piece ids; null and empty lists give an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = Segmenter(shared.value)
        for rows in batches:
            lists = [np.asarray(x if x is not None else [], np.int32) for x in rows[ids]]
            rows[out] = seg.decode(np.concatenate([np.zeros(0, np.int32), *lists]), np.fromiter(map(len, lists), np.int64, len(lists)))
            yield rows

    rest = docs.drop(out)
    return rest.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{out}` string"]))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Per document: its piece ids, their number, and whether they decode to the text (marks U+2581 count as blanks)."""
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, digest=True)
    same = F.sha2(F.translate(F.coalesce("text", F.lit("")), BLANK, " "), 256) == F.col("decoded_sha256")
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "decoded_sha256", same.alias("round_trip"))
