"""Exact removal of repeated byte strings with suffix arrays.

A byte goes when some 50-byte string that covers it also starts in a document with a smaller id. Shards get the
strings that can be equal: every 50-byte window belongs to the least of its 16-byte grams (by hash), and windows that are
equal have that gram in common, so windows are dealt by it. The windows of a text that share their gram in a row travel as one piece;
pieces whose gram occurs in a single document are not sent at all, and equal pieces of a partition are sent once.

A shard sorts its suffixes by Larsson-Sadakane refinement (ranks of twice the length each round, only groups that are not yet
told apart), takes common prefixes with Kasai's walk, which runs through all pieces side by side, and so
has its distinct 50-byte strings in order with the smallest document of each. Shards of one partition then
look their strings up in each other by binary search.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Arrays, pack, small, splits, spread, unpack
from .common import partitions, table

LENGTH = 50
GRAM = 16
SLICE = 4 << 20  #: bytes of texts that are worked on at once
PART = 8 << 20  #: bytes of texts in a partition
SHARD = 2 << 20  #: bytes of pieces that get one suffix array
LOW = np.iinfo(np.int64).min  #: stands for a null id: before all others


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def runs(raw: np.ndarray, sizes: np.ndarray) -> Arrays:
    """Windows of each text that share their least gram in a row: text number, first byte in ``raw``, windows, gram hash."""
    none = {"doc": np.zeros(0, np.int64), "at": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "fp": np.zeros(0, np.uint64)}
    if len(raw) < LENGTH:
        return none
    v = raw.astype(np.uint64)
    for step in (1, 2, 4):
        v = v[: len(v) - step] | v[step:] << np.uint64(8 * step)
    h = (v[:-8] * np.uint64(0x9E3779B97F4A7C15)) ^ (v[8:] * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    place = np.arange(len(h), dtype=np.uint64)
    value = h & ~np.uint64(63) | place & np.uint64(63)  # a window spans fewer than 64 grams: the place can be had back
    w, least = LENGTH - GRAM + 1, value
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    count = np.maximum(sizes - LENGTH + 1, 0)
    s = spread(begins, count)
    doc = np.repeat(np.arange(len(sizes)), count)
    if not len(s):
        return none
    low = least[s]
    anchor = s + ((low.astype(np.int64) - s) & 63)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    return {"doc": doc[first], "at": s[first], "n": np.diff(np.concatenate([first, [len(s)]])), "fp": low[first] >> np.uint64(6)}


def _bucket(fp: np.ndarray, buckets: int) -> np.ndarray:
    return (fp >> np.uint64(8)).astype(np.int64) % buckets


def _slices(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows with their texts as bytes, one after the other, and the texts' sizes."""
    held, start, size = [], 0, 0
    for i, t in enumerate(rows.text):
        held.append(_bytes(t))
        size += len(held[-1])
        if size >= SLICE or i + 1 == len(rows):
            yield rows.iloc[start : i + 1], np.frombuffer(b"".join(held), np.uint8), np.fromiter(map(len, held), np.int64, len(held))
            held, start, size = [], i + 1, 0


# ---------------------------------------------------------------- suffix arrays


def suffix_order(raw: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes at least, and the rank of each (equal as far as compared: equal rank)."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    v = padded.astype(np.uint64)
    for step in (1, 2, 4):
        v = v[: len(v) - step] << np.uint64(8 * step) | v[step:]
    key = v[: len(raw)]
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(raw) else np.zeros(0, bool)
    rank = np.zeros(len(raw) + depth * 2, np.int64)  # beyond the end: rank 0, before all others
    start = np.flatnonzero(new)[np.cumsum(new) - 1] if len(raw) else np.zeros(0, np.int64)
    rank[order] = start + 1
    done = 8
    while done < depth:
        alone = new & np.concatenate([new[1:], [True]])
        open_ = np.flatnonzero(~alone)  # places of suffixes that share their rank with others
        if not len(open_):
            break
        who = order[open_]
        group, follow = rank[who], rank[who + done]
        sort = np.argsort(group * (len(raw) + 2) + follow)
        who, group, follow = who[sort], group[sort], follow[sort]
        order[open_] = who
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        new[open_] = fresh
        start = open_[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        rank[who] = start + 1
        done *= 2
    return order, rank[: len(raw)]


def common_prefixes(raw: np.ndarray, order: np.ndarray, begins: np.ndarray, sizes: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length, up to ``most``, that each suffix has in common with the one before it in ``order``.

    Kasai's walk in text order, where the length falls by one at most from a suffix to the next, for all pieces at once.
    """
    before = np.full(len(raw), -1)
    before[order[1:]] = order[:-1]
    out = np.zeros(len(raw), np.int64)
    padded = np.concatenate([raw, np.zeros(most + 1, np.uint8)])
    alive = np.arange(len(begins))
    length = np.zeros(len(begins), np.int64)
    for o in range(int(sizes.max(initial=0))):
        alive = alive[sizes[alive] > o]
        i = begins[alive] + o
        j = before[i]
        h = np.where(j >= 0, np.maximum(length[alive] - 1, 0), 0)
        go = np.flatnonzero(j >= 0)
        while len(go):
            a, b = i[go] + h[go], j[go] + h[go]
            go = go[(h[go] < most) & (np.maximum(a, b) < len(raw)) & (padded[np.minimum(a, len(raw))] == padded[np.minimum(b, len(raw))])]
            h[go] += 1
        out[i], length[alive] = h, h
    # the order is told apart to twice ``most`` bytes at best; suffixes that agree beyond may stand in either order, and the walk then
    # starts too far on: whatever reached the full length is compared once more
    full = np.flatnonzero(out >= most)
    for at in np.array_split(full, max(1, len(full) // 100_000)):
        other, same = before[at], np.ones(len(at), bool)
        for k in range(most):
            same &= padded[np.minimum(at + k, len(raw))] == padded[np.minimum(other + k, len(raw))]
        out[at[~same]] = most - 1
    return out


def shard_strings(pieces: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct LENGTH-byte strings of the pieces in order, the smallest document of each, and each window's string number."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    begins = np.cumsum(sizes) - sizes
    order, _ = suffix_order(raw)
    prefix = common_prefixes(raw, order, begins, sizes)
    windows = spread(begins, sizes - LENGTH + 1)
    owner = np.repeat(np.arange(len(pieces)), sizes - LENGTH + 1)
    is_window, piece_of = np.zeros(len(raw), bool), np.zeros(len(raw), np.int64)
    is_window[windows], piece_of[windows] = True, owner
    group = np.cumsum(prefix[order] < LENGTH) - 1  # suffixes that agree in LENGTH bytes stand together
    kept = is_window[order]
    group, place = group[kept], order[kept]
    number = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if len(group) else group
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else number
    least = np.minimum.reduceat(docs[piece_of[place]], first) if len(first) else np.zeros(0, np.int64)
    strings = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[place[first]] if len(first) else np.zeros((0, LENGTH), np.uint8)
    of = np.zeros(len(raw), np.int64)
    of[place] = number
    return np.ascontiguousarray(strings).view(f"S{LENGTH}")[:, 0] if len(first) else np.zeros(0, f"S{LENGTH}"), least, of[windows]


def least_documents(pieces: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each window of each piece the smallest document that has its string, over all shards."""
    sizes = np.cumsum([len(p) for p in pieces])
    cuts = np.flatnonzero(np.diff(sizes // SHARD)) + 1 if len(pieces) else []
    shards = []
    for rows in np.split(np.arange(len(pieces)), cuts):
        shards.append((rows, *shard_strings([pieces[i] for i in rows], docs[rows])))
    for a, (_, mine, least, _) in enumerate(shards):
        for _, other, theirs, _ in shards[:a]:
            if len(mine) and len(other):
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                same = np.flatnonzero(other[at] == mine)
                both = np.minimum(least[same], theirs[at[same]])
                least[same], theirs[at[same]] = both, both
    for a, (_, mine, least, _) in reversed(list(enumerate(shards))):  # what later shards knew goes back to earlier ones
        for _, other, theirs, _ in shards[:a]:
            if len(mine) and len(other):
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                same = np.flatnonzero(other[at] == mine)
                theirs[at[same]] = np.minimum(least[same], theirs[at[same]])
    out: list[np.ndarray] = []
    for rows, _, least, of in shards:
        out += np.split(least[of], np.cumsum([len(pieces[i]) - LENGTH + 1 for i in rows])[:-1])
    return out


# ---------------------------------------------------------------- the job


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, marks): the rows (doc_id, text, part) dealt into partitions, and blocks of repeated spans for each partition."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), math.ceil(every / PART))
    buckets = parts
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    dealt = rows.repartition(parts, "part")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, raw, sizes in _slices(batch):
                r = runs(raw, sizes)
                own, place = part.doc_id.fillna(LOW).to_numpy(np.int64), part.part.to_numpy(np.int64)
                order = np.argsort(r["fp"], kind="stable")  # runs come by document, so pairs end up in order
                fp, doc = r["fp"][order], r["doc"][order]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
                fp, doc = fp[new], doc[new]
                for at in splits(_bucket(fp, buckets)):
                    kinds, number = np.unique(doc[at], return_inverse=True)
                    blob = pack({"fp": fp[at], "doc": small(number), "id": own[kinds], "part": place[kinds]})
                    yield pd.DataFrame({"bucket": [int(_bucket(fp[at[:1]], buckets)[0])], "blob": [blob]})

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        """Grams that occur in several documents, for each partition that has them."""
        sets = [unpack(b) for b in group.blob]
        fp = np.concatenate([a["fp"] for a in sets])
        ids = np.concatenate([a["id"][a["doc"]] for a in sets])
        place = np.concatenate([a["part"][a["doc"]] for a in sets])
        order = np.argsort(fp, kind="stable")
        fp, ids, place = fp[order], ids[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
        keep = np.repeat(several, np.diff(np.concatenate([first, [len(fp)]])))
        fp, place = fp[keep], place[keep]
        return pd.DataFrame([(int(place[at[0]]), pack({"fp": np.unique(fp[at])})) for at in splits(place)], columns=["part", "blob"])

    def pieces(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Pieces whose gram other documents have too: each different one once, with its places."""
        out = []
        if len(left) and len(right):
            wanted = np.unique(np.concatenate([unpack(b)["fp"] for b in right.blob]))
            found: dict[str, list] = {"fp": [], "doc": [], "at": [], "piece": []}
            seen: dict[bytes, int] = {}
            base = 0
            for part, raw, sizes in _slices(left):
                r = runs(raw, sizes)
                at = np.minimum(np.searchsorted(wanted, r["fp"]), len(wanted) - 1)
                keep = np.flatnonzero(wanted[at] == r["fp"])
                whole, a = raw.tobytes(), r["at"][keep]
                found["piece"].append(np.fromiter((seen.setdefault(whole[i:j], len(seen)) for i, j in zip(a.tolist(), (a + r["n"][keep] + LENGTH - 1).tolist())), np.int64, len(keep)))
                found["fp"].append(r["fp"][keep])
                found["doc"].append(r["doc"][keep] + base)
                found["at"].append(a - (np.cumsum(sizes) - sizes)[r["doc"][keep]])
                base += len(part)
            f = {k: np.concatenate(v) for k, v in found.items()}
            ids, texts = left.doc_id.fillna(LOW).to_numpy(np.int64), list(seen)
            for rows_ in splits(_bucket(f["fp"], buckets)):
                kinds, number = np.unique(f["piece"][rows_], return_inverse=True)
                order = np.argsort(number, kind="stable")
                rows_, number = rows_[order], number[order]
                own, doc = np.unique(f["doc"][rows_], return_inverse=True)
                sizes = np.array([len(texts[i]) for i in kinds])
                blob = pack({"raw": np.frombuffer(b"".join(texts[i] for i in kinds), np.uint8), "size": small(sizes), "of": small(number), "at": small(f["at"][rows_]), "doc": small(doc), "row": small(own), "id": ids[own], "gram": (f["fp"][rows_[np.searchsorted(number, np.arange(len(kinds)))]] >> np.uint64(32)).astype(np.uint32)})
                out.append((int(_bucket(f["fp"][rows_[:1]], buckets)[0]), int(key[0]), blob))
        return pd.DataFrame(out, columns=["bucket", "part", "blob"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        """Suffix arrays over the different pieces of all partitions; marks go back to where the pieces came from."""
        sets = [unpack(b) for b in group.blob]
        seen: dict[bytes, int] = {}
        numbers, least = [], []
        for a in sets:
            raw, ends = a.pop("raw").tobytes(), np.cumsum(a["size"].astype(np.int64))
            numbers.append(np.fromiter((seen.setdefault(raw[i:j], len(seen)) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())), np.int64, len(ends)))
            first = np.flatnonzero(np.concatenate([[True], a["of"][1:] != a["of"][:-1]]))
            least.append(np.minimum.reduceat(a["id"][a["doc"]], first))
        low = np.full(len(seen), np.iinfo(np.int64).max)
        for n, x in zip(numbers, least):
            np.minimum.at(low, n, x)
        # a piece whose gram stands in no other piece has all its windows to itself; the others need suffix arrays
        gram = np.zeros(len(seen), np.uint32)
        for a, n in zip(sets, numbers):
            gram[n] = a["gram"]
        texts, size = list(seen), np.fromiter((len(x) - LENGTH + 1 for x in seen), np.int64, len(seen))
        kinds, number, times = np.unique(gram, return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[number] > 1)
        several = several[np.argsort(number[several], kind="stable")]
        begin, flat, least_of, most_of = np.zeros(len(seen), np.int64), np.zeros(0, np.int64), low.copy(), low.copy()
        if len(several):
            found = least_documents([texts[i] for i in several], low[several])
            begin[several] = np.cumsum(size[several]) - size[several]
            flat = np.concatenate(found)
            least_of[several], most_of[several] = np.minimum.reduceat(flat, begin[several]), np.maximum.reduceat(flat, begin[several])
        out = []
        for part, a, n in zip(group.part, sets, numbers):
            piece, row, start = n[a["of"]], a["row"][a["doc"]].astype(np.int64), a["at"].astype(np.int64)
            own = a["id"][a["doc"]]
            whole = own > most_of[piece]  # every window of the piece stands in an earlier document
            some = np.flatnonzero(~whole & (own > least_of[piece]))
            rows, starts, ends = [row[whole]], [start[whole]], [(start + size[piece])[whole]]
            if len(some):
                many = size[piece[some]]
                hit = flat[spread(begin[piece[some]], many)] < np.repeat(own[some], many)
                of, place = np.repeat(some, many), spread(start[some], many)
                edge = np.concatenate([[True], of[1:] != of[:-1]])
                opens = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
                closes = np.flatnonzero(hit & np.concatenate([edge[1:] | ~hit[1:], [True]]))
                rows, starts, ends = [*rows, row[of[opens]]], [*starts, place[opens]], [*ends, place[closes] + 1]
            rows, starts, ends = map(np.concatenate, (rows, starts, ends))
            if len(rows):
                order = np.argsort(rows, kind="stable")
                out.append((int(part), pack({"row": small(rows[order]), "start": small(starts[order]), "n": small((ends - starts)[order] + LENGTH - 1)})))
        return pd.DataFrame(out, columns=["part", "blob"])

    wanted = rows.mapInPandas(grams, "bucket int, blob binary").groupBy("bucket").applyInPandas(shared, "part int, blob binary")
    # rows of a partition are numbered in the order of ids and texts, the same each time
    sent = _by_part(dealt, wanted, pieces, "bucket int, part int, blob binary")
    return dealt, sent.groupBy("bucket").applyInPandas(compare, "part int, blob binary")


def _by_part(dealt: DataFrame, blocks: DataFrame, f, schema: str) -> DataFrame:
    """``f(key, rows, blocks)`` for each partition; its rows come in the order of ids and texts."""

    def ordered(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = pd.DataFrame({"id": left.doc_id.fillna(LOW).astype("int64"), "text": left.text.fillna("")})
        return f(key, left.loc[keys.sort_values(["id", "text"], kind="stable").index].reset_index(drop=True), right)

    return dealt.groupBy("part").cogroup(blocks.groupBy("part")).applyInPandas(ordered, schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row for each row of ``docs``.

    ``kept`` is what is left, as bytes. Null texts are empty. Rows with the same doc_id do not remove each other's bytes; a null doc_id comes
    before all others. Texts of fewer than 50 bytes lose nothing; very long ones are worked on whole, by one task. Empty tables stay empty; other columns play no part.
    """
    dealt, marks = repeated_spans(docs, doc_id, text)

    def cut(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sets = [unpack(b) for b in right.blob]
        row, start, n = (np.concatenate([np.zeros(0, np.int64), *(a[c].astype(np.int64) for a in sets)]) for c in ("row", "start", "n"))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], (start + n)[order]
        first = np.searchsorted(row, np.arange(len(left) + 1))
        out = []
        for i, (own, t) in enumerate(zip(left.doc_id, left.text)):
            raw, kept, at, spans = _bytes(t), [], 0, 0
            last = -1
            for a, b in zip(start[first[i] : first[i + 1]].tolist(), end[first[i] : first[i + 1]].tolist()):
                if a > last:  # not even adjacent to the span before it
                    spans += 1
                    kept.append(raw[at:a])
                elif a > at:
                    kept.append(raw[at:a])
                at = last = max(at, b)
            kept.append(raw[at:])
            left_over = b"".join(kept)
            out.append((own, len(raw), len(raw) - len(left_over), spans, hashlib.sha256(left_over).hexdigest(), left_over))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    return _by_part(dealt, marks, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, removed bytes and spans, and the digest of what is left; odd rows as in ``remove_repeats``."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
