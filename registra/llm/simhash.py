"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints within ``radius`` bits of each other are linked, all of them: the masks of the covering scheme
(one for each non-zero vector v of radius+1 bits; mask v keeps bit i when the parity of v & code(i) is odd)
leave, for any set of at most ``radius`` differing bits, at least one mask that keeps none of them, so each such pair
meets in some table under equal masked values.

Equal texts share a fingerprint, so copies collapse to one row before any table is built. Within one table's
bucket the links are found in place and handed on as a star (each member to the smallest it is
connected with), never as all pairs. A bucket with many members is dealt again, by the same covering scheme over the bits
that its own mask dropped, until its parts are small; 64 bits halve with each step, so parts of at most 2**8 members are
reached after three steps, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import partitions, settle, table
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
DIRECT = 1024  #: members of a bucket that are compared pair by pair
CHUNK = 1 << 16  #: shingles whose bits are counted at once


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """64-bit SimHash: bit set when it is set in over half of the shingles' XXH64.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are ``n`` words joined by a space, repeats
    included; fewer words give one shingle, none (also null and empty text) gives zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - n + 1)
    last = ends[min(n, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, k, CHUNK):
        pairs = zip(starts[at : min(at + CHUNK, k)].tolist(), last[at : at + CHUNK].tolist())
        h = np.fromiter((digest(joined[i:j], SEED) for i, j in pairs), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > k).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", n: int = SHINGLE) -> DataFrame:
    """Adds ``fp``, the fingerprint's 64 bits as a signed long."""

    @pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.fromiter((fingerprint(x, n) for x in t), np.uint64, len(t)).view(np.int64))

    return docs.withColumn("fp", fp(F.col(text)))


def covering_masks(radius: int, bits: np.ndarray | None = None) -> np.ndarray:
    """Masks over the given bit positions (64 by default); bit i keeps to mask v when v & code(i) has odd parity.

    Codes run through all non-zero values of radius+1 bits in turn, so each mask keeps about half of the bits.
    """
    bits = np.arange(64) if bits is None else bits
    code = np.arange(len(bits)) % ((1 << (radius + 1)) - 1) + 1
    masks = []
    for v in range(1, 1 << (radius + 1)):
        odd = np.array([bin(v & int(c)).count("1") % 2 for c in code], bool)
        masks.append(np.bitwise_or.reduce(np.uint64(1) << bits[odd].astype(np.uint64), initial=np.uint64(0)))
    return np.array(masks, np.uint64)


def _links(fp: np.ndarray, group: np.ndarray, kept: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers within ``radius`` of each other, enough of them to connect all that are.

    ``group`` is sorted and tells the buckets apart; ``kept`` is the mask under which a bucket's members are equal.
    """
    out_a, out_b = [], []
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([edges, [len(group)]]))
    small = np.repeat(sizes, sizes) <= DIRECT
    left = np.repeat(edges + sizes, sizes) - np.arange(len(group)) - 1  # members after this one
    rows = np.flatnonzero(small & (left > 0))
    step = 1
    while len(rows):
        near = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= radius
        out_a.append(rows[near])
        out_b.append(rows[near] + step)
        step += 1
        rows = rows[left[rows] >= step]
    for e, s in zip(edges[sizes > DIRECT].tolist(), sizes[sizes > DIRECT].tolist()):
        free = np.array([i for i in range(64) if not int(kept[e]) >> i & 1])
        for m in covering_masks(radius, free):
            value = fp[e : e + s] & m
            order = np.argsort(value, kind="stable")
            a, b = _links(fp[e : e + s][order], value[order], np.full(s, kept[e] | m), radius)
            out_a.append(e + order[a])
            out_b.append(e + order[b])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64),) * 2


def _stars(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the smallest row number it is connected with."""
    low = np.arange(len(fp))
    while len(a):
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], m)
        np.minimum.at(low, low[b], m)
        low = low[low]
        open_ = low[a] != low[b]
        a, b = a[open_], b[open_]
    while (low != low[low]).any():
        low = low[low]
    return low


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp) distinct -> (src, dst): links between fingerprints that connect all pairs within ``radius`` bits."""
    spark = fps.sparkSession
    masks = covering_masks(radius)
    signed = [int(m) for m in masks.view(np.int64)]
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(signed)])).alias("e")

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(held)
            fp = rows.fp.to_numpy().view(np.uint64)
            t, v = rows.t.to_numpy(), rows.v.to_numpy()
            group = np.cumsum(np.concatenate([[0], (t[1:] != t[:-1]) | (v[1:] != v[:-1])]))
            low = _stars(fp, *_links(fp, group, masks[t], radius))
            other = low != np.arange(len(fp))
            s = fp.view(np.int64)
            return pd.DataFrame({"src": s[other], "dst": s[low[other]]})

        held: list[pd.DataFrame] = []
        for part in batches:  # rows come sorted: all but the last bucket are whole
            if not len(part):
                continue
            t, v = part.t.to_numpy(), part.v.to_numpy()
            cut = np.flatnonzero((t != t[-1]) | (v != v[-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            same = bool(held) and held[-1].t.iloc[-1] == t[-1] and held[-1].v.iloc[-1] == v[-1]
            if cut or (held and not same):
                yield flush([*held, part.iloc[:cut]])
                held = []
            held.append(part.iloc[cut:])
        if held:
            yield flush(held)

    dealt = fps.select("fp", tables).select("fp", "e.t", "e.v").repartition(partitions(spark), "t", "v").sortWithinPartitions("t", "v")
    return dealt.mapInPandas(within, "src long, dst long").distinct()


def _members(prints: DataFrame, radius: int) -> DataFrame:
    """``prints`` (doc_id, fp and more; a written table) with ``group``, the fingerprint that names the row's component, and component_id."""
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = settle(components(fingerprint_links(classes.select("fp"), radius)))
    # components are named by fingerprints; each takes the smallest doc_id among its classes
    named = classes.join(found, classes.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("group"))
    lows = named.groupBy("group").agg(F.min("low").alias("component_id"))
    return prints.join(named.join(lows, "group").select("fp", "group", "component_id"), "fp", "left")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` bits reach, the row's own included. Null and
    empty texts have fingerprint zero and are linked like any other. A null doc_id keeps its row; its component is the
    smallest known id, or null where there is none. Very long texts are fingerprinted whole, in chunks. An empty table gives an
    empty result; other columns play no part.
    """
    prints = settle(with_fingerprint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", n).select("doc_id", "fp"))
    return _members(prints, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint and its near-duplicate component; nulls, repeats and empty tables as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group of ``docs``: that with the smallest doc_id, with the columns it has.

    Rows are told apart by doc_id and text together, so another text under a repeated doc_id stays. Among rows of one id the smaller hash
    of the text decides; of rows that are equal in both, one stays. A null doc_id comes after all others. Null and empty texts are
    near duplicates of each other. An empty table stays empty.
    """
    key = lambda *seed: F.xxhash64(*seed, F.col(doc_id), F.col(text))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), key().alias("k1"), key(F.lit("second")).alias("k2"))
    prints = settle(with_fingerprint(rows.select("doc_id", "k1", "k2", "text"), "text").select("doc_id", "k1", "k2", "fp"))
    kept = _members(prints, RADIUS).groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first"))
    kept = kept.select("first.k1", "first.k2")
    return rows.select("row", "k1", "k2").join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
