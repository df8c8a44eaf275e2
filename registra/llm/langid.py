"""Language identification with interpolated Kneser-Ney character models.

One model per language: n-grams of up to four characters as sorted 64-bit hashes beside the logarithms of their interpolated
probabilities and of their back-off weights. A text gets the language with the lowest cross-entropy per character.
Texts are lower-cased; runs of anything but letters become one blank.

For scoring, the models' sorted arrays are laid over each other once: an n-gram that any language knows has one row with
its probability in every language, so a character costs one look-up instead of one for each language and order.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, ship, table

ORDER = 4
DISCOUNT = 0.75
SAMPLE = 400  #: training documents per language at most, chosen by the hash of their ids
CALIBRATE = 5  #: one in so many of them is kept from the counts, for temperature and rejection
QUANTILE, SLACK = 0.995, 1.05  #: texts are rejected above this quantile of known texts' cross-entropies, times the slack
SLICE = 1_000_000
BITS = 18  #: leading hash bits that the look-up table of a sorted array is keyed by
MIX = np.uint64(0x9E3779B97F4A7C15)

_GAPS = re.compile(r"[\W\d_]+")


def normalize(text: str | None) -> str:
    """Lower case with one blank between runs of letters; empty where the text has no letter at all (signs such as a half or a Roman numeral are none)."""
    text = _GAPS.sub(" ", (text or "").lower()).strip()
    return text if any(map(str.isalpha, text)) else ""


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each after ORDER-1 blanks and before one, and how many places each takes."""
    pad = " " * (ORDER - 1)
    codes = np.frombuffer("".join(f"{pad}{t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.fromiter((len(t) + ORDER for t in texts), np.int64, len(texts))


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place (places before the n-th get 0)."""
    h = np.zeros(len(codes), np.uint64)
    if n:
        out = np.zeros(len(codes) - n + 1 if len(codes) >= n else 0, np.uint64)
        for i in range(n):
            out = (out ^ (codes[i : len(codes) - n + 1 + i] + np.uint64(1))) * MIX
            out ^= out >> np.uint64(29)
        h[n - 1 :] = out + np.uint64(n)
    return h


class KneserNey:
    """One language's model: per order sorted hashes with log probabilities, and with back-off weights of contexts."""

    def __init__(self, texts: list[str]) -> None:
        codes, sizes = _codes(texts)
        inside = np.concatenate([np.concatenate([np.zeros(ORDER - 1, bool), np.ones(s - ORDER + 1, bool)]) for s in sizes]) if len(sizes) else np.zeros(0, bool)
        ends = np.flatnonzero(inside)
        grams = {n: _hashes(codes, n) for n in range(ORDER + 1)}
        before = {n: np.concatenate([[np.uint64(0)], grams[n][:-1]]) if len(codes) else grams[n] for n in range(ORDER)}  # context of n characters
        self.hash, self.logp, self.ctx, self.back = {}, {}, {}, {}
        lower = None
        self.floor = 0.0
        for n in range(1, ORDER + 1):
            if n == ORDER:
                at, count = self._first(grams[n][ends])
            else:  # in how many different characters before it does an n-gram occur?
                wide, _ = self._first(grams[n + 1][ends])
                at, count = self._first(grams[n][ends[wide]], ends[wide])
                at = np.searchsorted(ends, at)
            place = ends[at]
            context, follow = before[n - 1][place], np.ones(len(place))
            ctx, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, weights=count, minlength=len(ctx))
            kinds = np.bincount(inverse, weights=follow, minlength=len(ctx))
            weight = DISCOUNT * kinds / np.maximum(total, 1)
            if n == 1:
                self.floor = float(1 / (kinds[0] + 1)) if len(ctx) else 1e-4  # uniform over the characters and one for all unseen ones
                base = np.full(len(place), self.floor)
            else:
                base = np.exp(self._find(self.hash[n - 1], lower, grams[n - 1][place]))
            p = np.maximum(count - DISCOUNT, 0) / total[inverse] + weight[inverse] * base if len(place) else np.zeros(0)
            order = np.argsort(grams[n][place])
            self.hash[n], self.logp[n] = grams[n][place][order], np.log(p)[order]
            self.ctx[n - 1], self.back[n - 1] = ctx, np.log(weight)
            lower = self.logp[n]

    @staticmethod
    def _first(h: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        values, at, count = np.unique(h, return_index=True, return_counts=True)
        return (at if places is None else places[at]), count.astype(float)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float = -np.inf) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], missing)


class Models:
    """All languages' models over one another."""

    def __init__(self, langs: list[str], models: list[KneserNey]) -> None:
        self.langs = langs
        self.floor = np.log([m.floor for m in models])
        self.keys, self.rows, self.ctx, self.back = {}, {}, {}, {}
        # contexts first: their back-off weights, zero where a language has not seen them
        for n in range(ORDER):
            self.ctx[n] = np.unique(np.concatenate([m.ctx[n] for m in models]))
            self.back[n] = np.stack([KneserNey._find(m.ctx[n], m.back[n], self.ctx[n], 0.0) for m in models], 1)
        self.known = [(m.hash, m.logp) for m in models]
        self.temperature, self.limit = 1.0, np.full(len(langs), np.inf)

    def lay(self, texts: list[str]) -> None:
        """Fills the rows of all n-grams: a language that lacks one gets its backed-off value.

        Shorter n-grams of a hash are not to be had from the hash, so the rows are made from the training texts again.
        """
        codes, sizes = _codes(texts)
        grams = {n: _hashes(codes, n) for n in range(ORDER + 1)}
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([h[n] for h, _ in self.known]))
            got, place = np.unique(grams[n], return_index=True)
            place = place[np.searchsorted(got, keys)]
            if n == 1:
                low = np.broadcast_to(self.floor, (len(keys), len(self.langs)))
                below = low
            else:
                below = self.rows[n - 1][np.searchsorted(self.keys[n - 1], grams[n - 1][place])]
            context = grams[n - 1][np.maximum(place - 1, 0)] if n > 1 else np.zeros(len(keys), np.uint64)
            below = below + self._back(n - 1, context)
            rows = np.stack([KneserNey._find(h[n], p[n], keys) for h, p in self.known], 1)
            self.keys[n], self.rows[n] = keys, np.where(np.isfinite(rows), rows, below)
        del self.known
        self.index = {n: np.searchsorted(self.keys[n], np.arange((1 << BITS) + 1, dtype=np.uint64) << np.uint64(64 - BITS)) for n in self.keys}
        self.index = {n: np.append(x[:-1], len(self.keys[n])) for n, x in self.index.items()}

    def _back(self, n: int, context: np.ndarray) -> np.ndarray:
        keys = self.ctx[n]
        at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
        return np.where((keys[at] == context)[:, None], self.back[n][at], 0.0)

    def _where(self, n: int, wanted: np.ndarray) -> np.ndarray:
        """Row numbers in the sorted array of order n, -1 where it lacks a hash; the leading bits give where to start."""
        keys, head = self.keys[n], (wanted >> np.uint64(64 - BITS)).astype(np.int64)
        at, end = self.index[n][head], self.index[n][head + 1]
        out = np.full(len(wanted), -1)
        rows = np.flatnonzero(at < end)
        at, end = at[rows], end[rows]
        while len(rows):
            same = keys[at] == wanted[rows]
            out[rows[same]] = at[same]
            at = at + 1
            go = ~same & (at < end)
            rows, at, end = rows[go], at[go], end[go]
        return out

    def _logp(self, grams: dict[int, np.ndarray], before: dict[int, np.ndarray], places: np.ndarray, n: int = ORDER) -> np.ndarray:
        if not n:
            return np.broadcast_to(self.floor, (len(places), len(self.langs)))
        at = self._where(n, grams[n][places])
        out = self.rows[n][at]
        lost = np.flatnonzero(at < 0)
        if len(lost):
            out[lost] = self._logp(grams, before, places[lost], n - 1) + self._back(n - 1, before[n - 1][places[lost]])
        return out

    def cross_entropy(self, texts: list[str]) -> np.ndarray:
        """Nats per character of each normalized text in each language; whole texts, in slices of bounded size."""
        codes, sizes = _codes(texts)
        ends = np.cumsum(sizes)
        sums = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(codes), SLICE):
            first = max(0, a - ORDER)
            part = codes[first : a + SLICE]
            grams = {n: _hashes(part, n) for n in range(ORDER + 1)}
            before = {n: np.concatenate([np.zeros(1, np.uint64), grams[n][:-1]]) for n in range(ORDER)}
            place = np.arange(a - first, len(part))
            owner = np.searchsorted(ends, place + first, "right")
            scored = place + first - (ends - sizes)[owner] >= ORDER - 1
            place, owner = place[scored], owner[scored]
            if not len(place):
                continue
            logp = self._logp(grams, before, place)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sums[owner[starts]] -= np.add.reduceat(logp, starts, axis=0)
        return sums / np.maximum(sizes - ORDER + 1, 1)[:, None]

    def probabilities(self, ce: np.ndarray) -> np.ndarray:
        z = -(ce - ce.min(axis=1, keepdims=True)) / self.temperature
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Temperature by least log loss, and each language's cross-entropy beyond which a text is rejected."""
        ce = self.cross_entropy(texts)
        right = np.array([self.langs.index(x) for x in langs], int)
        if len(right):
            losses = []
            for t in np.geomspace(0.005, 2, 40):
                self.temperature = float(t)
                losses.append((-np.log(np.maximum(self.probabilities(ce)[np.arange(len(right)), right], 1e-12)).mean(), float(t)))
            self.temperature = min(losses)[1]
        for i in range(len(self.langs)):
            own = ce[right == i, i] if len(right) else ce[:0, 0]
            self.limit[i] = np.quantile(own, QUANTILE) * SLACK if len(own) else np.inf


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Models | None:
    """Models from at most ``sample`` labelled documents per language, those with the smallest hashes of their ids.

    Rows with a null language, text or id, or a text without letters, teach nothing; None is returned if no row is left. Only the sample
    reaches the driver: languages x sample texts.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).dropna().filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 40)))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # about twice the sample passes the threshold of each language; the window then sees no more than that
    limit = F.lit(0)
    for name, n in counts.items():
        limit = F.when(F.col("lang") == name, F.lit(int(min(1.0, (2 * sample + 50) / n) * (1 << 40)))).otherwise(limit)
    first = Window.partitionBy("lang").orderBy("h", "id", "text")
    chosen = rows.filter(F.col("h") < limit).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= sample)
    taken = [(r.lang, normalize(r.text), r.r) for r in chosen.select("lang", "text", "r").toLocalIterator()]
    taken = [x for x in taken if x[1]]
    langs = sorted({x[0] for x in taken})
    if not langs:
        return None
    taught = [x for x in taken if x[2] % CALIBRATE] if all(any(y[0] == g and y[2] % CALIBRATE for y in taken) for g in langs) else taken
    texts = {g: [t for x, t, _ in taught if x == g] for g in langs}
    models = Models(langs, [KneserNey(texts[g]) for g in langs])
    models.lay([t for g in langs for t in texts[g]])
    asked = [x for x in taken if not x[2] % CALIBRATE]
    models.calibrate([t for _, t, _ in asked], [g for g, _, _ in asked])
    return models


def identify(docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (probability of that language, 0 to 1), cross_entropy and rejected.

    Null texts and texts without a letter get ``und``, score 0, and are rejected; so is everything when there are no models. Other
    texts always get a learned language; ``rejected`` marks those that are further from it than nearly all known
    texts of it are. Equal cross-entropies go to the first language in order. Columns with these names are replaced.
    """
    shared = ship(docs.sparkSession, models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(shared.value)
        for rows in batches:
            texts = [normalize(t) for t in rows[text]]
            some = np.array([bool(t) for t in texts], bool) & (m is not None)
            rows["lang_pred"], rows["score"], rows["cross_entropy"], rows["rejected"] = "und", 0.0, math.nan, True
            at = np.flatnonzero(some)
            if len(at):
                ce = m.cross_entropy([texts[i] for i in at])
                best = ce.argmin(axis=1)
                low = ce[np.arange(len(at)), best]
                whole = pd.Series(index=rows.index, dtype=object)
                for column, values in (("lang_pred", [m.langs[b] for b in best]), ("score", m.probabilities(ce)[np.arange(len(at)), best]), ("cross_entropy", low), ("rejected", low > m.limit[best])):
                    whole = rows[column].to_numpy(dtype=object)
                    whole[at] = values
                    rows[column] = whole
            rows["score"], rows["cross_entropy"], rows["rejected"] = rows["score"].astype(float), rows["cross_entropy"].astype(float), rows["rejected"].astype(bool)
            yield rows

    rest = docs.drop("lang_pred", "score", "cross_entropy", "rejected")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInPandas(run, f"{kinds}, lang_pred string, score double, cross_entropy double, rejected boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, the language of its whole text, its probability, and whether it is far from all known texts.

    Null texts and texts without a letter get und; repeats get a row each; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    models = train(docs.filter(~held_out()))
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), models)
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
