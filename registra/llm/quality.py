"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with a temperature.

Each word has a sparse random index vector: one drawn from the hash of its shape (upper, lower, digit and other characters in
their order, without run lengths) and one drawn from its own hash, which weighs n / (n + PRIOR) for a word that occurs n times in the
training texts. A word's vector is its context vector: the mean of the summed index vectors of the words within two words of it, drawn
towards the mean of all words of its shape as if that had been seen PRIOR times more. So a frequent word has a place of its own, a rare or new
one that of its shape, and no word is left out. Sums are kept by the hashes of words and shapes in tables of a fixed number of rows;
words that share a row share its sums. A document is the mean and the spread of its words' vectors, the share of words that repeat the word
before them, which no mean of vectors shows, and the logarithm of their number.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, ship, table

DIMS, NONZERO, REACH = 64, 6, 2
HIDDEN, EPOCHS, SEED = 32, 60, 7
SAMPLE = 2500  #: labelled documents of each class at most, those with the smallest hashes of their ids
CALIBRATE = 5  #: one in so many of them is kept from the fit, for the temperature
THRESHOLD = 0.7
PRIOR = 300  #: occurrences that the mean of a word's shape counts for
ROWS, FORMS = 1 << 16, 1 << 12  #: rows of the tables of words' and of shapes' sums
TEXT_BYTES = 1 << 20  #: labelled documents of more bytes are not learned from
SAMPLE_BYTES = 64 << 20  #: bytes of text that are learned from for each class at most
REMEMBER = 100_000  #: distinct words remembered in a task
SLICE = 100_000  #: words pooled at once, and words of one text that are split off at once

_SHAPE = {**{c: "x" for c in range(97, 123)}, **{c: "X" for c in range(65, 91)}, **{c: "0" for c in range(48, 58)}}
_RUN = re.compile(r"(.)\1+", re.S)
_WORD = re.compile(r"\S+")


def shape(word: str) -> str:
    """The kinds of characters of a word in order, a run of one kind as that kind and a plus sign."""
    if not word.isascii():
        word = "".join("x" if c.islower() else "X" if c.isupper() else c for c in word)
    return _RUN.sub(r"\1+", word.translate(_SHAPE))


def _hash(items: list[str], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w.encode("utf-8", "surrogatepass"), seed) for w in items), np.uint64, len(items))


def _draws(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an index vector is not zero, and its signs there: NONZERO of each, drawn from a hash (a place may be drawn twice)."""
    k = np.arange(NONZERO, dtype=np.uint64)
    bits = (h[:, None] ^ (h[:, None] >> np.uint64(29))) * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2) * k)
    return (bits >> np.uint64(40)).astype(np.int64) % DIMS, 1.0 - 2.0 * (bits >> np.uint64(63)).astype(float)


def index_vectors(h: np.ndarray) -> np.ndarray:
    """The sparse vector that is drawn from each hash."""
    at, sign = _draws(h)
    cells = np.arange(len(h))[:, None] * DIMS + at
    return np.bincount(cells.ravel(), sign.ravel(), len(h) * DIMS).reshape(len(h), DIMS)


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of their shapes, and the rows of both in the tables of sums."""
    h, forms = _hash(words, 0), _hash([shape(w) for w in words], 1)
    return h, forms, (h % np.uint64(ROWS)).astype(np.int64), (forms % np.uint64(FORMS)).astype(np.int64)


def _add(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds each value to its row of the table, rows repeated."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    table[rows[first]] += np.add.reduceat(values[order], first, axis=0)


class Words:
    """Counts and context sums of the training texts' words and shapes; words met in a task have their vectors in one matrix."""

    def __init__(self) -> None:
        self.n_word, self.n_form = np.zeros(ROWS), np.zeros(FORMS)
        self.of_word, self.of_form = np.zeros((ROWS, DIMS), np.float32), np.zeros((FORMS, DIMS), np.float32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((0, DIMS), np.float32)

    def index_of(self, words: list[str]) -> np.ndarray:
        h, forms, row, _ = _places(words)
        n = self.n_word[row]
        return index_vectors(forms) + (n / (n + PRIOR))[:, None] * index_vectors(h)

    def vectors_of(self, words: list[str]) -> np.ndarray:
        """Context vectors of length one; zeros for a new word of a new shape."""
        _, _, row, form = _places(words)
        sums = self.of_word[row] + PRIOR * self.of_form[form]
        return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        """Numbers of the words' rows in ``vectors``."""
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            self.vectors = np.concatenate([self.vectors, self.vectors_of(fresh)])
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def learn(self, texts: list[str]) -> None:
        """Random indexing: to each word's context the index vector of each neighbour is added once for each time they meet."""
        for part in (p for t in texts for p in _parts(t)):
            _, _, row, form = _places(part)
            self.n_word += np.bincount(row, minlength=ROWS)
            self.n_form += np.bincount(form, minlength=FORMS)
        of_word, of_form = np.zeros((ROWS, DIMS)), np.zeros((FORMS, DIMS))
        for t in texts:
            ws = t.split()
            for start in range(0, len(ws), SLICE):
                low = max(0, start - REACH)
                part = ws[low : start + SLICE + REACH]
                number = {w: i for i, w in enumerate(dict.fromkeys(part))}
                v = self.index_of(list(number))[[number[w] for w in part]]
                near = np.zeros_like(v)
                for d in range(1, REACH + 1):
                    near[d:] += v[:-d]
                    near[:-d] += v[d:]
                own = slice(start - low, start - low + SLICE)
                _, _, row, form = _places(part[own])
                _add(of_word, row, near[own])
                _add(of_form, form, near[own])
        self.of_word = of_word.astype(np.float32)
        self.of_form = (of_form / np.maximum(self.n_form, 1)[:, None]).astype(np.float32)
        self.forget()

    def pool(self, texts: list[str | None]) -> np.ndarray:
        """Mean and spread of the words' vectors, the share of words that repeat the one before, and the logarithm of the number of words.

        Zeros for a text without words. A text's words are added up in the same steps whatever texts stand beside it.
        """
        n, mean, second, again = np.zeros(len(texts)), np.zeros((len(texts), DIMS)), np.zeros((len(texts), DIMS)), np.zeros(len(texts))
        held: list[tuple[int, list[str]]] = []

        def flush() -> None:
            if len(self.known) > REMEMBER:
                self.forget()
            ids, at = self.ids([w for _, part in held for w in part]), 0
            for i, part in held:
                own = ids[at : at + len(part)]
                v = self.vectors[own]
                again[i] += np.count_nonzero(own[1:] == own[:-1])
                mean[i] += v.sum(axis=0)
                second[i] += np.einsum("ij,ij->j", v, v)
                at += len(part)
            held.clear()

        waiting = 0
        for i, t in enumerate(texts):
            for part in _parts(t or ""):
                n[i] += len(part)
                held.append((i, part))
                waiting += len(part)
                if waiting >= SLICE:
                    flush()
                    waiting = 0
        flush()
        some = np.maximum(n, 1)
        mean, second = mean / some[:, None], second / some[:, None]
        return np.concatenate([mean, np.sqrt(np.maximum(second - mean**2, 0)), (again / some)[:, None], np.log1p(n)[:, None] / 5], axis=1)


def _parts(text: str) -> Iterator[list[str]]:
    """A text's words, at most SLICE of them at once; a very long text is never split as a whole."""
    if len(text) < 2 * SLICE:
        if part := text.split():
            yield part
        return
    found = _WORD.finditer(text)
    while part := [m.group() for m in itertools.islice(found, SLICE)]:
        yield part


class Network:
    """Two layers fitted with Adam on weighted rows; a temperature fitted on other rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, 1), (1,)]
        self.p = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
        m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        self.temperature, step = 1.0, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                rows = order[at : at + 64]
                h = np.maximum(x[rows] @ self.p[0] + self.p[1], 0)
                d = ((1 / (1 + np.exp(-(h @ self.p[2] + self.p[3])))) - y[rows, None]) * w[rows, None] / len(rows)
                back = (d @ self.p[2].T) * (h > 0)
                grads = [x[rows].T @ back + 1e-4 * self.p[0], back.sum(axis=0), h.T @ d + 1e-4 * self.p[2], d.sum(axis=0)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0)
        return (h @ self.p[2] + self.p[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        losses = []
        for t in np.geomspace(0.3, 10, 60):
            self.temperature = float(t)
            s = np.clip(self.score(x), 1e-9, 1 - 1e-9)
            losses.append((float(-(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()), float(t)))
        self.temperature = min(losses)[1] if len(x) else 1.0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Words, Network] | float:
    """Fits on at most ``sample`` documents of each class of ``labels.quality``; rows weigh as much as the class has in all.

    Texts of more than ``TEXT_BYTES`` are not learned from, nor those beyond the first ``SAMPLE_BYTES`` of a class's sample.
    Labels of one doc_id that disagree count as the larger; null ids, labels and texts teach nothing. With less than ten
    rows or only one class the share of label 1 (1 without labels) is returned, and every text scores that.
    """
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("y")).dropna().filter("y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    marks = marks.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 40)))
    counts = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(max(counts, default=1))
    limit = F.lit(0)
    for y, n in counts.items():
        limit = F.when(F.col("y") == y, F.lit(int(min(1.0, (1.2 * sample + 50) / n) * (1 << 40)))).otherwise(limit)
    marks = marks.filter(F.col("h") < limit).withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id"))).filter(F.col("r") <= sample)
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= TEXT_BYTES).join(F.broadcast(marks), "doc_id")  # at most two classes' samples
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_BYTES)
    taken = sorted((r.h, r.doc_id, r.text, r.y) for r in rows.select("h", "doc_id", "text", "y").toLocalIterator())
    have = np.bincount([r[3] for r in taken], minlength=2)
    if len(taken) < 10 or not have.all():
        return counts.get(1, 0) / sum(counts.values())
    words = Words()
    fit = np.arange(len(taken)) % CALIBRATE > 0
    words.learn([r[2] for r, f in zip(taken, fit) if f])
    x, y = words.pool([r[2] for r in taken]), np.array([r[3] for r in taken], float)
    words.forget()
    w = np.where(y == 1, counts[1] / have[1], counts[0] / have[0])
    w = w / w.mean()
    net = Network(x[fit], y[fit], w[fit])
    net.calibrate(x[~fit], y[~fit], w[~fit])
    return words, net


def probability(spark: SparkSession, model: tuple[Words, Network] | float) -> Callable[[Column], Column]:
    """The score (0 to 1) as a function of a text column; null and empty texts are scored as texts without words.

    A text is scored alone and whole, however long it is: repeats, ties and other columns play no part.
    """
    shared = ship(spark, model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = pickle.loads(shared.value)
        for texts in batches:
            yield pd.Series(np.full(len(texts), m)) if isinstance(m, float) else pd.Series(m[1].score(m[0].pool(texts.tolist())).astype(float))

    return lambda text: run(text)


def score(docs: DataFrame, model: tuple[Words, Network] | float, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.7) to each row; null and empty texts are scored as texts without words.

    Columns with these two names are replaced, other columns stay as they are; an empty table stays empty.
    """
    out = docs.withColumn("score", probability(docs.sparkSession, model)(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, model: tuple[Words, Network] | float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least 0.7, with the columns they have; nulls and empty texts are judged by their score too."""
    return docs.filter(probability(docs.sparkSession, model)(F.col(text)) >= THRESHOLD)


def trained_on(spark: SparkSession, sf_dir: str) -> tuple[Words, Network] | float:
    """The model of the labelled documents that are not held out."""
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~held_out()))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score and predicted, by the model of the labelled rows that are not held out.

    Null and empty texts are scored as texts without words; repeated doc_ids give a row each; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    return score(docs, trained_on(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
