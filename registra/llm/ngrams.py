"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus, the document's own counts left out.

    S(w | h) = c(h w) / c(h)   if h w occurs in another document, else  a * S(w | h without its first word);
    S(w)     = c(w) / N,  or  a / N  where no other document has the word,

with all counts less those of the scored document, and beginnings of documents as words of their own in h.

Documents are dealt into parts of a few megabytes. Each part's distinct n-grams of all orders are exploded with their counts there and meet
in the count table, which is partitioned by the n-grams' hash and adds the counts of all parts up. What other parts have too goes back
as a count to the parts that asked; an n-gram for which nothing comes back is the part's own. There each word is scored, and scores are summed per document.

On the way n-grams travel as arrays, a row for each part and hash bucket, and counts come back by the places in those arrays, which a part
can lay out again; in the count table they are rows. A frequent n-gram has one row for each part at most, whatever the number
of documents that hold it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, settle, table

ORDER = 2
BACKOFF = 0.4
PART = 8 << 20  #: bytes of texts in a part
BUCKET = 4 << 20  #: bytes of texts for each bucket of the count table
LEAST_BUCKETS = 260  #: so many that an n-gram's hash within its bucket fits seven bytes
START = np.uint64(0x9E3779B97F4A7C15)  #: stands for the beginning of a document


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from the hashes of what comes before its last word and of that word."""
    x = (before * np.uint64(0xBF58476D1CE4E5B9)) ^ (word + np.uint64(0x94D049BB133111EB))
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ x >> np.uint64(32)


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words of each text, hashes of the n-grams that end at each word for n = 1, 2, ... order); words of all texts one after the other."""
    lists = [tokens(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    vocabulary: dict[str, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for ws in lists for w in ws), np.int64, int(sizes.sum()))
    digest = xxhash.xxh64_intdigest
    word = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in vocabulary), np.uint64, len(vocabulary))[ids]
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out, blank = [word], START
    for _ in range(order - 1):
        before = np.concatenate([out[-1][:1], out[-1][:-1]])
        before[first] = blank
        out.append(_mixed(before, word))
        with np.errstate(over="ignore"):
            blank = blank * START  # the same number of beginnings for each order
    return sizes, out


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, n_backed_off): one row for each row of ``docs``, under n-grams of up to ``order`` words.

    Words are what stands between white space, in lower case; n_backed_off counts those whose longest n-gram no other document has. Null
    and empty texts have no words and null scores. Rows that are equal in doc_id and text are two documents with one result. A corpus of
    one document backs off everywhere. A very long text is worked on whole, by one task. Empty tables stay empty; other columns play no part.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    every = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets = max(partitions(spark), math.ceil(every / PART)), max(partitions(spark), LEAST_BUCKETS, math.ceil(every / BUCKET))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")).repartition(parts, "part")

    def laid_out(hashes: list[np.ndarray]) -> tuple[list, np.ndarray, np.ndarray]:
        """Distinct n-grams of each order (hashes, places of all n-grams among them, counts), buckets of all of them, and their order by bucket."""
        kinds = [np.unique(h, return_inverse=True, return_counts=True) for h in hashes]
        bucket = ((np.concatenate([k[0] for k in kinds]) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        return kinds, bucket, np.argsort(bucket, kind="stable")

    def explode(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """A part's distinct n-grams with their counts in it, for each bucket of the count table."""
        kinds, bucket, by = laid_out(grams(group.text.tolist(), order)[1])
        h, c = (np.concatenate([k[i] for k in kinds]) for i in (0, 2))
        cuts = np.flatnonzero(np.diff(bucket[by])) + 1
        # buckets are ranges of hashes: less its bucket's beginning a hash takes 56 bits, which travel as 32, 16 and 8
        h = h - (((bucket << 24) + buckets - 1) // buckets << 40).view(np.uint64)
        low, middle, high = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), (h >> np.uint64(32)).astype(np.uint16).view(np.int16), (h >> np.uint64(48)).astype(np.uint8).view(np.int8)
        out = [(int(bucket[at[0]]), int(key[0]), low[at], middle[at], high[at], c[at].astype(np.int32)) for at in np.split(by, cuts) if len(at)]
        return pd.DataFrame(out, columns=["bucket", "part", "low", "middle", "high", "c"])

    asked = dealt.groupBy("part").applyInPandas(explode, "bucket int, part int, low array<int>, middle array<smallint>, high array<tinyint>, c array<int>").repartition(buckets, "bucket")
    asked = asked.select("bucket", "part", F.posexplode(F.arrays_zip("low", "middle", "high", "c")).alias("pos", "g"))
    bits = lambda c, mask, by: F.shiftleft(F.col(c).cast("long").bitwiseAND(F.lit(mask)), by)
    asked = asked.select("bucket", "part", "pos", bits("g.low", 0xFFFFFFFF, 0).bitwiseOR(bits("g.middle", 0xFFFF, 32)).bitwiseOR(bits("g.high", 0xFF, 48)).alias("h"), "g.c")
    counted = asked.withColumn("n", F.sum("c").over(Window.partitionBy("bucket", "h"))).filter("n > c")
    few = F.col("n") < 1 << 15  # nearly all counts fit two bytes; the others go beside them
    kinds_of = {"few": (few, "smallint"), "many": (~few, "bigint")}
    lists = [F.collect_list(F.when(test, F.col(c).cast(kind if c == "n" else "int"))).alias(f"{c}_{name}") for name, (test, kind) in kinds_of.items() for c in ("pos", "n")]
    known = counted.groupBy("bucket", "part").agg(*lists)

    def look_up(at: np.ndarray, doc: np.ndarray, total: np.ndarray) -> np.ndarray:
        """For each n-gram (by place among the distinct ones) how often the other documents have it."""
        _, pair, own = np.unique(doc * len(total) + at, return_inverse=True, return_counts=True)
        return total[at] - own[pair]

    def sums(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Each document's sum of logarithms without the numbers of all words and documents, and how often those are still to be divided by."""
        sizes, hashes = grams(left.text.tolist(), order)
        kinds, bucket, by = laid_out(hashes)
        total = np.concatenate([k[2] for k in kinds])
        if len(right):
            begin = np.searchsorted(bucket[by], right.bucket.to_numpy())
            for name in ("few", "many"):
                place = np.concatenate([b + np.asarray(p, np.int64) for b, p in zip(begin, right[f"pos_{name}"])])
                total[by[place]] = np.concatenate([np.asarray(n, np.int64) for n in right[f"n_{name}"]])
        totals = np.split(total, np.cumsum([len(k[0]) for k in kinds])[:-1])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        count = [look_up(k[1], doc, t) for k, t in zip(kinds, totals)]
        value, todo, opening = np.zeros(len(doc)), np.ones(len(doc), bool), np.zeros(len(doc), bool)
        opening[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        by_documents = np.zeros(len(doc), bool)
        for k in range(order, 1, -1):
            hit = np.flatnonzero(todo & (count[k - 1] > 0))
            context = np.where(opening[hit], 1, count[k - 2][hit - 1])
            value[hit] = (order - k) * math.log(BACKOFF) + np.log(count[k - 1][hit]) - np.log(np.maximum(context, 1))
            by_documents[hit] = opening[hit]
            todo[hit] = False
        value[todo] = (order - 1) * math.log(BACKOFF) + np.log(np.maximum(count[0][todo], BACKOFF))
        add = lambda x: np.bincount(doc, x, len(sizes))
        return pd.DataFrame({"doc_id": left.doc_id, "n": sizes, "s": add(value), "by_words": add(todo), "by_documents": add(by_documents), "missed": add(count[-1] == 0)})

    each = settle(dealt.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(sums, "doc_id string, n long, s double, by_words double, by_documents double, missed double"))
    words, texts = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    others = lambda whole, own: F.log(F.greatest(F.lit(float(whole)) - own, F.lit(1.0)))
    log_score = F.when(F.col("n") > 0, F.col("s") - F.col("by_words") * others(words, F.col("n")) - F.col("by_documents") * others(texts, F.lit(1)))
    return each.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_words"), log_score.alias("log_score"), (log_score / F.col("n")).alias("mean_log_score"), F.col("missed").cast("long").alias("n_backed_off"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, its score under the bigrams of all other documents, and how many words backed off; odd rows as in ``score``."""
    return score(table(spark, sf_dir, "documents"))
