"""Spelling variants: words that differ by one letter, found by PartEnum signatures of their letter multisets.

A word's letters, each with a count of how often it came before, are the elements of a set, a binary vector. One inserted, deleted or
replaced code point changes at most two elements, so the vectors of near words have a Hamming distance of at most two. PartEnum deals the elements
to ``PARTS`` partitions by hash; two changes touch two partitions at most, so vectors of near words agree on all partitions but some two.
Each choice of two partitions to leave out gives a signature, the hash of the elements in the others, and near words share one.

Words with common letters share signatures by the thousand. Each signature is therefore dealt on by an unchanged half: one edit leaves the
first half or the last half of the shorter word as it was, so near words also share a signature with that half. No pair is lost
by either, equal keys are joined, and a pair counts once its distance is found to be exactly one code point.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

PARTS = 4
RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _part_hashes(word: str) -> list[Column]:
    """A hash of the word's elements in each partition."""
    letters = F.array_sort(F.filter(F.split(word, ""), lambda c: c != ""))
    elements = F.transform(letters, lambda c, i: F.xxhash64(c, i - F.array_position(letters, c)))
    xor = lambda p: F.aggregate(F.filter("elements", lambda h: F.pmod(h, F.lit(PARTS)) == p), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))
    return [elements, *map(xor, range(PARTS))]


def _halves(word: str, size: str) -> Column:
    """First and last halves that one edit may leave: of the word as the shorter one of a pair, and as the longer one."""
    half = lambda less: F.greatest(F.lit(0), F.floor((F.col(size) - less) / 2)).cast("int")
    first = lambda n: F.xxhash64(F.lit(0), n, F.left(F.col(word), n))
    last = lambda n: F.xxhash64(F.lit(1), n, F.right(F.col(word), n))
    return F.array_distinct(F.array(first(half(1)), last(half(1)), first(half(2)), last(half(2))))


def signatures(words: DataFrame) -> DataFrame:
    """(word, n) -> (key, word, n, size): a row for each signature and half."""
    elements, *parts = _part_hashes("word")
    rows = words.select("word", "n", F.length("word").alias("size")).withColumn("elements", elements)
    rows = rows.withColumns({f"p{i}": p for i, p in enumerate(parts)})
    kept = [[f"p{i}" for i in range(PARTS) if i not in out] for out in combinations(range(PARTS), 2)]
    whole = F.array(*[F.xxhash64(F.lit(k), *names) for k, names in enumerate(kept)])
    keys = F.flatten(F.transform(whole, lambda s: F.transform("halves", lambda h: F.xxhash64(s, h))))
    return rows.withColumn("halves", _halves("word", "size")).select(F.explode(keys).alias("key"), "word", "n", "size")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) -> (word, n, other, other_n): every pair of words at a distance of one code point, from both sides."""
    rows = signatures(words)
    other = rows.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("size").alias("other_size"))
    close = (F.abs(F.col("size") - F.col("other_size")) <= 1) & (F.levenshtein("word", "other", 1) == 1)
    pairs = rows.join(other, (rows["key"] == other["key"]) & (F.col("word") < F.col("other")) & close)
    pairs = pairs.select("word", "n", "other", "other_n").distinct()
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.union(back)


def _roots(forms: DataFrame, most: int, ratio: float) -> DataFrame:
    """(word, form) -> (word, root): each round follows twice as many forms; counts rise by ``ratio`` at each, which bounds the rounds."""
    roots = forms.select("word", F.col("form").alias("root"))
    steps = max(1, int(log2(max(most, 1)) / log2(ratio)) + 1)
    for _ in range(ceil(log2(steps))):
        roots = settle(roots)
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return roots


def group_spellings(words: DataFrame, ratio: float = 2) -> DataFrame:
    """(word, n) -> (word, form, root, n, n_near, form_n) of each word.

    ``form`` is the near word with the largest n (of equal ones the least in code-point order) if that is at least ``ratio`` (above 1) times the word's
    own n, else null; ``root`` is where forms lead, the word itself without one; ``n_near`` counts near words. Rows of one word are
    added up; null words and null counts are left out; the empty word is a word of no letters; columns beyond the two are not used.
    An empty table gives no rows. Very long words are compared whole.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or forms could lead in circles")
    words = settle(words.select("word", F.col("n").cast("long").alias("n")).dropna().groupBy("word").agg(F.sum("n").alias("n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best.form", (-F.col("best.less")).alias("form_n"))
    enough = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    found = settle(found.withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))}))
    forms = found.filter("form IS NOT NULL")
    roots = _roots(forms, words.agg(F.max("n")).first()[0] or 1, ratio)
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_words(docs: DataFrame, least_length: int = 5, least_n: int = 3, slip: int = 97) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, of enough code points, that occur often enough over all texts.

    Where ``slip`` divides h, the checksum of "doc_id:run", the run loses its code point h modulo its length (0: none does). Null texts
    have no runs, a null doc_id counts as an empty one; repeated rows count again.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    runs = runs.withColumn("run", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", CAPITALS, CAPITALS.lower())))
    if slip:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        slipped = F.concat(F.left(F.col("run"), at), F.substring("run", at + 2, F.length("run")))
        runs = runs.withColumn("run", F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")))
    counts = runs.filter(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least_n)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word of the documents: its form, root, n, n_near and form_n, over all texts."""
    return group_spellings(corpus_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP13_SQL = """
WITH RECURSIVE
     crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
             FROM range(256) r(i)),
     r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
     u AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY ALL),
     b AS (SELECT u.*, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM u),
     h AS (SELECT b.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda p: CAST('0x' || substr(x, p, 2) AS BIGINT))),
                                                   lambda a, y: xor(a >> 8, t[1 + xor(a & 255, y)]))) AS h FROM b, crc),
     w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
     v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
     d AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS less FROM v, unnest(range(1, length(word) + 1)) q(p)),
     e AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.p = b.p AND a.less = b.less AND a.word <> b.word
           UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.less UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.less),
     c AS (SELECT e.word, count(*) AS n_near, min({'m': -o.n, 'w': e.other}) AS best FROM e JOIN v o ON o.word = e.other GROUP BY e.word),
     f AS (SELECT v.word, v.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN -c.best.m >= 2 * v.n THEN c.best.w END AS form, CASE WHEN -c.best.m >= 2 * v.n THEN -c.best.m END AS form_n
           FROM v LEFT JOIN c ON c.word = v.word),
     chain AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT chain.word, f.form, k + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
     last AS (SELECT word, max_by(root, k) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, last.root, f.n, f.n_near, f.form_n FROM f JOIN last ON last.word = f.word
"""
