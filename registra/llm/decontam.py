"""Benchmark decontamination, in DataFrame functions only.

A document is contaminated when one of its item-sized windows is similar to a benchmark item: the weighted Jaccard similarity
of their word shingles (weight: how often a shingle occurs) is at least 0.8. Windows have the item's number of words and
start at every word; a document shorter than the item is one window.

Documents and items meet by shared shingles. A window of that similarity shares eight ninths of its shingles with the item or
more, so the places of shared shingles, counted along the document, tell which windows can be similar; each of those is compared
exactly. No window and no order of shingles is left out: the result is that of brute force over all windows.

This stands in for SimHash fingerprints in Hamming blocks, which cannot give that result: two windows of similarity 0.8 differ in
more bits than any radius that blocks can serve, often enough to lose links (a test shows it for 17 bits, README has the figures).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

WORDS, SIMILAR = 5, 0.8
BROADCAST_BYTES = 48 << 20  #: size of the item table, as rows in memory, up to which it is sent to every executor
ROW = 120  #: bytes of one of its rows beside the item's id


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(ws: Column, k: int) -> Column:
    """Hashes of the runs of k words, in order, repeats included."""
    at = F.when(F.size(ws) >= k, F.sequence(F.lit(0), F.size(ws) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))


def _sized(df: DataFrame) -> tuple[DataFrame, bool]:
    """A written table, and whether its bytes are few enough to be broadcast; a larger one takes a shuffled join."""
    df = settle(df)
    size = df.agg(F.sum(F.lit(ROW) + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)))).first()[0] or 0
    return df, size <= BROADCAST_BYTES


def _maybe(sized: tuple[DataFrame, bool]) -> DataFrame:
    return F.broadcast(sized[0]) if sized[1] else sized[0]


def prepare_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, w, k, sh): shingles of k = min(5, words) words; items without a word are left out."""
    ws = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    k = F.least(F.size("ws"), F.lit(WORDS))
    cases = F.when(k == WORDS, shingles(F.col("ws"), WORDS))
    for n in range(1, WORDS):
        cases = cases.when(k == n, shingles(F.col("ws"), n))
    return settle(ws.select("item_id", F.size("ws").alias("w"), k.alias("k"), cases.alias("sh")).distinct())


def contaminated_windows(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, item_id, start, n_words, similarity): each window and item that are similar; ``th`` is the text's hash.

    Null and empty texts have no window; a document shorter than an item is one window itself. A very long text has as many windows as any
    other of its words; only stretches that share enough shingles with one item are looked at. Repeated rows and null ids
    are treated like any other row; repeated items count once. Without items or documents the result is empty.
    """
    items = prepare_items(items)
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # at most five numbers
    # item_key tells items of one item_id apart, c is how often the item has the shingle
    spots = items.select("item_id", F.xxhash64("sh").alias("item_key"), "k", "w", F.explode("sh").alias("h"))
    spots = _sized(spots.groupBy("item_id", "item_key", "k", "w", "h").agg(F.count("*").cast("int").alias("c")))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), words(F.col(text)).alias("ws"))
    hits = None
    for k in sizes or [WORDS]:
        shown = base.select("doc_id", "th", F.size("ws").alias("n"), F.posexplode(shingles(F.col("ws"), k)).alias("pos", "h"))
        hit = shown.join(_maybe((spots[0].filter(F.col("k") == k), spots[1])), "h")
        hits = hit if hits is None else hits.union(hit)
    pair = ["doc_id", "th", "n", "item_id", "item_key", "k", "w"]
    # a place adds to what a window shares unless the window already has c earlier places of the same shingle: back is the c-th before it
    places = hits.repartition("doc_id", "th").groupBy(*pair, "h", "c").agg(F.sort_array(F.collect_set("pos")).alias("ps"))
    back = lambda x, i: F.struct(x.alias("pos"), F.when(i >= F.col("c"), F.get("ps", i - F.col("c"))).otherwise(-1).alias("back"))
    places = places.select(*pair, F.transform("ps", back).alias("at"))
    m, held = F.col("w") - F.col("k") + 1, F.least("w", "n") - F.col("k") + 1
    need = F.greatest(F.lit(1), F.ceil(SIMILAR / (1 + SIMILAR) * (m + held) - 1e-6)).cast("int")
    met = places.groupBy(*pair).agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))
    met = settle(met.select(*pair, m.alias("m"), held.alias("held"), need.alias("need"), "at").filter(F.size("at") >= F.col("need")))
    # windows whose first shared place is the i-th and that reach as far as the need-th place from it
    place = lambda i: F.get("at", i)["pos"]
    last = F.greatest(F.lit(0), F.col("n") - F.col("w"))

    def starts(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.when(i > 0, place(i - 1) + 1).otherwise(0), place(i + F.col("need") - 1) - F.col("held") + 1)
        high = F.least(place(i), last)
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda s: F.struct(s.alias("start"), i.alias("i")))).otherwise(F.array().cast("array<struct<start:int,i:int>>"))

    def shared(x: Column) -> Column:
        return F.size(F.filter(F.slice("at", x["i"] + 1, F.col("held")), lambda p: (p["pos"] < x["start"] + F.col("held")) & (p["back"] < x["start"])))

    laid = F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), starts))
    compared = F.transform(laid, lambda x: F.struct(x["start"].alias("start"), shared(x).alias("shared")))
    found = met.select("doc_id", "th", "item_id", "m", "held", F.least("w", "n").alias("n_words"), F.explode(compared).alias("x"))
    similarity = F.col("x.shared") / (F.col("m") + F.col("held") - F.col("x.shared"))
    found = found.select("doc_id", "th", "item_id", "x.start", "n_words", similarity.alias("similarity"))
    return found.filter(F.col("similarity") >= SIMILAR).distinct()


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, contaminated, n_items, and the most similar item with its window.

    Ties go to the smallest item_id, then the first window. Null and empty texts are clean; other columns play no part.
    """
    found = settle(contaminated_windows(docs, items, doc_id, text))
    best = found.groupBy("doc_id", "th").agg(F.count_distinct("item_id").alias("n_items"), F.min(F.struct(-F.col("similarity"), "item_id", "start", "n_words")).alias("best"))
    best = best.select(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th"), "n_items", "best")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"))
    rows = rows.join(best, rows.doc_id.eqNullSafe(best.b_id) & (rows.th == best.b_th), "left")
    return rows.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.col("best.item_id").alias("item_id"),
        F.col("best.start").cast("long").alias("start_word"),
        F.col("best.n_words").cast("long").alias("n_words"),
        F.round(-F.col("best.col1"), 9).alias("similarity"),
        "th",
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: is a window of it similar to a benchmark item, to how many, and to which most; odd rows as in ``contamination``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window similar to an item, with the columns it has.

    Rows are told apart by doc_id and text together; null and empty texts stay, repeated rows go or stay together, an empty table stays empty.
    """
    gone = contamination(docs, items).filter("contaminated").select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.g_id) & (F.xxhash64(docs.text) == gone.g_th), "left_anti")
