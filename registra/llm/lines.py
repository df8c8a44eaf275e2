"""Line de-duplication by winnowing over line hashes, in DataFrame functions only.

Every window of ``window`` lines selects its least line hash (the last one among equals): the selected lines are the text's
fingerprints, about 2 in ``window + 1`` of its lines. Two texts that share ``window`` lines in a row select the same line of them, so
a fingerprint that stands at one place only belongs to no repeated run: it is dropped, with every window that selected it.

Positions are joined by what is left, in two steps. A selected line first meets the first place of the same line with the same
lines about it, as far as the windows reach that selected it: one row a line, however many windows those are. Only the first
places themselves, one for each neighbourhood, are looked up window by window. A frequent line therefore makes no pairs, and
copies of a text are settled before any window is listed. From where two places meet the match is extended both ways, line
hash by line hash, to the first difference, and the later run is deleted. An extension ends ``window - 1`` lines from its
fingerprint: a longer run selects further lines, which carry it on.

``window`` is the least number of lines in a run. The guarantee holds for any window from 1: a run of that length is itself a
window, and what it selects depends on its own lines alone. With two lines, two thirds of all lines are selected.

A run also qualifies by its length in words or characters: a line of at least ``LONG_WORDS`` words or ``LONG_CHARS`` characters
(for languages without blanks) is a window of its own, whatever stands beside it, also where it is the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

WINDOW = 2
LONG_WORDS, LONG_CHARS = 50, 300
NOWHERE = "array<int>"


def _line_hashes(lines: Column) -> Column:
    """Two independent 64-bit hashes of each line; together they stand for the line."""
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b")))


def _is_long(line: Column) -> Column:
    enough = (F.length(line) >= 2 * LONG_WORDS - 1) & (F.regexp_count(line, F.lit(r"[^ \t\r]+")) >= LONG_WORDS)
    return (F.length(line) >= LONG_CHARS) | enough


def _leading(same: Column) -> Column:
    """How many true elements an array begins with."""
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")


def winnow(docs: DataFrame, window: int = WINDOW, long_lines: bool = True) -> DataFrame:
    """(doc_id, th, p, fp, lo, around, wins): one row for each selected line.

    ``p`` is its number, ``fp`` its hash, ``around`` the hashes from line ``lo`` on that a window with it can reach, ``wins`` the windows
    (first line ``s``, ``m`` lines) that selected it. ``th``, the text's hash, tells rows of one doc_id apart.
    """
    lines, none = F.split("text", "\n", -1), F.array().cast(NOWHERE)
    long_at = F.filter(F.transform(lines, lambda x, i: F.when(_is_long(x), i)), lambda i: i.isNotNull()) if long_lines else none
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), _line_hashes(lines).alias("h"), long_at.alias("long_at"))
    rows = rows.filter((F.size("h") >= window) | (F.size("long_at") > 0)).withColumn("n", F.size("h"))
    starts = F.when(F.col("n") >= window, F.sequence(F.lit(0), F.col("n") - window)).otherwise(none)

    def last_least(s: Column) -> Column:
        part = F.slice("h", s + 1, window)
        return (s + window - F.array_position(F.reverse(part), F.array_min(part))).cast("int")

    rows = rows.withColumn("of", F.transform(starts, last_least))  # the line that each window selects: never falls along the text
    changes = F.filter("of", lambda p, i: (i == 0) | (p != F.get("of", i - 1)))
    rows = rows.select("doc_id", "th", "h", "n", "of", "long_at", F.explode(F.array_union(changes, "long_at")).alias("p"))
    tried = F.when(F.size("of") > 0, F.sequence(F.greatest(F.lit(0), F.col("p") - window + 1), F.least("p", F.size("of") - 1))).otherwise(none)
    tried = F.when(F.col("p") - window + 1 <= F.size("of") - 1, tried).otherwise(none)
    won = F.transform(F.filter(tried, lambda s: F.get("of", s) == F.col("p")), lambda s: F.struct(s.alias("s"), F.lit(window).alias("m")))
    own = F.when(F.array_contains("long_at", F.col("p")), F.array(F.struct(F.col("p").alias("s"), F.lit(1).alias("m")))).otherwise(F.array().cast("array<struct<s:int,m:int>>"))
    lo = F.greatest(F.lit(0), F.col("p") - window + 1)
    around = F.slice("h", lo + 1, F.col("p") + window - lo)
    return rows.select("doc_id", "th", "p", F.get("h", F.col("p")).alias("fp"), lo.alias("lo"), around.alias("around"), F.concat(won, own).alias("wins"))


def recurring(docs: DataFrame, window: int = WINDOW, long_lines: bool = True) -> DataFrame:
    """The rows of ``winnow`` whose fingerprint stands at more than one place."""
    chosen = winnow(docs, window, long_lines).withColumns({"a": F.col("fp.a"), "b": F.col("fp.b")}).drop("fp")
    often = chosen.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return chosen.join(settle(often), ["a", "b"], "left_semi")


def _sides(first: Column, last: Column) -> dict[str, Column]:
    """Hashes of the lines from ``first`` up to the fingerprint and from there to ``last``, and how many stand on either side."""
    at = F.col("p") - F.col("lo")
    left, right = F.slice("around", first - F.col("lo") + 1, F.col("p") - first), F.slice("around", at + 2, last - F.col("p"))
    return {"l": F.xxhash64(left), "r": F.xxhash64(right), "nl": F.col("p") - first, "nr": last - F.col("p")}


def _extended(window: int, own: Column) -> list[Column]:
    """(s, m) of the run about the fingerprint that is the same as about its place ``first``.

    What a long line extends to must itself be a run of ``window`` lines that overlaps nothing, else the long line goes alone.
    """
    reach = lambda row: F.transform(F.col(row + "around"), lambda x: x["a"])
    at = lambda row: F.col(row + "p") - F.col(row + "lo")
    before = lambda row: F.reverse(F.slice(reach(row), 1, at(row)))
    after = lambda row: F.slice(reach(row), at(row) + 2, F.greatest(F.size(row + "around") - at(row) - 1, F.lit(0)))
    # where one text ends, zip_with gives null
    back, on = (_leading(F.zip_with(side(""), side("first."), lambda x, y: F.coalesce(x == y, F.lit(False)))) for side in (before, after))
    run = (back + on + 1 >= window) & (~own | (F.col("p") >= F.col("first.p") + window))
    back, on = F.when(run, back).otherwise(F.col("nl")), F.when(run, on).otherwise(F.col("nr"))
    return [(F.col("p") - back).alias("s"), (back + on + 1).alias("m")]


def repeated_runs(docs: DataFrame, window: int = WINDOW, long_lines: bool = True) -> DataFrame:
    """(doc_id, th, s, m): first line and number of lines of runs that occur earlier.

    Earlier means a smaller (doc_id, th, line number); within a document the runs that meet must not overlap. The places of a
    neighbourhood, then those of a window, are aggregated to the first one before anything is joined.
    """
    row = ["doc_id", "th", "p", "lo", "around", "wins"]
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    rows = settle(recurring(docs, window, long_lines))
    span = _sides(F.array_min(F.transform("wins", lambda w: w["s"])), F.array_max(F.transform("wins", lambda w: w["s"] + w["m"] - 1)))
    spans, key = rows.withColumns(span), ["a", "b", *span]
    heads = settle(spans.groupBy(*key).agg(F.min(F.struct(*row)).alias("first"), F.count("*").alias("n")))
    # a later row of a neighbourhood goes as far as its windows reach; where it overlaps the first one, its windows are asked one by one
    clear = ~own | (F.col("p") > F.col("first.p") + F.col("nl") + F.col("nr"))
    later = spans.join(heads.filter("n > 1").drop("n"), key).filter(~own | (F.col("p") != F.col("first.p")))
    later = settle(later.select("doc_id", "th", *_extended(window, own), F.when(~clear, F.struct("a", "b", *row)).alias("asked")))
    asked = heads.select("a", "b", "first.*").unionByName(later.filter("asked IS NOT NULL").select("asked.*"))

    places = asked.withColumn("w", F.explode("wins"))
    last = F.col("w.s") + F.col("w.m") - 1
    places = places.withColumns({"s": F.col("w.s"), "m": F.col("w.m")} | _sides(F.col("w.s"), last)).drop("w", "wins")
    firsts = places.groupBy(*key).agg(F.min(F.struct("doc_id", "th", "s", "p", "lo", "around")).alias("first"), F.count("*").alias("n"))
    met = places.join(settle(firsts.filter("n > 1").drop("n")), key)
    met = met.filter(~own | (F.col("s") >= F.col("first.s") + F.col("m")))
    return later.filter("asked IS NULL").drop("asked").unionByName(met.select("doc_id", "th", *_extended(window, own)))


def _cut(docs: DataFrame, window: int, doc_id: str, text: str, long_lines: bool) -> DataFrame:
    """(row, new, n_lines, n_removed): each row of ``docs`` as a struct, so that its own columns clash with nothing."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    found = repeated_runs(rows.select("doc_id", "text"), window, long_lines)
    gone = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "m")).alias("at")).withColumnsRenamed({"doc_id": "g_id", "th": "g_th"})
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th")), "left")
    rows = rows.withColumn("lines", F.split("text", "\n", -1))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["s"], x["s"] + x["m"] - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    rows = rows.withColumn("kept", F.when(F.col("at").isNotNull(), F.transform(kept, lambda i: F.get("lines", i))))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_removed = F.when(F.col("kept").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long")
    new = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return rows.select("row", new.alias("new"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def drop_repeated_lines(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", long_lines: bool = True) -> DataFrame:
    """``docs`` with repeated lines deleted from ``text``, plus n_lines and n_removed.

    A line goes when it belongs to a run of at least ``window`` consecutive lines that occurs earlier in the corpus: in a
    row with a smaller doc_id or further up in the same text. With ``long_lines`` a line that is long goes as well when it alone does.
    Lines end at line feeds and are compared exactly. A null text stays null with no lines; an empty one has one empty line.
    Very long texts are one row like any other; work on a row grows with its lines. Rows that are equal in doc_id and text are
    the same document and keep the same lines; a null doc_id comes before all others. Other columns stay as they are, but
    columns named n_lines and n_removed are replaced (``texts_without_repeats`` keeps them); empty tables stay empty.
    """
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    return _cut(docs, window, doc_id, text, long_lines).select(*others, F.col("new").alias(text), "n_lines", "n_removed")


def texts_without_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", size: str | None = None) -> DataFrame:
    """``docs`` with the columns it has: ``text`` as ``drop_repeated_lines`` leaves it, and ``size``, if given, its new number of characters."""
    cut = _cut(docs, window, doc_id, text, True)
    changed = {text: F.col("new")} | ({size: F.when(F.col("n_removed") > 0, F.length("new")).otherwise(F.col("row").getField(size)).cast("long")} if size else {})
    return cut.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many were deleted, and the SHA-256 of the text that stays; by runs of two lines, as OP7_SQL has it."""
    return _digest(drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), long_lines=False))


def op7_long_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with single long lines as runs of their own: the whole rule, as the pipeline applies it."""
    return _digest(drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP7_SQL = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM t),
     w AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l),
     f AS (SELECT doc_id, i, min({'d': doc_id, 'i': i}) OVER (PARTITION BY line, nxt) AS first FROM w WHERE nxt IS NOT NULL),
     r AS (SELECT doc_id, i FROM f WHERE first.d <> doc_id OR i >= first.i + 2),
     gone AS (SELECT doc_id, i FROM r UNION SELECT doc_id, i + 1 FROM r),
     kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
                     coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS text
              FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

OP7_LONG_SQL = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM t),
     w AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l),
     f AS (SELECT doc_id, i, min({'d': doc_id, 'i': i}) OVER (PARTITION BY line, nxt) AS first FROM w WHERE nxt IS NOT NULL),
     r AS (SELECT doc_id, i FROM f WHERE first.d <> doc_id OR i >= first.i + 2),
     s AS (SELECT doc_id, i, min({'d': doc_id, 'i': i}) OVER (PARTITION BY line) AS first FROM l
           WHERE length(line) >= 300 OR len(regexp_extract_all(line, '[^ \t\r]+')) >= 50),
     gone AS (SELECT doc_id, i FROM r UNION SELECT doc_id, i + 1 FROM r UNION SELECT doc_id, i FROM s WHERE first.d <> doc_id OR i > first.i),
     kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
                     coalesce(string_agg(CASE WHEN g.i IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS text
              FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
