"""JSON array files of any size, read by many tasks.

Spark's text reader cuts a file into splits and, with "}" as the end of a line, each split into fragments. Whether a fragment begins inside
a string, and how deep, depends on all text before it; but what a stretch of text does to both composes: for each of the two ways in which it may
begin (outside or inside a string) it ends in one of them and changes the depth by a number. So

1. each task reads its split once and returns that summary, two numbers for each way;
2. the summaries of a file, one row for each split, are folded in order and give every split its beginning;
3. each task reads its split again and cuts it at the commas of depth one; what lies before its first cut and after its last one
   is put together with its neighbours'.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TOKENS = re.compile(r'\\.|["{}\[\],]', re.DOTALL)  # an escaped character is one token, whatever it is
_DEPTH = {"{": 1, "[": 1, "}": -1, "]": -1}


def effect(text: str, inside: bool = False) -> tuple[bool, int, int]:
    """(ends where it began, depth gained beginning this way, depth gained beginning the other way)."""
    if "\\" not in text:  # every quote opens or closes a string: outside and inside take turns
        pieces = text.split('"')
        gains = [sum(_DEPTH[c] * p.count(c) for c in _DEPTH) for p in ("".join(pieces[inside::2]), "".join(pieces[1 - inside :: 2]))]
        return len(pieces) % 2 == 1, *gains
    same, one, other = True, 0, 0
    for t in _TOKENS.findall(text):
        if t == '"':
            same = not same
        elif t in _DEPTH:
            if same != inside:
                one += _DEPTH[t]
            else:
                other += _DEPTH[t]
    return same, one, other


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, start): fragments in the order of each split; each has lost the "}" that ended it."""
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _by_split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[str], dict]]:
    """Runs of rows of one split; a split may come in several runs."""
    for rows in batches:
        change = (rows.path != rows.path.shift()) | (rows.start != rows.start.shift())
        for _, run in rows.groupby(change.cumsum(), sort=False):
            first = run.iloc[0]
            yield (first.path, int(first.start)), run.value.tolist(), first


def _summaries(fragments: DataFrame) -> DataFrame:
    """(path, start, same, outside, inside): what each split does to text that begins outside or inside a string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, same, gains = None, True, [0, 0]
        done: list[tuple] = []
        for at, values, _ in _by_split(batches):
            if at != now:
                if now:
                    done.append((*now, same, *gains))
                now, same, gains = at, True, [0, 0]
            for v in values:
                kept, one, other = effect(v + "}")
                gains[0] += one if same else other
                gains[1] += other if same else one
                same = same == kept
        if now:
            done.append((*now, same, *gains))
        yield pd.DataFrame(done, columns=["path", "start", "same", "outside", "inside"])

    return fragments.mapInPandas(run, "path string, start long, same boolean, outside long, inside long")


def _begin(splits: pd.DataFrame) -> pd.DataFrame:
    """Folds the splits of one file in order."""
    splits = splits.sort_values("start")
    inside, depth, begins = False, 0, []
    for s in splits.itertuples():
        begins.append((s.path, s.start, inside, depth))
        depth += s.inside if inside else s.outside
        inside = inside == s.same
    # the last fragment has no "}", or it is the end of a file that is no array: the one too many shows as -1
    if inside or depth != -1:
        raise ValueError(f"{splits.path.iloc[0]} is not one whole JSON array")
    return pd.DataFrame(begins, columns=["path", "start", "in_string", "depth"])


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fragments with their split's beginning -> (value, path, start, pos, head, tail).

    Items between two commas of the split have their place as ``pos``. The text before the first cut is a head, that after the last one a tail;
    without any cut it is neither, but a part of both.
    """
    now, inside, depth, pos, text, cut = None, False, 0, 0, [], False
    out: list[tuple] = []

    def close(head: bool, tail: bool) -> None:
        nonlocal text, pos, cut
        out.append(("".join(text), *now, pos, head, tail))
        text, pos = [], pos + 1

    for at, values, first in _by_split(batches):
        if at != now:
            if now:
                close(not cut, True)
            now, inside, depth, pos, cut = at, bool(first.in_string), int(first.depth), 0, False
        for v in values:
            v, begin = v + "}", 0
            # a record's fragment: once depth two is reached, nothing but its last "}" leads back, so only what comes before its first string is gone through
            pieces = v.split('"') if depth > 0 and not inside and "\\" not in v else [v]
            rest = "".join(pieces[2::2])
            first_piece = pieces[0]
            short = len(pieces) > 2 and depth + sum(_DEPTH[c] * first_piece.count(c) for c in _DEPTH) > 1 and "]" not in rest
            for t in _TOKENS.finditer(first_piece if short else v):
                c = t.group()
                if c == '"':
                    inside = not inside
                elif not inside and (c in _DEPTH or c == ","):
                    if depth == 1 and c in ",]" or depth == 0 and c == "[":
                        text.append(v[begin : t.start()])
                        close(not cut, False)
                        begin, cut = t.end(), True
                    depth += _DEPTH.get(c, 0)
            if short:
                depth += sum(_DEPTH[c] * rest.count(c) for c in _DEPTH)
                inside = len(pieces) % 2 == 0
            text.append(v[begin:])
        if len(out) >= 5000:
            yield pd.DataFrame(out, columns=_ITEM)
            out = []
    if now:
        close(not cut, True)
    yield pd.DataFrame(out, columns=_ITEM)


_ITEM = ["value", "path", "start", "pos", "head", "tail"]


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, start, pos): the items of JSON array files as texts, in the order of (path, start, pos).

    Items may be anything; brackets, commas and quotes in strings do not count. A file that does not hold one array fails. Each file is read twice, side by
    side by splits. What is broadcast has a row of about a hundred bytes for each split: 1 MB for each TB of arrays at the default split size.
    """
    fragments = _fragments(spark, path)
    begins = _summaries(fragments).groupBy("path").applyInPandas(_begin, "path string, start long, in_string boolean, depth long")
    cut = fragments.join(F.broadcast(begins), ["path", "start"]).select("value", "path", "start", "in_string", "depth")
    cut = cut.mapInPandas(_items, "value string, path string, start long, pos long, head boolean, tail boolean")
    # texts at the borders of splits: from a tail on, all parts up to the next head are one item; whole items are on their own
    borders = cut.filter("head OR tail")
    order = Window.partitionBy("path").orderBy("start", "pos")
    number = F.sum(F.when(F.col("tail") & ~F.col("head"), 1).otherwise(0)).over(order)
    parts = borders.withColumn("item", number).groupBy("path", "item")
    joined = parts.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "pos", "value"))), lambda p: p["value"]), "").alias("value"),
        F.min(F.struct("start", "pos")).alias("at"),
        F.max("item").alias("n"),
    )
    # before the first "[" and behind the last "]" there is no item
    last = F.max("n").over(Window.partitionBy("path"))
    joined = joined.withColumn("last", last).filter("n > 0 AND n < last").select("value", "path", "at.start", "at.pos")
    whole = cut.filter("NOT head AND NOT tail").select("value", "path", "start", "pos")
    return whole.union(joined).filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
