"""Places of rows in an order over the whole table, without bringing the table to one task."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (column, descending); nulls come last both ways.
Key = tuple[str, bool]

MOST = 100_000  #: rows that are sorted for a page at most, unless the page itself has more
SPLITTERS = 128  #: values at which a key's range is cut
SAMPLE = 4_000  #: rows that splitters are chosen from, about


def numbered(df: DataFrame, order: Sequence[Column], name: str = "ord") -> DataFrame:
    """``df`` with each row's place (from 1) in the order: sorted by range partitions, which are counted and numbered side by side.

    The count of a partition and its numbering read the same shuffled ranges; nothing is kept in memory for it.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # about a variable that the import sets by itself
        import pyspark.pandas as ps

    place = f"{name}_from_zero"
    with ps.option_context("compute.default_index_cache", "NONE"):
        rows = df.orderBy(*order).pandas_api().to_spark(index_col=place)
    return rows.withColumn(name, (F.col(place) + 1).cast("long")).drop(place)


def first_numbered(df: DataFrame, order: Sequence[Column], n: int, name: str = "ord") -> DataFrame:
    """The first n rows in the order with their places: each task hands on n rows at most, and n rows are numbered."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def by_keys(keys: Sequence[Key]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]


def _interval(c: str, cuts: list) -> Column:
    """Where a value lies among rising cuts: 2i below cut i and above the one before, 2i+1 on it; nulls after all. A balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(2 * lo)
        mid = (lo + hi) // 2
        cut = F.lit(cuts[mid])
        return F.when(F.col(c) < cut, tree(lo, mid)).when(F.col(c) == cut, F.lit(2 * mid + 1)).otherwise(tree(mid + 1, hi))

    return F.when(F.col(c).isNull(), F.lit(2 * len(cuts) + 1)).otherwise(tree(0, len(cuts)))


def _parts(rows: DataFrame, keys: Sequence[Key], skip: int, n: int, size: int, most: int) -> list[DataFrame]:
    """Rows skip+1 to skip+n of ``size`` rows, as parts in order.

    The first key's range is cut at sampled values and rows are counted by interval; only intervals that the wanted rows fall into go on.
    Neighbours that are small together are sorted, a large one is cut again, and one that is a single value goes on by the next key.
    """
    if n <= 0:
        return []
    if size <= max(most, n) or not keys:
        return [rows.orderBy(*by_keys(keys)).offset(skip).limit(n) if keys else rows.offset(skip).limit(n)]
    (c, down), rest = keys[0], keys[1:]
    seen = sorted({v for (v,) in rows.select(c).dropna().sample(min(1.0, SAMPLE / size), seed=size).limit(2 * SAMPLE).collect() if v == v})
    cuts = seen[:: -(-len(seen) // SPLITTERS)] if seen else []
    at = _interval(c, cuts)
    counts = dict(rows.groupBy(at.alias("i")).agg(F.count(F.lit(1))).collect())  # at most twice SPLITTERS rows, and two
    nulls = 2 * len(cuts) + 1
    out, before, batch = [], 0, []

    def close() -> None:
        nonlocal batch
        if batch:
            start, total = batch[0][1], sum(counts[i] for i, _ in batch)
            inside = rows.filter(at.isin([i for i, _ in batch]))
            own = max(0, skip - start)
            take = min(start + total, skip + n) - start - own
            if len(batch) > 1 or total <= max(most, n) or (total == size and not cuts):
                left = keys if len(batch) > 1 or batch[0][0] % 2 == 0 else rest
                out.append(inside.orderBy(*by_keys(left)).offset(own).limit(take) if left else inside.offset(own).limit(take))
            else:
                i = batch[0][0]
                out.extend(_parts(inside, rest if i % 2 else keys, own, take, total, most))
            batch = []

    for i in sorted((i for i in counts if i != nulls), reverse=down) + [nulls] * (nulls in counts):
        if before < skip + n and before + counts[i] > skip:
            if batch and sum(counts[j] for j, _ in batch) + counts[i] > max(most, n):
                close()
            batch.append((i, before))
        before += counts[i]
    close()
    return out


def slice_in_order(df: DataFrame, keys: Sequence[Key], skip: int, n: int, name: str = "ord", size: int | None = None, most: int = MOST) -> DataFrame:
    """Rows skip+1 to skip+n in the order of the keys, with their places; the keys together are unique.

    Order statistics instead of a sort of the whole: however deep the page lies, what is sorted is at most about ``most`` rows, or the
    page. The driver sees a bounded sample of single values and counts of intervals.
    """
    size = df.count() if size is None else size
    found = _parts(df, keys, skip, min(n, size - skip), size, most)
    if not found:
        return df.limit(0).withColumn(name, F.lit(0).cast("long"))
    rows = found[0]
    for part in found[1:]:
        rows = rows.union(part)
    return rows.withColumn(name, (F.row_number().over(Window.orderBy(*by_keys(keys))) + skip).cast("long"))  # the page's rows only
