"""Rankings, sorting, pages and suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.functions.labels import SORT_FIELDS, sort_value
from registra.functions.numbering import MOST, Key, by_keys, first_numbered, numbered, slice_in_order
from registra.functions.storage import settled

from .aggregates import METRICS, PLANNED, entity_metrics

INSTITUTION_METRICS = [*METRICS, *PLANNED]
VENDOR_METRICS = ["total_spend", "contract_count", "avg_value", "max_value"]


def _values(df: DataFrame, entity: str, metric: str, allowed: Sequence[str]) -> DataFrame:
    metric = metric if metric in allowed else "total_spend"
    return entity_metrics(df, entity, [metric]).withColumn("value", F.col(metric).cast("double"))


def _rank(df: DataFrame, entity: str, metric: str, allowed: Sequence[str], by_spend_first: bool) -> DataFrame:
    ties = [F.desc("spend"), F.asc("first_seq")] if by_spend_first else [F.asc("first_seq")]
    return numbered(_values(df, entity, metric, allowed), [F.desc("value"), *ties], "rank").select("rank", "name", "value", F.col("n").alias("contract_count"))


def rank_institutions(df: DataFrame, metric: str = "total_spend") -> DataFrame:
    """All institutions by a metric, 1 to n; equal values in order of spend."""
    return _rank(df, "buyer", metric, list(METRICS), True)


def rank_vendors(df: DataFrame, metric: str = "total_spend") -> DataFrame:
    return _rank(df, "supplier", metric, VENDOR_METRICS, True)


def rank_institutions_in(df: DataFrame, metric: str = "total_spend") -> DataFrame:
    """Institutions of a filtered set, with two more metrics; equal values as first seen."""
    return _rank(df, "buyer", metric, INSTITUTION_METRICS, False)


def rank_vendors_in(df: DataFrame, metric: str = "total_spend") -> DataFrame:
    return _rank(df, "supplier", metric, VENDOR_METRICS, False)


def _with_totals(rows: DataFrame, total: int, size: int) -> DataFrame:
    return rows.withColumns({"total": F.lit(total).cast("long"), "total_pages": F.lit(-(-total // size)).cast("long")})


def rankings_page(df: DataFrame, page: int, size: int, entity: str = "buyer", metric: str = "total_spend", most: int = MOST) -> DataFrame:
    """Ranks of one page over a filtered set, with the totals; an empty ranking has no pages.

    Entities are aggregated once; only the range of values that holds the page is sorted.
    """
    allowed = INSTITUTION_METRICS if entity == "buyer" else VENDOR_METRICS
    values = settled(_values(df, entity, metric, allowed).select("name", "value", "n", "first_seq"))
    total = values.count()
    rows = slice_in_order(values, [("value", True), ("first_seq", False)], (page - 1) * size, size, "rank", total, most)
    return _with_totals(rows.select("rank", "name", "value", F.col("n").alias("contract_count")), total, size)


def with_sort_keys(df: DataFrame, spec: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[Key]]:
    """``df`` with a column for each key, worked out once a row, and the keys: nulls last both ways, anything but desc is ascending.

    Unknown fields are left out, ties stand in input order.
    """
    known = [(f, d) for f, d in spec if f in SORT_FIELDS and f in df.columns]
    keys = [(f"_key{i}", d == "desc") for i, (_, d) in enumerate(known)]
    return df.withColumns({k: sort_value(df, f) for (k, _), (f, _) in zip(keys, known)}), [*keys, ("seq", False)]


def sort_order(df: DataFrame, spec: Sequence[tuple[str, str]]) -> list[Column]:
    """The same order as columns over ``df`` itself."""
    rows = [(sort_value(df, f), d) for f, d in spec if f in SORT_FIELDS and f in df.columns]
    return [*(v.desc_nulls_last() if d == "desc" else v.asc_nulls_last() for v, d in rows), F.col("seq").asc()]


def _without_keys(rows: DataFrame, keys: Sequence[Key]) -> DataFrame:
    return rows.drop(*[k for k, _ in keys if k != "seq"])


def sort_contracts(df: DataFrame, spec: Sequence[tuple[str, str]]) -> DataFrame:
    rows, keys = with_sort_keys(df, spec)
    return _without_keys(rows.orderBy(*by_keys(keys)), keys)


def sorted_with_places(df: DataFrame, spec: Sequence[tuple[str, str]]) -> DataFrame:
    """All contracts with their places in the order; the sort runs by range partitions."""
    rows, keys = with_sort_keys(df, spec)
    return _without_keys(numbered(rows, by_keys(keys)), keys)


def sorted_head(df: DataFrame, spec: Sequence[tuple[str, str]], n: int) -> DataFrame:
    """The first n contracts in order, with their places; a bounded top-n, no global sort."""
    rows, keys = with_sort_keys(df, spec)
    return _without_keys(first_numbered(rows, by_keys(keys), n), keys)


def contracts_page(df: DataFrame, spec: Sequence[tuple[str, str]], page: int, size: int, most: int = MOST) -> DataFrame:
    """One page of sorted contracts with the totals; however deep it lies, only the range of keys that holds it is sorted."""
    rows, keys = with_sort_keys(df, spec)
    total = df.count()
    return _with_totals(_without_keys(slice_in_order(rows, keys, (page - 1) * size, size, "ord", total, most), keys), total, size)


def first_contract_per_vendor(df: DataFrame) -> DataFrame:
    """Each vendor's earliest dated contract, ties in input order; an aggregate, so frequent vendors need no sort."""
    from registra.functions.labels import nz

    dated = df.filter(nz("supplier").isNotNull() & nz("published_date").isNotNull())
    rest = [c for c in df.columns if c != "supplier"]
    first = dated.groupBy("supplier").agg(F.min_by(F.struct(*rest), F.struct("published_date", "seq")).alias("f"))
    return first.select("supplier", "f.*")


def suggest(values: DataFrame, column: str, q: str, limit: int = 20) -> DataFrame:
    """Values that hold the text: prefix matches first, then starts of words, then others, each by place and alphabet."""
    low, want = F.lower(F.col(column)), q.lower()
    place = F.instr(low, want)
    score = F.when(place == 1, 0).when(F.contains(F.concat(F.lit(" "), low), F.lit(" " + want)), 1).otherwise(2)
    found = values.select(column).distinct().filter(F.contains(low, F.lit(want))).withColumns({"score": score, "pos": place})
    order = [F.asc("score"), F.asc("pos"), F.collate(F.col(column), "UNICODE_CI_AI").asc(), F.asc(column)]
    return first_numbered(found, order, limit)


def options_selected_first(options: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Options (value, contract_count) with the selected ones first, also those without a row left."""
    chosen = options.sparkSession.createDataFrame([(i, v) for i, v in enumerate(dict.fromkeys(selected))], "sel int, value string")
    rows = options.join(F.broadcast(chosen), "value", "full_outer").withColumn("contract_count", F.coalesce("contract_count", F.lit(0)))
    order = [F.asc_nulls_last("sel"), F.asc("value")]
    return numbered(rows, order).select("value", "contract_count", F.col("sel").isNotNull().alias("selected"), "ord")
