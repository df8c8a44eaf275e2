"""Filters over contracts and the condition builder, as predicates on plain columns.

On stored contracts they reach the scan. Over the star schema, where buyer and date are computed by joins, they are applied after those."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.functions.labels import UNASSIGNED, category_label, field_of, nz, service_subtype, service_type


@dataclass(frozen=True)
class FilterState:
    """Predicates that all hold; None, an empty list and an empty text leave one out, a bound of 0 does not."""

    institutions: Sequence[str] | None = None
    date_from: str | None = None
    date_to: str | None = None
    categories: Sequence[str] | None = None
    scanned_service_types: Sequence[str] | None = None
    scanned_service_subtypes: Sequence[str] | None = None
    vendors: Sequence[str] | None = None
    institution_icos: Sequence[str] | None = None
    vendor_icos: Sequence[str] | None = None
    icos: Sequence[str] | None = None
    value_min: float | None = None
    value_max: float | None = None
    award_types: Sequence[str] | None = None
    text_search: str | None = None

    @classmethod
    def from_params(cls, **params) -> FilterState:
        """As asked for by name: ``icos`` also stands in for either side's ICOs where those are not given."""
        if params.get("icos"):
            params = {"institution_icos": params["icos"], "vendor_icos": params["icos"]} | {k: v for k, v in params.items() if v}
        return cls(**params)

    def for_benchmark(self) -> FilterState:
        """Without the institution and the ICOs, so that institutions can be compared."""
        return replace(self, institutions=None, institution_icos=None, vendor_icos=None, icos=None)

    def drill_down(self, by: str, value: str) -> FilterState:
        """Narrowed to one group of a grouped view."""
        if by == "month":
            import calendar

            year, month = int(value[:4]), int(value[5:7])
            return replace(self, date_from=f"{value}-01", date_to=f"{value}-{calendar.monthrange(year, month)[1]:02d}")
        if by == "category":
            return replace(self, scanned_service_types=[value], scanned_service_subtypes=None)
        if by == "supplier":
            return replace(self, vendors=[value], vendor_icos=None)
        if by == "buyer":
            return replace(self, institutions=[value], institution_icos=None)
        if by == "award_type":
            return replace(self, award_types=[value])
        if by == "published_year":
            return replace(self, date_from=f"{value}-01-01", date_to=f"{value}-12-31")
        return self

    def predicates(self, df: DataFrame) -> dict[str, Column]:
        """The active predicates by field; none is null."""
        found: dict[str, Column] = {}
        types = list(self.scanned_service_types or [])
        if types:
            label = service_type(df)
            hit = label.isin([t for t in types if t != UNASSIGNED])
            found["scanned_service_types"] = hit | (label == "") if UNASSIGNED in types else hit
        for name, column in (
            ("institutions", F.col("buyer")),
            ("categories", category_label(df)),
            ("scanned_service_subtypes", service_subtype(df)),
            ("vendors", F.col("supplier")),
            ("institution_icos", nz("ico_buyer")),
            ("vendor_icos", nz("ico_supplier")),
            ("award_types", F.col("award_type")),
        ):
            if getattr(self, name):
                found[name] = column.isin(list(getattr(self, name)))
        if self.icos:
            found["icos"] = F.coalesce(nz("ico_buyer").isin(list(self.icos)), F.lit(False)) | F.coalesce(nz("ico_supplier").isin(list(self.icos)), F.lit(False))
        if self.date_from:
            found["date_from"] = nz("published_date") >= self.date_from
        if self.date_to:
            found["date_to"] = nz("published_date") <= self.date_to
        if self.value_min is not None:
            found["value_min"] = F.col("price_numeric_eur") >= float(self.value_min)
        if self.value_max is not None:
            found["value_max"] = F.col("price_numeric_eur") <= float(self.value_max)
        if self.text_search:
            found["text_search"] = text_match(self.text_search)
        return found


def text_match(q: str) -> Column:
    """The literal text, whatever its case, in the title or the summary."""
    inside = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))
    return inside("contract_title") | inside("pdf_text_summary")


def apply(df: DataFrame, state: FilterState) -> DataFrame:
    return reduce(DataFrame.filter, state.predicates(df).values(), df)


# ---------------------------------------------------------------- conditions

_ORDERING = {"gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le}
Predicate = Callable[[Column, object, str], Column]


def _ordered(name: str) -> Predicate:
    def test(c: Column, value: object, kind: str) -> Column:
        fits = isinstance(value, str) if kind == "string" else isinstance(value, (int, float))
        return _ORDERING[name](c, F.lit(value)) if fits else F.lit(False)

    return test


def _equal(c: Column, value: object, kind: str) -> Column:
    return c == F.lit(value) if isinstance(value, str) == (kind == "string") else F.lit(False)


def _contains(c: Column, value: object, kind: str) -> Column:
    return F.contains(F.lower(c), F.lit(str(value).lower())) if kind == "string" else F.lit(False)


#: Conditions by name; add to it to extend the builder. A predicate gets the column, the value and the column's type.
OPERATORS: dict[str, Predicate] = {
    "eq": _equal,
    "ne": lambda c, v, kind: ~_equal(c, v, kind),
    **{k: _ordered(k) for k in _ORDERING},
    "contains": _contains,
}


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: object

    def column(self, df: DataFrame) -> Column:
        """Never null: a null field, an unknown field or operator and a value that does not fit are false."""
        kinds = {n.lower(): k for n, k in df.dtypes}
        kind, value, c = kinds.get(self.field.lower()), self.value, F.col(self.field)
        if kind is None and "extra" in df.columns:  # an unknown field, kept as text; compared with numbers it is a number
            number = isinstance(value, (int, float))
            c = field_of(df, self.field)
            kind, c = ("double", c.try_cast("double")) if number else ("string", c)
        if kind is None or self.operator not in OPERATORS or value is None:
            return F.lit(False)
        if kind in ("double", "float", "int", "bigint"):
            try:
                value = float(value)
            except (TypeError, ValueError):
                return F.lit(False)
        return F.coalesce(c.isNotNull() & OPERATORS[self.operator](c, value, kind), F.lit(False))


@dataclass(frozen=True)
class ConditionGroup:
    conditions: Sequence[Condition] = ()
    logic: str = "AND"

    def column(self, df: DataFrame) -> Column:
        """All of the conditions for AND, any of them for anything else; no conditions match everything."""
        if not self.conditions:
            return F.lit(True)
        return reduce(operator.and_ if self.logic.upper() == "AND" else operator.or_, [c.column(df) for c in self.conditions])


def custom_conditions(df: DataFrame, group: ConditionGroup) -> DataFrame:
    return df.filter(group.column(df))


def custom_totals(df: DataFrame, group: ConditionGroup) -> DataFrame:
    """One row: how many contracts match, and out of how many."""
    return df.agg(F.count_if(group.column(df)).alias("total_matched"), F.count(F.lit(1)).alias("total_evaluated"))


def contract_lookup(df: DataFrame, contract_id: str) -> DataFrame:
    """The first contract with the id."""
    return df.filter(F.col("contract_id") == contract_id).orderBy("seq").limit(1)


def resolve_entity(df: DataFrame, name_column: str, ico_column: str, wanted: str) -> DataFrame:
    """Contracts whose ICO is the wanted text or, only if there are none, whose party has it as its name."""
    hits = df.filter((nz(ico_column) == wanted) | (F.col(name_column) == wanted)).withColumn("_by_ico", F.coalesce(nz(ico_column) == wanted, F.lit(False)))
    any_ico = hits.agg(F.coalesce(F.max("_by_ico"), F.lit(False)).alias("_any"))  # one row
    return hits.crossJoin(F.broadcast(any_ico)).filter(F.col("_by_ico") | ~F.col("_any")).drop("_by_ico", "_any")


def price_prefilter(df: DataFrame, low: float | None, high: float | None) -> DataFrame:
    return apply(df, FilterState(value_min=low, value_max=high))


def last_of_session(messages: DataFrame, n: int, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n messages of each session."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn), F.desc("role"), F.desc("text")))
    return messages.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")
