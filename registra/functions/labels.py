"""Labels, group keys and period keys of contracts as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNASSIGNED = "Nezaradené"  # fixed value: the label of contracts without a service type


def nz(c: Column | str) -> Column:
    """Null for an empty text."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _filled(df: DataFrame, names: list[str]) -> list[Column]:
    """The named columns that there are, trimmed, blank ones null; names are matched without regard to case."""
    by_name = {c.lower(): c for c in df.columns}
    return [nz(F.trim(F.col(by_name[n]))) for n in names if n in by_name]


def _first(df: DataFrame, names: list[str], but: str | None = None) -> Column:
    found = [F.nullif(c, F.lit(but)) if but else c for c in _filled(df, names)]
    return F.coalesce(*found, F.lit(""))


def category_label(df: DataFrame) -> Column:
    return _first(df, ["rezort", "resort", "category"], "not_decided")


def service_type(df: DataFrame) -> Column:
    return _first(df, ["scanned_service_type", "service_type"])


def service_subtype(df: DataFrame) -> Column:
    return _first(df, ["scanned_service_subtype", "service_subtype"])


def field_of(df: DataFrame, field: str) -> Column:
    """A field by name: a column, else one of the unknown fields that ``extra`` keeps, else null."""
    if field in df.columns:
        return F.col(field)
    return F.try_element_at(F.col("extra"), F.lit(field)) if "extra" in df.columns else F.lit(None).cast("string")


def group_key(df: DataFrame, field: str) -> Column:
    """The key to group by; null keys are dropped by the caller. Categories are grouped by service type."""
    if field == "month":
        return F.substring(nz("published_date"), 1, 7)
    if field == "category":
        return F.coalesce(nz(service_type(df)), F.lit(UNASSIGNED))
    return field_of(df, field).cast("string")


def period_key(granularity: str = "month") -> Column:
    """YYYY-MM, YYYY-Qn or YYYY of the publication date; anything but quarter and year means month."""
    d = nz("published_date")
    if granularity == "year":
        return F.substring(d, 1, 4)
    if granularity == "quarter":
        month = F.substring(d, 6, 2).try_cast("int")
        return F.concat(F.substring(d, 1, 4), F.lit("-Q"), F.floor((month - 1) / 3 + 1).cast("string"))
    return F.substring(d, 1, 7)


# fixed values: the fields that contracts can be sorted by
SORT_FIELDS = (
    "contract_title", "contract_number", "price_numeric_eur", "supplier", "buyer", "published_date", "date_concluded", "category", "award_type",
    "date_effective", "scanned_suggested_title", "scanned_service_type", "scanned_service_subtype", "date_published",
)


def sort_value(df: DataFrame, field: str) -> Column:
    """What a field is sorted by: labels for category and service fields; texts trimmed and lower-cased, blank ones null."""
    labels = {"category": category_label, "scanned_service_type": service_type, "scanned_service_subtype": service_subtype}
    value = labels[field](df) if field in labels else F.col(field)
    return value if dict(df.dtypes).get(field) == "double" else nz(F.lower(F.trim(value)))


def reference_line() -> Column:
    """One line that names a contract."""
    one = lambda *names: F.coalesce(*[nz(n) for n in names], F.lit("?"))
    return F.concat(F.lit("- "), F.concat_ws(" | ", one("contract_number", "contract_id"), one("supplier"), one("buyer"), money_text(F.coalesce("price_numeric_eur", F.lit(0.0)))))


def money_text(c: Column) -> Column:
    return F.concat(F.format_number(c, 2), F.lit(" EUR"))


def provenance() -> list[Column]:
    text = lambda c, empty="": F.coalesce(nz(c), F.lit(empty))
    return [text("contract_id").alias("id"), text("contract_title", "(untitled)").alias("title"), text("contract_url").alias("source"), text("published_date").alias("date")]


def ico_mismatch(df: DataFrame) -> Column:
    """Does the supplier's ICO of the register differ from the first that was read from the documents?"""
    scanned = [nz(c) for c in ("scanovane_ico_dodavatela", "ico_supplier_scanned", "ico_supplier_pdf") if c in df.columns]
    return F.coalesce(F.trim(nz("ico_supplier")) != F.trim(F.coalesce(*scanned, F.lit(None).cast("string"))), F.lit(False))


# fixed values: the labels that a contract's fields have in a text block
FIELD_LABELS = {
    "published_day": "Published day (raw)",
    "published_month": "Published month (raw)",
    "published_year": "Published year (raw)",
    "published_date": "Published date (normalized)",
    "contract_title": "Title",
    "contract_number": "Contract number",
    "price_raw": "Price (raw)",
    "price_numeric_eur": "Price in EUR (numeric)",
    "supplier": "Supplier",
    "buyer": "Buyer",
    "contract_url": "CRZ contract URL",
    "contract_id": "Contract ID",
    "scraped_at": "Scraped at",
    "ico_buyer": "Buyer ICO",
    "ico_supplier": "Supplier ICO",
    "date_published": "CRZ published date",
    "date_concluded": "Signed date",
    "date_effective": "Effective from",
    "date_valid_until": "Valid until",
    "pdf_urls": "Attached PDF URLs",
    "pdf_url": "Primary PDF URL",
    "pdf_text": "Extracted PDF text",
    "category": "Category",
    "pdf_text_summary": "PDF summary",
    "award_type": "Award type",
}


def field_label(name: str) -> str:
    return FIELD_LABELS.get(name, name.replace("_", " ").strip().capitalize())


def contract_block(df: DataFrame, but: tuple[str, ...] = ("seq",)) -> Column:
    """Every field as a line "label [key]: value"; what is missing is said to be not extracted, an empty list to be none."""
    lines = [F.when(ico_mismatch(df), F.lit("WARNING [ico_mismatch]")).otherwise(F.lit(None))]
    for name, kind in df.dtypes:
        if name in but:
            continue
        c = F.col(name)
        if kind.startswith("map"):  # unknown fields, each a line of its own
            entry = lambda e: F.concat(F.initcap(F.substring(e["key"], 1, 1)), F.replace(F.substring(e["key"], 2, 1000), F.lit("_"), F.lit(" ")), F.lit(" ["), e["key"], F.lit("]: "), F.coalesce(nz(e["value"]), F.lit("not extracted")))
            lines.append(nz(F.array_join(F.transform(F.map_entries(c), entry), "\n")))
            continue
        if kind.startswith("array"):
            value = F.when(F.size(c) == 0, "none").otherwise(F.array_join(c, ", "))
        elif name == "price_numeric_eur":
            value = money_text(c)
        elif kind == "boolean":
            value = F.when(c, "yes").otherwise("no")
        else:
            value = nz(c.cast("string"))
        value = F.when(c.isNotNull(), value)
        lines.append(F.concat(F.lit(f"{field_label(name)} [{name}]: "), F.coalesce(value, F.lit("not extracted"))))
    return F.concat_ws("\n", *lines)


def severity_label(s: Column) -> Column:
    return F.when(s >= 0.7, "High").when(s >= 0.4, "Medium").otherwise("Low")


def format_compact(v: Column) -> Column:
    size = F.abs(v)
    return F.when(size >= 1e6, F.format_string("%.1fM €", v / 1e6)).when(size >= 1e3, F.format_string("%.0fk €", v / 1e3)).otherwise(F.format_string("%.0f €", v))
