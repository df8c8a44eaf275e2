"""The contract model: schemas, defaults, readers and writers."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registra.functions.numbering import numbered

from .arrays import array_items

#: Values of the model that stand for "not known yet".
DEFAULTS = {"category": "not_decided", "pdf_text_summary": "not_summarized", "award_type": "unknown"}

# fixed values: the text fields of a contract, in the order in which records have them
_TEXT = (
    "published_day", "published_month", "published_year", "published_date", "contract_title", "contract_number", "price_raw", "supplier", "buyer",
    "contract_url", "contract_id", "scraped_at", "contract_number_detail", "contract_id_detail", "buyer_detail", "supplier_detail", "ico_buyer", "ico_supplier",
    "date_published", "date_concluded", "date_effective", "date_valid_until", "pdf_url", "pdf_local_path", "pdf_text", "category", "pdf_text_summary", "award_type",
    "rezort", "resort", "contract_type", "ico_rezort", "public_procurement_url", "public_procurement_id", "public_procurement_portal", "scanned_service_type",
    "scanned_service_subtype", "service_type", "service_subtype", "scanned_suggested_title", "scanned_related_contract_number", "scanned_supplier_ico",
    "scanned_payment_reason", "scanned_contract_type", "scanned_summary", "scanned_subcontractors", "subcontractor", "ico_subcontractor",
    "scanovane_ico_dodavatela", "ico_supplier_scanned", "ico_supplier_pdf",
)

#: Fields that the schema does not name are kept by name in ``extra``: texts as they are, other values as JSON text.
EXTRA = "extra"
_KNOWN = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField("price_numeric_eur", T.DoubleType()), T.StructField("scanned_contract_value", T.DoubleType()), T.StructField("pdf_urls", T.ArrayType(T.StringType()))]
)
CONTRACT_SCHEMA = T.StructType([*_KNOWN.fields, T.StructField(EXTRA, T.MapType(T.StringType(), T.StringType()))])
_CORRUPT = "_corrupt_record"


def backfill_defaults(df: DataFrame) -> DataFrame:
    """Fills the three default fields where they are null or absent; other values stay."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in DEFAULTS.items()})


def _unknown(value: Column) -> Column:
    """The fields of a JSON object that the schema does not name; null where there are none."""
    names = F.array(*map(F.lit, _KNOWN.fieldNames()))
    rest = F.map_filter(F.from_json(value, "map<string,string>"), lambda k, v: ~F.array_contains(names, k))
    return F.when(F.size(rest) > 0, rest)


OFFSET = 40  #: bits of seq for a record's place in its file


def _records(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(value, seq): one JSON text per record, numbered in the order of files and of records in them; the numbers have gaps.

    A record's place is where its split starts plus how many records come before it there, which no later split's start falls short of. Only
    names are read to number the files.
    """
    if lines:
        place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]
        raw = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")).filter(F.trim("value") != "")
    else:
        raw = array_items(spark, path)
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
    files = numbered(names, [F.asc("path")], "file")
    return raw.join(files, "path").select("value", (F.shiftleft(F.col("file") - 1, OFFSET) + F.col("start") + F.col("pos")).alias("seq"))


def load_contracts(spark: SparkSession, path: str) -> DataFrame:
    """JSON array files as contracts, each read in splits by many tasks; one record that does not fit the schema fails the load, and so does
    a file that is no array. Unknown fields go to ``extra``.
    """
    rows = _records(spark, path, lines=False)
    parsed = rows.select(F.from_json("value", _KNOWN, {"mode": "FAILFAST"}).alias("r"), _unknown(F.col("value")).alias(EXTRA), "seq")
    return backfill_defaults(parsed.select("r.*", EXTRA, "seq"))


def load_from_list(spark: SparkSession, records: Iterable[dict]) -> DataFrame:
    """Contracts from dictionaries, in their order; unknown keys go to ``extra``."""
    names = _KNOWN.fieldNames()
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    rows = [(*(r.get(c) for c in names), {k: text(v) for k, v in r.items() if k not in names} or None, i) for i, r in enumerate(records)]
    return backfill_defaults(spark.createDataFrame(rows, T.StructType([*CONTRACT_SCHEMA.fields, T.StructField("seq", T.LongType())])))


def load_records(spark: SparkSession, path: str, lines: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejected): JSON array files or one object per line; blank and malformed lines and non-objects are rejected.

    Without ``lines`` the first character of the input decides: "[" means an array.
    """
    if lines is None:
        first = spark.read.text(path).filter(F.trim("value") != "").select(F.substring(F.trim("value"), 1, 1)).first()
        lines = first is None or first[0] != "["
    schema = T.StructType([*_KNOWN.fields, T.StructField(_CORRUPT, T.StringType())])
    record = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    parsed = _records(spark, path, lines).select("value", "seq", record.alias("r"))
    good = F.coalesce(F.trim("value").startswith("{") & F.col(f"r.{_CORRUPT}").isNull() & F.col("r").isNotNull(), F.lit(False))
    return parsed.filter(good).select("r.*", _unknown(F.col("value")).alias(EXTRA), "seq").drop(_CORRUPT), parsed.filter(~good).select("value")


def write_json_arrays(records: DataFrame, path: str) -> None:
    """Every partition as a file that is one JSON array, a record a line; ``extra`` goes back to fields of its own."""
    plain = [c for c in records.columns if c not in (EXTRA, "seq")]
    value = F.to_json(F.struct(*plain))
    if EXTRA in records.columns:
        more = F.to_json(F.col(EXTRA))
        value = F.when(F.coalesce(F.size(EXTRA) > 0, F.lit(False)), F.concat(F.substring(value, 1, F.length(value) - 1), F.when(value != "{}", ", ").otherwise(""), F.substring(more, 2, F.length(more)))).otherwise(value)

    def brackets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = "["
        for part in batches:
            if len(part):
                yield pd.DataFrame({"value": [(lead if i == 0 else ", ") + v for i, v in enumerate(part.value)]})
                lead = ", "
        yield pd.DataFrame({"value": ["]" if lead != "[" else "[]"]})

    records.select(value.alias("value")).mapInPandas(brackets, "value string").write.text(path)


def migrate(spark: SparkSession, source: str, target: str) -> int:
    """Reads records, fills defaults and writes Parquet; returns how many rows were written."""
    from pyspark.sql import Observation

    seen = Observation("migrated")
    backfill_defaults(load_records(spark, source)[0]).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(target)
    return seen.get["n"]


def as_subcontractors(expanded: DataFrame) -> DataFrame:
    """Expanded rows as a second contract dataset: the subcontractor takes the supplier's place, even where it is null."""
    return expanded.withColumns({"supplier": F.col("subcontractor"), "ico_supplier": F.col("ico_subcontractor")})


def tender_index(tenders: DataFrame) -> DataFrame:
    """Tenders by text id; rows without one are dropped, of several the last stays."""
    rows = tenders.withColumn("tender_id", F.col("tender_id").cast("string")).filter("tender_id IS NOT NULL")
    last = F.row_number().over(Window.partitionBy("tender_id").orderBy(F.desc("seq")))
    return rows.withColumn("_n", last).filter("_n = 1").drop("_n")


EXPORT_COLUMNS = ["contract_id", "contract_title", "buyer", "supplier", "price_numeric_eur", "published_date", "category", "award_type", "contract_url"]


def export_rows(contracts: DataFrame) -> DataFrame:
    """The nine export columns as text, null as empty."""
    return contracts.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORT_COLUMNS])


def write_csv(contracts: DataFrame, path: str, order: list[Column] = ()) -> None:
    rows = contracts.orderBy(*order) if order else contracts
    export_rows(rows).write.option("header", True).option("emptyValue", "").csv(path)


def report_rows(contracts: DataFrame, order: list[Column], limit: int = 500) -> DataFrame:
    """The first rows in order, numbered, with shortened texts; a null is shown as a dash."""
    dash = lambda c, n: F.coalesce(F.substring(c, 1, n), F.lit("—"))
    top = contracts.orderBy(*order).limit(limit)
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("n"),  # over at most ``limit`` rows
        dash("contract_title", 80).alias("title"),
        dash("buyer", 40).alias("buyer"),
        dash("supplier", 40).alias("supplier"),
        F.coalesce(F.format_number("price_numeric_eur", 2), F.lit("—")).alias("price"),
        F.coalesce("published_date", F.lit("—")).alias("published_date"),
    )
