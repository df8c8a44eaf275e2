"""How queries are registered: the Spark function beside its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.functions.storage import scratch
from registra.sources import star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

W = "WITH " + star.CONTRACTS_SQL
SPEND = "coalesce(CAST(sum(CAST(price_numeric_eur AS DECIMAL(18,2))) AS DOUBLE), 0.0)"
AVG = f"coalesce({SPEND} / nullif(count(price_numeric_eur), 0), 0.0)"
MAX = "coalesce(max(price_numeric_eur), 0.0)"
RATE = "coalesce(CAST(count(*) FILTER (award_type = 'direct_award') AS DOUBLE) / nullif(count(*), 0), 0.0)"
SUMMARY = f"{SPEND} AS total_spend, count(*) AS contract_count, {AVG} AS avg_value, {MAX} AS max_value"
CAT = "coalesce(scanned_service_type, 'Nezaradené')"
LABEL = "coalesce(rezort, nullif(category, 'not_decided'), '')"
KEYS = {"category": CAT, "supplier": "supplier", "buyer": "buyer", "month": "substring(published_date, 1, 7)", "award_type": "award_type", "published_year": "published_year", "scanned_service_subtype": "scanned_service_subtype"}


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t == "int" else F.col(f"`{c}`") for c, t in df.dtypes])


def add(name: str, f: Callable[..., DataFrame], sql: str | None = None, table: str | None = None) -> None:
    """Registers ``f(contracts)``, or with ``table`` ``f(that table)``; "" gives it (spark, sf_dir)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if table == "":
            return _longs(f(spark, sf_dir))
        return _longs(f(star.contracts(spark, sf_dir) if table is None else spark.read.parquet(f"{sf_dir}/{table}.parquet")))

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = W + sql if table is None else sql
