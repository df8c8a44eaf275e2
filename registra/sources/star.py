"""Contracts, subcontractors and tenders over the star-schema tables.

One contract per order; its first line (by line number, part and supplier) gives the supplier and the part. The other lines are
the subcontractors. Orders without lines have no supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ico(key: Column | str) -> Column:
    return F.lpad(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), 8, "0")


def _day(c: str) -> Column:
    return F.col(c).cast("date").cast("string")


def orders_with_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    price = F.expr("CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice / 1000) * 1000 AS DOUBLE) ELSE o_totalprice END")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").cast("string").alias("contract_id"),
        F.concat("n_name", F.lit(" "), "c_mktsegment").alias("buyer"),
        _ico("c_nationkey").alias("ico_buyer"),
        price.alias("price_numeric_eur"),
        _day("o_orderdate").alias("published_date"),
        F.substring(_day("o_orderdate"), 1, 4).alias("published_year"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "not_decided").otherwise(F.col("o_orderpriority")).alias("category"),
        F.when(F.col("n_regionkey") != 0, F.col("r_name")).alias("rezort"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'direct_award' WHEN 'O' THEN 'tendered' ELSE 'negotiated' END").alias("award_type"),
    )


def _of_line(rows: DataFrame, spark: SparkSession, sf_dir: str, how: str, *more: str) -> DataFrame:
    s, p = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "part")
    rows = rows.join(s, rows.l_suppkey == s.s_suppkey, how).join(p, rows.l_partkey == p.p_partkey, how)
    return rows.select(
        "seq",
        "contract_id",
        F.col("p_name").alias("contract_title"),
        "buyer",
        "ico_buyer",
        F.col("s_name").alias("supplier"),
        F.when(F.col("l_suppkey").isNotNull(), _ico("l_suppkey")).alias("ico_supplier"),
        "price_numeric_eur",
        "published_date",
        "published_year",
        F.col("published_date").alias("date_concluded"),
        _day("l_shipdate").alias("date_published"),
        "category",
        "rezort",
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("scanned_service_type"),
        F.col("p_brand").alias("scanned_service_subtype"),
        "award_type",
        F.concat("p_type", F.lit(" "), "p_brand").alias("pdf_text_summary"),
        F.col("l_partkey").cast("string").alias("public_procurement_id"),
        *more,
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("line"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contract."""
    first = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.min("line").alias("line")).select("l_orderkey", "line.*")
    o = orders_with_buyers(spark, sf_dir)
    return _of_line(o.join(first, o.seq == first.l_orderkey, "left"), spark, sf_dir, "left")


def subcontractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of a contract other than its first."""
    lines = _lines(spark, sf_dir)
    first = lines.groupBy("l_orderkey").agg(F.min("line").alias("first"))
    others = lines.join(first, "l_orderkey").filter(F.col("line") != F.col("first")).select("l_orderkey", "line.*")
    o = orders_with_buyers(spark, sf_dir)
    return _of_line(o.join(others, o.seq == others.l_orderkey), spark, sf_dir, "inner").withColumns({"subcontractor": F.col("supplier"), "ico_subcontractor": F.col("ico_supplier")})


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts and subcontracts in one pass over the lines: ``side`` is primary for the first line of an order, and for an order without lines, else secondary."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    tagged = lines.withColumn("side", F.when(place == 1, "primary").otherwise("secondary"))
    o = orders_with_buyers(spark, sf_dir)
    rows = _of_line(o.join(tagged, o.seq == tagged.l_orderkey, "left"), spark, sf_dir, "left", "side")
    return rows.withColumn("side", F.coalesce("side", F.lit("primary")))


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tenders."""
    p = _read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("tender_id"), F.col("p_name").alias("subject_name"), F.col("p_brand").alias("buyer_organization_name"), F.col("p_retailprice").alias("estimated_value"))


#: The same views as DuckDB common table expressions.
CONTRACTS_SQL = """
o AS (SELECT o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS contract_id, concat(n_name, ' ', c_mktsegment) AS buyer,
        lpad(CAST(c_nationkey AS VARCHAR), 8, '0') AS ico_buyer,
        CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice / 1000) * 1000 AS DOUBLE) ELSE o_totalprice END AS price_numeric_eur,
        CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS published_date, substring(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 4) AS published_year,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'not_decided' ELSE o_orderpriority END AS category,
        CASE WHEN n_regionkey = 0 THEN NULL ELSE r_name END AS rezort,
        CASE o_orderstatus WHEN 'F' THEN 'direct_award' WHEN 'O' THEN 'tendered' ELSE 'negotiated' END AS award_type
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
c AS (SELECT o.seq, contract_id, p_name AS contract_title, buyer, ico_buyer, s_name AS supplier, lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS ico_supplier,
        price_numeric_eur, published_date, published_year, published_date AS date_concluded, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date_published,
        category, rezort, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS scanned_service_type, p_brand AS scanned_service_subtype, award_type,
        p_type || ' ' || p_brand AS pdf_text_summary, CAST(l_partkey AS VARCHAR) AS public_procurement_id
      FROM o LEFT JOIN (SELECT * FROM l WHERE rn = 1) l ON l.l_orderkey = o.seq LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey),
s AS (SELECT o.seq, contract_id, p_name AS contract_title, buyer, ico_buyer, s_name AS supplier, lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS ico_supplier,
        price_numeric_eur, published_date, published_year, category, rezort, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END AS scanned_service_type,
        p_brand AS scanned_service_subtype, award_type, p_type || ' ' || p_brand AS pdf_text_summary
      FROM o JOIN (SELECT * FROM l WHERE rn > 1) l ON l.l_orderkey = o.seq JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)
"""
