"""Queries: loading, filters, conditions, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.functions import labels as L
from registra.operators import aggregates as A
from registra.operators import filters as P
from registra.operators import maintenance as M
from registra.operators import ranking as K
from registra.operators.filters import Condition, ConditionGroup, FilterState
from registra.sources import model, star

from .base import CAT, LABEL, W, add

IDS = ["seq", "buyer", "supplier", "price_numeric_eur"]
ROWS = "SELECT seq, buyer, supplier, price_numeric_eur FROM c WHERE "

# ---------------------------------------------------------------- loading

_CORE = ["seq", "contract_id", "contract_title", "buyer", "supplier", "price_numeric_eur", "category", "pdf_text_summary", "award_type"]
add(
    "load_contracts",
    lambda c: model.backfill_defaults(c).select(*_CORE),
    """SELECT seq, contract_id, contract_title, buyer, supplier, price_numeric_eur, coalesce(category, 'not_decided') AS category, coalesce(pdf_text_summary, 'not_summarized') AS pdf_text_summary, award_type
    FROM c""",
)
add(
    "backfill_defaults",
    lambda c: model.backfill_defaults(c.select("seq", F.nullif("category", F.lit("not_decided")).alias("category"), "pdf_text_summary")).select("seq", "category", "pdf_text_summary", "award_type"),
    "SELECT seq, category, coalesce(pdf_text_summary, 'not_summarized') AS pdf_text_summary, 'unknown' AS award_type FROM c",
)
add("contract_count", lambda c: c.agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM c")
add("load_subcontractors", lambda s, d: model.as_subcontractors(star.subcontractors(s, d)).select(*IDS, "ico_supplier"), W + "SELECT seq, buyer, supplier, price_numeric_eur, ico_supplier FROM s", "")
add(
    "tender_index",
    lambda s, d: model.tender_index(star.tenders(s, d)).select("tender_id", "subject_name", "buyer_organization_name", "estimated_value"),
    "SELECT CAST(p_partkey AS VARCHAR) AS tender_id, p_name AS subject_name, p_brand AS buyer_organization_name, p_retailprice AS estimated_value FROM part",
    "",
)
add(
    "export_csv_rows",
    lambda c: model.export_rows(c.withColumns({"contract_url": F.concat(F.lit("https://register/zmluva/"), "contract_id", F.lit("/")), "price_numeric_eur": F.col("price_numeric_eur").cast("decimal(18,2)")})),
    """SELECT contract_id, coalesce(contract_title, '') AS contract_title, buyer, coalesce(supplier, '') AS supplier, coalesce(CAST(CAST(price_numeric_eur AS DECIMAL(18,2)) AS VARCHAR), '') AS price_numeric_eur,
       published_date, category, award_type, 'https://register/zmluva/' || contract_id || '/' AS contract_url FROM c""",
)
add(
    "report_rows",
    lambda c: model.report_rows(c, K.sort_order(c, [("price_numeric_eur", "desc")])),
    """, t AS (SELECT *, row_number() OVER (ORDER BY price_numeric_eur DESC NULLS LAST, seq) AS n FROM c)
    SELECT n, coalesce(substring(contract_title, 1, 80), '—') AS title, coalesce(substring(buyer, 1, 40), '—') AS buyer, coalesce(substring(supplier, 1, 40), '—') AS supplier,
    coalesce(format('{:,.2f}', price_numeric_eur), '—') AS price, coalesce(published_date, '—') AS published_date FROM t WHERE n <= 500""",
)
add("price_prefilter", lambda c: P.price_prefilter(c, 50_000, 150_000).select(*IDS), ROWS + "price_numeric_eur >= 50000 AND price_numeric_eur <= 150000")
_old = lambda: F.col("seq") % 3 == 0
_url = lambda: F.concat(F.lit("https://josephine.proebiz.com/sk/tender/"), "public_procurement_id", F.when(F.col("seq") % 4 == 0, "/detail").otherwise("/summary"))
add(
    "tender_url_worklist",
    lambda c: M.tender_worklist(c.withColumn("public_procurement_url", _url())),
    """, u AS (SELECT seq, 'https://josephine.proebiz.com/sk/tender/' || public_procurement_id || '/summary' AS tender_url FROM c
    WHERE seq % 4 <> 0 AND public_procurement_id IS NOT NULL) SELECT tender_url, min(seq) AS first_seq FROM u GROUP BY tender_url""",
)
add(
    "tender_new_urls",
    lambda c: M.tender_worklist(c.withColumn("public_procurement_url", _url()), M.tender_worklist(c.filter(_old()).withColumn("public_procurement_url", _url()))),
    """, u AS (SELECT seq, 'https://josephine.proebiz.com/sk/tender/' || public_procurement_id || '/summary' AS tender_url FROM c WHERE seq % 4 <> 0 AND public_procurement_id IS NOT NULL)
    SELECT tender_url, min(seq) AS first_seq FROM u WHERE tender_url NOT IN (SELECT tender_url FROM u WHERE seq % 3 = 0) GROUP BY tender_url""",
)
add(
    "tender_error_rows",
    lambda c: (lambda u: M.with_errors(u.filter(_old()).select("tender_url", F.col("seq").alias("tender_id")), u.filter(~_old()).select("tender_url", F.lit("not fetched").alias("error"))))(c.withColumn("tender_url", _url()).filter("tender_url IS NOT NULL")),
    """, u AS (SELECT seq, 'https://josephine.proebiz.com/sk/tender/' || public_procurement_id || CASE WHEN seq % 4 = 0 THEN '/detail' ELSE '/summary' END AS tender_url FROM c WHERE public_procurement_id IS NOT NULL)
    SELECT tender_url, CASE WHEN seq % 3 = 0 THEN seq END AS tender_id, CASE WHEN seq % 3 <> 0 THEN 'not fetched' END AS error FROM u""",
)

# ---------------------------------------------------------------- filters

_FILTERS = {
    "filter_institutions": (FilterState(institutions=["NATION_6 BUILDING", "NATION_7 MACHINERY"]), "buyer IN ('NATION_6 BUILDING', 'NATION_7 MACHINERY')"),
    "filter_date_from": (FilterState(date_from="1996-01-01"), "published_date >= '1996-01-01'"),
    "filter_date_range": (FilterState(date_from="1996-01-01", date_to="1996-12-31"), "published_date >= '1996-01-01' AND published_date <= '1996-12-31'"),
    "filter_categories": (FilterState(categories=["EUROPE", "1-URGENT"]), f"{LABEL} IN ('EUROPE', '1-URGENT')"),
    "filter_service_types": (FilterState(scanned_service_types=["ECONOMY", L.UNASSIGNED]), "(scanned_service_type = 'ECONOMY' OR scanned_service_type IS NULL)"),
    "filter_service_subtypes": (FilterState(scanned_service_subtypes=["Brand#11", "Brand#13"]), "scanned_service_subtype IN ('Brand#11', 'Brand#13')"),
    "filter_vendors": (FilterState(vendors=["Supplier#000000001", "Supplier#000000007"]), "supplier IN ('Supplier#000000001', 'Supplier#000000007')"),
    "filter_institution_icos": (FilterState(institution_icos=["00000006", "00000007"]), "ico_buyer IN ('00000006', '00000007')"),
    "filter_vendor_icos": (FilterState(vendor_icos=["00000006", "00000007"]), "ico_supplier IN ('00000006', '00000007')"),
    "filter_icos": (FilterState(icos=["00000006", "00000007"]), "(ico_buyer IN ('00000006', '00000007') OR coalesce(ico_supplier IN ('00000006', '00000007'), false))"),
    "filter_icos_params": (FilterState.from_params(icos=["00000006", "00000007"]), "ico_buyer IN ('00000006', '00000007') AND ico_supplier IN ('00000006', '00000007')"),
    "filter_value_min": (FilterState(value_min=200_000), "price_numeric_eur >= 200000"),
    "filter_value_range": (FilterState(value_min=0, value_max=50_000), "price_numeric_eur >= 0 AND price_numeric_eur <= 50000"),
    "filter_award_types": (FilterState(award_types=["direct_award"]), "award_type = 'direct_award'"),
    "text_search": (FilterState(text_search="BRAND#1"), "(contains(lower(coalesce(contract_title, '')), 'brand#1') OR contains(lower(coalesce(pdf_text_summary, '')), 'brand#1'))"),
    "filter_combined": (
        FilterState(categories=["EUROPE", "ASIA"], date_from="1995-01-01", date_to="1997-12-31", value_min=10_000, value_max=400_000, award_types=["direct_award", "tendered"]),
        f"{LABEL} IN ('EUROPE', 'ASIA') AND published_date BETWEEN '1995-01-01' AND '1997-12-31' AND price_numeric_eur BETWEEN 10000 AND 400000 AND award_type IN ('direct_award', 'tendered')",
    ),
    "benchmark_filtered": (FilterState(institutions=["X"], icos=["Y"], institution_icos=["Z"], value_min=100_000).for_benchmark(), "price_numeric_eur >= 100000"),
    "drill_down": (FilterState(value_min=1000).drill_down("month", "1996-02").drill_down("category", "ECONOMY"), "price_numeric_eur >= 1000 AND published_date BETWEEN '1996-02-01' AND '1996-02-29' AND scanned_service_type = 'ECONOMY'"),
}
for _name, (_state, _sql) in _FILTERS.items():
    add(_name, lambda c, s=_state: P.apply(c, s).select(*IDS), ROWS + _sql)

_CONDITIONS = {
    "cond_eq": (Condition("award_type", "eq", "tendered"), "award_type = 'tendered'"),
    "cond_ne": (Condition("supplier", "ne", "Supplier#000000001"), "supplier <> 'Supplier#000000001'"),
    "cond_gt": (Condition("price_numeric_eur", "gt", 250_000), "price_numeric_eur > 250000"),
    "cond_ge": (Condition("price_numeric_eur", "ge", "250000"), "price_numeric_eur >= 250000"),
    "cond_lt": (Condition("published_date", "lt", "1996-03-01"), "published_date < '1996-03-01'"),
    "cond_le": (Condition("price_numeric_eur", "le", 2000), "price_numeric_eur <= 2000"),
    "cond_contains": (Condition("buyer", "contains", "nation_1"), "contains(lower(buyer), 'nation_1')"),
}
for _name, (_cond, _sql) in _CONDITIONS.items():
    add(_name, lambda c, x=_cond: P.custom_conditions(c, ConditionGroup([x])).select(*IDS), ROWS + _sql)
_both = [_CONDITIONS["cond_eq"][0], _CONDITIONS["cond_gt"][0]]
add("cond_group_and", lambda c: P.custom_conditions(c, ConditionGroup(_both)).select(*IDS), ROWS + "award_type = 'tendered' AND price_numeric_eur > 250000")
add("cond_group_or", lambda c: P.custom_conditions(c, ConditionGroup(_both, "OR")).select(*IDS), ROWS + "(award_type = 'tendered' OR coalesce(price_numeric_eur > 250000, false))")
add(
    "custom_conditions_totals",
    lambda c: P.custom_totals(P.apply(c, FilterState(date_from="1996-01-01")), ConditionGroup(_both)),
    """SELECT count(*) FILTER (award_type = 'tendered' AND price_numeric_eur > 250000) AS total_matched, count(*) AS total_evaluated FROM c
    WHERE published_date >= '1996-01-01'""",
)
add("contract_lookup", lambda c: P.contract_lookup(c, "7").select(*IDS), "SELECT seq, buyer, supplier, price_numeric_eur FROM c WHERE contract_id = '7' ORDER BY seq LIMIT 1")
add("entity_by_ico_or_name", lambda c: P.resolve_entity(c, "buyer", "ico_buyer", "NATION_6 BUILDING").select(*IDS), ROWS + "buyer = 'NATION_6 BUILDING'")

add("entity_by_ico", lambda c: P.resolve_entity(c, "supplier", "ico_supplier", "00000007").select(*IDS), ROWS + "ico_supplier = '00000007'")

# ---------------------------------------------------------------- labels

add("category_label", lambda c: c.select("seq", L.category_label(c).alias("label")), f"SELECT seq, {LABEL} AS label FROM c")
add("service_type", lambda c: c.select("seq", L.service_type(c).alias("label")), "SELECT seq, coalesce(scanned_service_type, '') AS label FROM c")
add("service_subtype", lambda c: c.select("seq", L.service_subtype(c).alias("label")), "SELECT seq, coalesce(scanned_service_subtype, '') AS label FROM c")
add(
    "group_key",
    lambda c: c.select("seq", L.group_key(c, "category").alias("category"), L.group_key(c, "month").alias("month")),
    f"SELECT seq, {CAT} AS category, substring(published_date, 1, 7) AS month FROM c",
)
add(
    "period_key",
    lambda c: c.select("seq", L.period_key("quarter").alias("quarter"), L.period_key("year").alias("year")),
    """SELECT seq, substring(published_date, 1, 4) || '-Q' || CAST((CAST(substring(published_date, 6, 2) AS INTEGER) - 1) // 3 + 1 AS VARCHAR) AS quarter, substring(published_date, 1, 4) AS year
    FROM c""",
)
_numbered = lambda c: c.withColumns({"contract_number": F.lit(None).cast("string"), "contract_url": F.lit(None).cast("string")})
add(
    "reference_line",
    lambda c: _numbered(c).select("seq", L.reference_line().alias("line")),
    """SELECT seq, '- ' || contract_id || ' | ' || coalesce(supplier, '?') || ' | ' || buyer || ' | ' || format('{:,.2f}', coalesce(price_numeric_eur, 0.0)) || ' EUR' AS line
    FROM c""",
)
add("provenance", lambda c: _numbered(c).select(*L.provenance()), "SELECT contract_id AS id, coalesce(contract_title, '(untitled)') AS title, '' AS source, published_date AS date FROM c")
add(
    "ico_mismatch",
    lambda c: (lambda x: x.select("seq", L.ico_mismatch(x).alias("mismatch")))(c.withColumn("ico_supplier_scanned", F.when(F.col("seq") % 5 == 0, F.concat(F.lit(" "), "ico_supplier")).when(F.col("seq") % 7 == 0, F.col("ico_buyer")))),
    """SELECT seq, CASE WHEN ico_supplier IS NULL THEN false WHEN seq % 5 = 0 THEN false WHEN seq % 7 = 0 THEN ico_supplier <> ico_buyer ELSE false END AS mismatch FROM c""",
)
add(
    "contract_block",
    lambda c: (lambda x: x.select("seq", L.contract_block(x).alias("block")))(c.select("seq", "contract_title", "supplier", "price_numeric_eur", "award_type", "ico_supplier")),
    """SELECT seq, 'Title [contract_title]: ' || coalesce(contract_title, 'not extracted') || chr(10) || 'Supplier [supplier]: ' || coalesce(supplier, 'not extracted') || chr(10) ||
    'Price in EUR (numeric) [price_numeric_eur]: ' || coalesce(format('{:,.2f}', price_numeric_eur) || ' EUR', 'not extracted') || chr(10) || 'Award type [award_type]: ' || award_type || chr(10) || 'Supplier ICO [ico_supplier]: ' || coalesce(ico_supplier, 'not extracted') AS block FROM c""",
)
add(
    "severity_label",
    lambda c: c.select("seq", L.severity_label(F.col("seq") % 11 / 10).alias("label")),
    "SELECT seq, CASE WHEN (seq % 11) / 10.0 >= 0.7 THEN 'High' WHEN (seq % 11) / 10.0 >= 0.4 THEN 'Medium' ELSE 'Low' END AS label FROM c",
)
add(
    "format_compact",
    lambda c: c.filter("price_numeric_eur IS NOT NULL").select("seq", L.format_compact(F.floor("price_numeric_eur") * 10.0).alias("text")),
    """SELECT seq, CASE WHEN floor(price_numeric_eur) * 10 >= 1e6 THEN format('{:.1f}M €', round(floor(price_numeric_eur) * 10 / 1e6, 1)) WHEN floor(price_numeric_eur) * 10 >= 1e3 THEN format('{:.0f}k €', round(floor(price_numeric_eur) * 10 / 1e3)) ELSE format('{:.0f} €', floor(price_numeric_eur) * 10) END AS text
    FROM c WHERE price_numeric_eur IS NOT NULL""",
)

# ---------------------------------------------------------------- sorting

_SORTS = {
    "sort_price_desc": ([("price_numeric_eur", "desc")], "price_numeric_eur DESC NULLS LAST"),
    "sort_price_asc": ([("price_numeric_eur", "asc")], "price_numeric_eur ASC NULLS LAST"),
    "sort_multi": ([("buyer", "asc"), ("no_such_field", "asc"), ("published_date", "desc")], "lower(buyer) ASC NULLS LAST, published_date DESC NULLS LAST"),
    "sort_text": ([("supplier", "desc"), ("contract_title", "up")], "lower(supplier) DESC NULLS LAST, lower(contract_title) ASC NULLS LAST"),
    "sort_service_type": ([("scanned_service_type", "asc"), ("price_numeric_eur", "desc")], "lower(scanned_service_type) ASC NULLS LAST, price_numeric_eur DESC NULLS LAST"),
}
for _name, (_spec, _sql) in _SORTS.items():
    add(_name, lambda c, s=_spec: K.sorted_head(c, s, 1000).select("seq", "ord"), f", t AS (SELECT seq, row_number() OVER (ORDER BY {_sql}, seq) AS ord FROM c) SELECT seq, ord FROM t WHERE ord <= 1000")
#: The whole table in order, every contract with its place.
for _name in ("sort_price_desc", "sort_multi", "sort_text", "sort_service_type"):
    _spec, _sql = _SORTS[_name]
    add(_name.replace("sort_", "sort_all_"), lambda c, s=_spec: K.sorted_with_places(c, s).select("seq", "ord"), f"SELECT seq, row_number() OVER (ORDER BY {_sql}, seq) AS ord FROM c")
add(
    "contracts_page",
    lambda c: K.contracts_page(c, [("published_date", "desc")], 3, 50).select("seq", "ord", "total", "total_pages"),
    """, t AS (SELECT seq, row_number() OVER (ORDER BY published_date DESC NULLS LAST, seq) AS ord, count(*) OVER () AS total FROM c)
    SELECT seq, ord, total, CAST(ceil(total / 50.0) AS BIGINT) AS total_pages FROM t WHERE ord BETWEEN 101 AND 150""",
)
add(
    "top_contracts",
    lambda c: A.top_contracts(c).select("seq", "ord"),
    ", t AS (SELECT seq, row_number() OVER (ORDER BY coalesce(price_numeric_eur, 0) DESC, seq) AS ord FROM c) SELECT seq, ord FROM t WHERE ord <= 20",
)
add(
    "suggest",
    lambda c: K.suggest(c, "buyer", "n_1", 20).select("buyer", "score", "pos", "ord"),
    """, v AS (SELECT DISTINCT buyer, instr(lower(buyer), 'n_1') AS pos FROM c WHERE contains(lower(buyer), 'n_1')),
    t AS (SELECT buyer, pos, CASE WHEN pos = 1 THEN 0 WHEN contains(' ' || lower(buyer), ' n_1') THEN 1 ELSE 2 END AS score FROM v),
    r AS (SELECT *, row_number() OVER (ORDER BY score, pos, lower(buyer)) AS ord FROM t) SELECT buyer, CAST(score AS BIGINT) AS score, pos, ord FROM r WHERE ord <= 20""",
)
add(
    "options_selected_first",
    lambda c: K.options_selected_first(P.apply(c, FilterState(date_from="1996-01-01")).groupBy(F.col("award_type").alias("value")).agg(F.count(F.lit(1)).alias("contract_count")), ["tendered", "withdrawn"]),
    """, o2 AS (SELECT award_type AS value, count(*) AS contract_count FROM c WHERE published_date >= '1996-01-01' GROUP BY 1), s2 AS (SELECT * FROM (VALUES (0, 'tendered'), (1, 'withdrawn')) t(sel, value))
    SELECT coalesce(o2.value, s2.value) AS value, coalesce(contract_count, 0) AS contract_count, sel IS NOT NULL AS selected, row_number() OVER (ORDER BY sel NULLS LAST, coalesce(o2.value, s2.value)) AS ord FROM o2 FULL JOIN s2 ON o2.value = s2.value""",
)
