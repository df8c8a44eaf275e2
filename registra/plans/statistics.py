"""Queries: groups, facets, trends, rankings, profiles, comparisons and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.operators import aggregates as A
from registra.operators import filters as P
from registra.operators import ranking as K
from registra.operators import rules as R
from registra.operators.filters import FilterState
from registra.sources import star

from .base import AVG, CAT, KEYS, LABEL, MAX, RATE, SPEND, SUMMARY, W, add

_STATE = FilterState(date_from="1996-01-01", date_to="1999-12-31", categories=["EUROPE", "ASIA", "1-URGENT"], award_types=["direct_award", "tendered"], value_min=5000)
_WHERE = f"published_date BETWEEN '1996-01-01' AND '1999-12-31' AND {LABEL} IN ('EUROPE', 'ASIA', '1-URGENT') AND award_type IN ('direct_award', 'tendered') AND price_numeric_eur >= 5000"

# ---------------------------------------------------------------- groups

for _f in ("supplier", "buyer", "category", "award_type"):
    add(f"group_by_{_f}", lambda c, f=_f: A.group_by(c, f), f"SELECT {KEYS[_f]} AS group_value, count(*) AS contract_count, min(seq) AS first_seq FROM c WHERE {KEYS[_f]} IS NOT NULL GROUP BY 1")
add("aggregate_summary", lambda c: A.aggregate(P.apply(c, _STATE)), f"SELECT {SUMMARY} FROM c WHERE {_WHERE}")
add("aggregate_empty", lambda c: A.aggregate(c.filter("seq < 0")), f"SELECT {SUMMARY} FROM c WHERE seq < 0")


def _groups(field: str, where: str = "true") -> str:
    key = KEYS[field]
    return f""", g AS (SELECT {key} AS group_value, {SUMMARY}, min(seq) AS first_seq FROM c WHERE {key} IS NOT NULL AND {where} GROUP BY 1)
    SELECT '{field}' AS group_key, group_value, contract_count, total_spend, avg_value, max_value, row_number() OVER (ORDER BY total_spend DESC, first_seq) AS ord FROM g"""


for _f, _name in (("category", "agg_by_category"), ("buyer", "agg_by_buyer"), ("month", "agg_by_month"), ("award_type", "agg_by_award_type"), ("published_year", "agg_by_year"), ("scanned_service_subtype", "agg_by_service_subtype")):
    add(_name, lambda c, f=_f: A.aggregate_groups(c, f), _groups(_f))
add("agg_by_supplier", lambda c: A.aggregate_groups(P.apply(c, _STATE), "supplier"), _groups("supplier", _WHERE))
add(
    "aggregations_with_total",
    lambda c: A.aggregations_with_total(c, "supplier"),
    f"""SELECT group_value, total_spend, contract_count, avg_value, max_value, is_total FROM (SELECT supplier AS group_value, {SUMMARY}, 0 AS is_total FROM c
    WHERE supplier IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, {SUMMARY}, 1 FROM c)""",
)


def _parties(name: str, ico: str, top: int | None = None) -> str:
    return f""", g AS (SELECT {name} AS name, arg_min({ico}, seq) AS ico, count(*) AS contract_count, {SPEND} AS total_spend, min(seq) AS first_seq FROM c WHERE {name} IS NOT NULL GROUP BY 1),
    r AS (SELECT name, ico, contract_count, total_spend, row_number() OVER (ORDER BY total_spend DESC, first_seq) AS ord FROM g) SELECT * FROM r""" + (f" WHERE ord <= {top}" if top else "")


add("institutions", A.institutions, _parties("buyer", "ico_buyer"))
add("vendors", A.vendors, _parties("supplier", "ico_supplier"))
add("top_vendors", A.top_vendors, _parties("supplier", "ico_supplier", 10))
add("ico_map", A.ico_map, "SELECT DISTINCT 'institution' AS kind, buyer AS name, ico_buyer AS ico FROM c UNION ALL SELECT DISTINCT 'vendor', supplier, ico_supplier FROM c WHERE supplier IS NOT NULL")
add("direct_award_rate", A.direct_award_rate, f"SELECT {RATE} AS direct_award_rate FROM c")

_CONC = """, v AS (SELECT buyer, supplier, sum(CAST(price_numeric_eur AS DECIMAL(18,2))) AS spend, min(seq) AS first_seq FROM c WHERE supplier IS NOT NULL AND price_numeric_eur IS NOT NULL GROUP BY 1, 2),
 vr AS (SELECT *, row_number() OVER (PARTITION BY buyer ORDER BY spend DESC, first_seq) AS rn FROM v),
 conc AS (SELECT buyer, coalesce(CAST(sum(CASE WHEN rn <= 3 THEN spend END) AS DOUBLE) / nullif(CAST(sum(spend) AS DOUBLE), 0), 0.0) AS vendor_concentration FROM vr GROUP BY 1)"""
_FRAG = """, p AS (SELECT buyer, price_numeric_eur AS price, row_number() OVER (PARTITION BY buyer ORDER BY price_numeric_eur) AS rn, count(*) OVER (PARTITION BY buyer) AS n FROM c WHERE price_numeric_eur IS NOT NULL),
 med AS (SELECT buyer, price AS upper_median, n AS priced FROM p WHERE rn = n // 2 + 1),
 frag AS (SELECT med.buyer, CASE WHEN any_value(upper_median) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (p.price < upper_median) AS DOUBLE) / any_value(priced) END AS fragmentation_score FROM med JOIN p ON p.buyer = med.buyer GROUP BY 1)"""
add("vendor_concentration", lambda c: A.vendor_concentration(c, "buyer"), _CONC + " SELECT * FROM conc")
add("fragmentation_score", lambda c: A.fragmentation_score(c, "buyer"), _FRAG + " SELECT * FROM frag")
add("upper_median", lambda c: A.upper_median(c, "buyer"), _FRAG + " SELECT * FROM med")
add(
    "upper_median_overall",
    lambda c: A.upper_median(c),
    """, p AS (SELECT price_numeric_eur AS price, row_number() OVER (ORDER BY price_numeric_eur) AS rn, count(*) OVER () AS n FROM c
    WHERE price_numeric_eur IS NOT NULL) SELECT price AS upper_median, n AS priced FROM p WHERE rn = n // 2 + 1""",
)

add(
    "vendor_concentration_overall",
    lambda c: A.vendor_concentration(c),
    """, v AS (SELECT supplier, sum(CAST(price_numeric_eur AS DECIMAL(18,2))) AS spend, min(seq) AS f FROM c
    WHERE supplier IS NOT NULL AND price_numeric_eur IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY spend DESC, f) AS rn FROM v)
    SELECT CAST(sum(spend) FILTER (rn <= 3) AS DOUBLE) / CAST(sum(spend) AS DOUBLE) AS vendor_concentration FROM r""",
)
add(
    "fragmentation_overall",
    lambda c: A.fragmentation_score(c),
    """, p AS (SELECT price_numeric_eur AS price, row_number() OVER (ORDER BY price_numeric_eur) AS rn, count(*) OVER () AS n FROM c
    WHERE price_numeric_eur IS NOT NULL), m AS (SELECT price AS mid, n FROM p WHERE rn = n // 2 + 1)
    SELECT CAST(count(*) FILTER (price < mid) AS DOUBLE) / any_value(m.n) AS fragmentation_score FROM p, m""",
)

_D = "published_date BETWEEN '1996-01-01' AND '1999-12-31'"
_TESTS = {"c": f"{LABEL} IN ('EUROPE', 'ASIA', '1-URGENT')", "a": "award_type IN ('direct_award', 'tendered')"}


def _facet(dim: str, value: str, own: str | None = None) -> str:
    tests = " AND ".join([_D, "price_numeric_eur >= 5000", *(v for k, v in _TESTS.items() if k != own)])
    return f"SELECT '{dim}' AS dim, {value} AS value, count(*) AS contract_count FROM c WHERE {tests} AND nullif({value}, '') IS NOT NULL GROUP BY 2"


add(
    "filter_options",
    lambda c: A.filter_options(c, _STATE),
    " UNION ALL ".join([
        _facet("institutions", "buyer"), _facet("categories", LABEL, "c"), _facet("scanned_service_types", "scanned_service_type"), _facet("scanned_service_subtypes", "scanned_service_subtype"),
        _facet("vendors", "supplier"), _facet("award_types", "award_type", "a"), _facet("institution_icos", "ico_buyer"),
    ]),
)
add("categories", A.categories, f", d AS (SELECT DISTINCT {LABEL} AS category FROM c) SELECT category, row_number() OVER (ORDER BY category) AS ord FROM d WHERE category <> ''")
_ROOT = f"SELECT 0 AS level, NULL AS g1, {{n}} {SPEND} AS value, count(*) AS contract_count FROM c"
add("treemap_1", lambda c: A.treemap(c, "supplier"), _ROOT.format(n="") + f" UNION ALL SELECT 1, supplier, {SPEND}, count(*) FROM c WHERE supplier IS NOT NULL GROUP BY 2")
add(
    "treemap_2",
    lambda c: A.treemap(c, "supplier", "category"),
    _ROOT.format(n="NULL AS g2,") + f" UNION ALL SELECT 1, supplier, NULL, {SPEND}, count(*) FROM c WHERE supplier IS NOT NULL GROUP BY 2 UNION ALL SELECT 2, supplier, {CAT}, {SPEND}, count(*) FROM c WHERE supplier IS NOT NULL GROUP BY 2, 3",
)
add(
    "treemap_nested",
    lambda c: A.nested_treemap(c, "award_type", "category").select("g1", "value", "contract_count", F.size("children").alias("n_children")),
    f"SELECT award_type AS g1, {SPEND} AS value, count(*) AS contract_count, count(DISTINCT {CAT}) AS n_children FROM c GROUP BY 1",
)

# ---------------------------------------------------------------- trends and comparisons

_PERIOD = {"month": "substring(published_date, 1, 7)", "year": "substring(published_date, 1, 4)", "quarter": "substring(published_date, 1, 4) || '-Q' || CAST((CAST(substring(published_date, 6, 2) AS INTEGER) - 1) // 3 + 1 AS VARCHAR)"}
for _g in ("month", "quarter", "year"):
    add(f"trend_{_g}", lambda c, g=_g: A.trend(c, g), f"SELECT {_PERIOD[_g]} AS period, {SPEND} AS total_spend FROM c GROUP BY 1")
add("trend_count", lambda c: A.trend(c, "century", ["contract_count"]), f"SELECT {_PERIOD['month']} AS period, CAST(count(*) AS DOUBLE) AS contract_count FROM c GROUP BY 1")
add(
    "trend_multi",
    lambda c: A.trend(c, "quarter", ["total_spend", "avg_value", "max_value", "direct_award_rate"]),
    f"SELECT {_PERIOD['quarter']} AS period, {SPEND} AS total_spend, {AVG} AS avg_value, {MAX} AS max_value, {RATE} AS direct_award_rate FROM c GROUP BY 1",
)
add("trend_summary", A.trend_summary, f", t AS (SELECT {_PERIOD['month']} AS period, {SPEND} AS v FROM c GROUP BY 1) SELECT count(*) AS periods, round(sum(v), 2) AS total, max(v) AS peak FROM t")
add(
    "trend_overlays",
    lambda c: A.trend_overlays(c, c.sparkSession.createDataFrame([("1996-03-04", "election"), ("1997-07-01", "reform"), ("2030-01-01", "later")], "event_date string, title string"), "month"),
    f""", t AS (SELECT {_PERIOD['month']} AS period, {SPEND} AS total_spend FROM c GROUP BY 1) SELECT period, total_spend, title FROM t
    LEFT JOIN (VALUES ('1996-03', 'election'), ('1997-07', 'reform')) e(p, title) ON p = period""",
)
_NAMES = ["NATION_6 BUILDING", "NATION_7 MACHINERY", "Nobody", "NATION_1 FURNITURE", "NATION_2 HOUSEHOLD"]
_ASKED = ", req AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES)) + ") t(req, name))"


def _compare(metric: str, sql: str) -> str:
    return f"{_ASKED}, m AS (SELECT buyer, {sql} AS v FROM c GROUP BY 1) SELECT name, '{metric}' AS metric, coalesce(v, 0.0) AS value, row_number() OVER (ORDER BY coalesce(v, 0.0) DESC, req) AS ord FROM req LEFT JOIN m ON buyer = name"


add("compare_total_spend", lambda c: A.compare(c, _NAMES, "total_spend"), _compare("total_spend", SPEND))
add("compare_direct_award_rate", lambda c: A.compare(c, _NAMES, "direct_award_rate"), _compare("direct_award_rate", RATE))
add("compare_unknown_metric", lambda c: A.compare(c, _NAMES, "no_such"), _compare("no_such", "0.0"))
add(
    "benchmark_min_contracts",
    lambda c: A.benchmark(c, FilterState(institutions=["x"], date_from="1996-01-01"), _NAMES, "total_spend", 50),
    _ASKED + f""", m AS (SELECT buyer, {SPEND} AS v, count(*) AS n FROM c WHERE published_date >= '1996-01-01' GROUP BY 1), r AS (SELECT name, 'total_spend' AS metric, coalesce(v, 0.0) AS value, row_number() OVER (ORDER BY coalesce(v, 0.0) DESC, req) AS ord, coalesce(n, 0) AS contract_count FROM req LEFT JOIN m ON buyer = name) SELECT * FROM r WHERE contract_count >= 50""",
)
add(
    "compare_multi_metric",
    lambda c: A.compare_multi(c, _NAMES, ["total_spend", "direct_award_rate", "vendor_concentration", "fragmentation_score", "no_such"]),
    _CONC + _FRAG + _ASKED + f", m AS (SELECT buyer, {SPEND} AS total_spend, {RATE} AS direct_award_rate FROM c GROUP BY 1) SELECT req, name, coalesce(total_spend, 0.0) AS total_spend, coalesce(direct_award_rate, 0.0) AS direct_award_rate, coalesce(vendor_concentration, 0.0) AS vendor_concentration, coalesce(fragmentation_score, 0.0) AS fragmentation_score, 0.0 AS no_such FROM req LEFT JOIN m ON m.buyer = name LEFT JOIN conc ON conc.buyer = name LEFT JOIN frag ON frag.buyer = name",
)
add(
    "peer_group",
    lambda c: A.peer_group(c, _NAMES[0], 100),
    f""", g AS (SELECT buyer, count(*) AS contract_count, {SPEND} AS total_spend, min(seq) AS first_seq FROM c WHERE buyer <> '{_NAMES[0]}'
    GROUP BY 1 HAVING count(*) >= 100) SELECT buyer, contract_count, total_spend, row_number() OVER (ORDER BY total_spend DESC, first_seq) AS ord FROM g""",
)

# ---------------------------------------------------------------- profiles

_INST = lambda c: P.resolve_entity(c, "buyer", "ico_buyer", "00000006")
_VEND = lambda c: P.resolve_entity(c, "supplier", "ico_supplier", "Supplier#000000007")
add(
    "institution_profile_stats",
    lambda c: A.profile(_INST(c), "buyer", "ico_buyer"),
    f"SELECT arg_min(buyer, seq) AS name, arg_min(ico_buyer, seq) AS ico, {SUMMARY} FROM c WHERE ico_buyer = '00000006'",
)
add(
    "institution_top_vendors",
    lambda c: A.top_vendors(_INST(c)),
    f""", x AS (SELECT * FROM c
    WHERE ico_buyer = '00000006' AND supplier IS NOT NULL), g AS (SELECT supplier AS name, arg_min(ico_supplier, seq) AS ico, count(*) AS contract_count, {SPEND} AS total_spend, min(seq) AS first_seq
    FROM x GROUP BY 1), r AS (SELECT name, ico, contract_count, total_spend, row_number() OVER (ORDER BY total_spend DESC, first_seq) AS ord FROM g)
    SELECT * FROM r WHERE ord <= 10""",
)
add("institution_trend", lambda c: A.trend(_INST(c), "month"), f"SELECT {_PERIOD['month']} AS period, {SPEND} AS total_spend FROM c WHERE ico_buyer = '00000006' GROUP BY 1")
add(
    "vendor_profile_stats",
    lambda c: A.profile(_VEND(c), "supplier", "ico_supplier"),
    f"SELECT arg_min(supplier, seq) AS name, arg_min(ico_supplier, seq) AS ico, {SUMMARY} FROM c WHERE supplier = 'Supplier#000000007'",
)
add(
    "vendor_institutions_served",
    lambda c: A.institutions(_VEND(c)),
    f""", g AS (SELECT buyer AS name, arg_min(ico_buyer, seq) AS ico, count(*) AS contract_count, {SPEND} AS total_spend, min(seq) AS first_seq FROM c
    WHERE supplier = 'Supplier#000000007' GROUP BY 1)
    SELECT name, ico, contract_count, total_spend, row_number() OVER (ORDER BY total_spend DESC, first_seq) AS ord FROM g""",
)


def _sets(field: str) -> str:
    side = lambda t, n: f"{n} AS (SELECT *, row_number() OVER (ORDER BY total_spend DESC, first_seq) AS ord FROM (SELECT {KEYS[field]} AS k, {SPEND} AS total_spend, count(*) AS contract_count, {AVG} AS avg_value, min(seq) AS first_seq FROM {t} WHERE {KEYS[field]} IS NOT NULL GROUP BY 1))"
    cols = ", ".join(f"coalesce({x}.{m}, 0) AS {n}_{m}" for x, n in (("p1", "primary"), ("s1", "secondary")) for m in ("total_spend", "contract_count", "avg_value"))
    return f", {side('c', 'p1')}, {side('s', 's1')} SELECT coalesce(p1.k, s1.k) AS group_value, {cols}, row_number() OVER (ORDER BY coalesce(p1.total_spend, 0) DESC, p1.ord NULLS LAST, s1.ord) AS ord FROM p1 FULL JOIN s1 ON p1.k = s1.k"


add("compare_subcontractors", lambda s, d: A.compare_sides(star.sides(s, d), "supplier"), W + _sets("supplier"), "")
add(
    "compare_subcontractors_top",
    lambda s, d: A.compare_sides(star.sides(s, d), "month").filter("ord <= 15"),
    W + _sets("month").replace("SELECT coalesce(p1.k", ", fin AS (SELECT coalesce(p1.k") + ") SELECT * FROM fin WHERE ord <= 15",
    "",
)
add("compare_two_datasets", lambda s, d: A.compare_sets(star.contracts(s, d), star.subcontractors(s, d), "supplier"), W + _sets("supplier"), "")
add(
    "compare_without_second",
    lambda c: A.compare_sets(c, None, "award_type"),
    f""", g AS (SELECT award_type, {SPEND} AS t, count(*) AS n, {AVG} AS a, min(seq) AS f FROM c GROUP BY 1)
    SELECT award_type AS group_value, t AS primary_total_spend, n AS primary_contract_count, a AS primary_avg_value, 0.0 AS secondary_total_spend, 0 AS secondary_contract_count, 0.0 AS secondary_avg_value, row_number() OVER (ORDER BY t DESC, f) AS ord
    FROM g""",
)
add("scope_summary", lambda c: A.scope_summary(P.apply(c, _STATE)), f"SELECT {SUMMARY}, min(published_date) AS date_min, max(published_date) AS date_max FROM c WHERE {_WHERE}")
add(
    "category_breakdown",
    A.category_breakdown,
    f""", g AS (SELECT {CAT} AS category, count(*) AS contract_count, {SPEND} AS total_spend, min(seq) AS f FROM c GROUP BY 1)
    SELECT category, contract_count, total_spend, row_number() OVER (ORDER BY contract_count DESC, f) AS ord FROM g""",
)
add(
    "remainder_summary",
    A.remainder_summary,
    f""", t AS (SELECT *, row_number() OVER (ORDER BY coalesce(price_numeric_eur, 0) DESC, seq) AS rn FROM c)
    SELECT count(*) AS remaining, {SPEND} AS remaining_total FROM t WHERE rn > 20""",
)
add(
    "session_usage",
    lambda e: A.session_usage(e.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 77).alias("completion_tokens"), F.col("value").alias("cost_usd"), F.col("event_id").alias("seq"))),
    "SELECT user_id AS session_id, CAST(sum(event_id % 1000) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 77) AS BIGINT) AS completion_tokens, round(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE), 6) AS cost_usd, count(*) AS requests, arg_max(value, event_id) AS last_cost_usd FROM events GROUP BY 1",
    "events",
)

# ---------------------------------------------------------------- rankings


def _ranked(entity: str, value: str, ties: str, extra: str = "", join: str = "") -> str:
    return f"{extra}, g AS (SELECT {entity} AS name, {value} AS value, {SPEND} AS spend, count(*) AS contract_count, min(seq) AS first_seq FROM c {join} WHERE c.{entity} IS NOT NULL GROUP BY 1) SELECT row_number() OVER (ORDER BY value DESC, {ties}) AS rank, name, CAST(value AS DOUBLE) AS value, contract_count FROM g"


_M = {"spend": ("total_spend", SPEND), "count": ("contract_count", "count(*)"), "avg": ("avg_value", AVG), "max": ("max_value", MAX), "dar": ("direct_award_rate", RATE)}
for _k, (_m, _sql) in _M.items():
    add(f"rank_inst_{_k}", lambda c, m=_m: K.rank_institutions_in(c, m), _ranked("buyer", _sql, "first_seq"))
    if _k != "dar":
        add(f"rank_vendor_{_k}", lambda c, m=_m: K.rank_vendors_in(c, m), _ranked("supplier", _sql, "first_seq"))
add(
    "rank_inst_conc",
    lambda c: K.rank_institutions_in(c, "vendor_concentration"),
    _CONC + f", g AS (SELECT c.buyer AS name, coalesce(any_value(vendor_concentration), 0.0) AS value, count(*) AS contract_count, min(seq) AS first_seq FROM c LEFT JOIN conc ON conc.buyer = c.buyer GROUP BY 1) SELECT row_number() OVER (ORDER BY value DESC, first_seq) AS rank, name, value, contract_count FROM g",
)
add(
    "rank_inst_frag",
    lambda c: K.rank_institutions_in(c, "fragmentation_score"),
    _FRAG + f", g AS (SELECT c.buyer AS name, coalesce(any_value(fragmentation_score), 0.0) AS value, count(*) AS contract_count, min(seq) AS first_seq FROM c LEFT JOIN frag ON frag.buyer = c.buyer GROUP BY 1) SELECT row_number() OVER (ORDER BY value DESC, first_seq) AS rank, name, value, contract_count FROM g",
)
add("rank_institutions_all", lambda c: K.rank_institutions(c, "max_value"), _ranked("buyer", MAX, "spend DESC, first_seq"))
add("rank_vendors_all", lambda c: K.rank_vendors(c, "direct_award_rate"), _ranked("supplier", SPEND, "spend DESC, first_seq"))
add(
    "rankings_page",
    lambda c: K.rankings_page(c, 2, 20),
    f""", r AS ({_ranked('buyer', SPEND, 'first_seq').replace(', g AS', 'WITH g AS', 1)}) SELECT *, (SELECT count(*)
    FROM r) AS total, (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM r) AS total_pages FROM r WHERE rank BETWEEN 21 AND 40""",
)
add(
    "first_contract_per_vendor",
    lambda c: K.first_contract_per_vendor(c).select("supplier", "published_date", "seq", "price_numeric_eur"),
    """, t AS (SELECT supplier, published_date, seq, price_numeric_eur, row_number() OVER (PARTITION BY supplier ORDER BY published_date, seq) AS rn FROM c
    WHERE supplier IS NOT NULL) SELECT supplier, published_date, seq, price_numeric_eur FROM t WHERE rn = 1""",
)

# ---------------------------------------------------------------- rules

_FLAG = "SELECT '{rule}' AS rule_id, {sev} AS severity, {cid} AS contract_id, supplier AS vendor, buyer AS institution"
_flat = lambda flags, *keys: flags.select("rule_id", "severity", "contract_id", "vendor", "institution", *[F.col("details")[k].cast("double").alias(k) for k in keys])


def _f(rule: str, sev: float, cid: str = "contract_id") -> str:
    return _FLAG.format(rule=rule, sev=f"CAST({sev} AS DOUBLE)", cid=cid)


add(
    "rule_threshold_proximity",
    lambda c: _flat(R.threshold_proximity(c), "value", "threshold", "pct"),
    _f("threshold_proximity", 0.6) + ", price_numeric_eur AS value, 100000.0 AS threshold, 10.0 AS pct FROM c WHERE price_numeric_eur >= 90000 AND price_numeric_eur < 100000",
)
_R2 = """, v AS (SELECT buyer, supplier, sum(CAST(price_numeric_eur AS DECIMAL(18,2))) AS spend, min(seq) AS f FROM c WHERE supplier IS NOT NULL AND price_numeric_eur IS NOT NULL GROUP BY 1, 2),
 vr AS (SELECT *, row_number() OVER (PARTITION BY buyer ORDER BY spend DESC, f) AS rn, sum(spend) OVER (PARTITION BY buyer) AS total FROM v),
 vt AS (SELECT *, CAST(sum(spend) OVER (PARTITION BY buyer) AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS share FROM vr WHERE rn <= 3 AND total > 0) """
add(
    "rule_vendor_concentration",
    lambda c: _flat(R.vendor_concentration(c, 3, 10), "share_pct", "vendor_spend"),
    _R2 + _f("vendor_concentration", 0.5, "CAST(NULL AS VARCHAR)") + ", round(share, 1) AS share_pct, CAST(spend AS DOUBLE) AS vendor_spend FROM vt WHERE share > 10",
)
_R3 = ", x AS (SELECT *, count(*) OVER (PARTITION BY buyer, supplier) AS n, sum(CAST(price_numeric_eur AS DECIMAL(18,2))) OVER (PARTITION BY buyer, supplier) AS total FROM c WHERE supplier IS NOT NULL AND price_numeric_eur <= 50000) "
add("rule_fragmentation", lambda c: _flat(R.fragmentation(c), "count", "total"), _R3 + _f("fragmentation", 0.4) + ", CAST(n AS DOUBLE) AS count, CAST(total AS DOUBLE) AS total FROM x WHERE n >= 3")
_R4 = ", h AS (SELECT *, date_diff('hour', CAST(date_concluded AS TIMESTAMP), CAST(date_published AS TIMESTAMP)) AS hours FROM c) "
add(
    "rule_overnight_turnaround",
    lambda c: _flat(R.overnight_turnaround(c.withColumn("published_date", F.col("date_published")), 48), "hours"),
    _R4 + _f("overnight_turnaround", 0.3) + ", CAST(hours AS DOUBLE) AS hours FROM h WHERE hours >= 0 AND hours < 48",
)
_R5 = ", t AS (SELECT *, row_number() OVER (PARTITION BY supplier ORDER BY published_date, seq) AS rn FROM c WHERE supplier IS NOT NULL) "
add(
    "rule_new_vendor_large_contract",
    lambda c: _flat(R.new_vendor_large_contract(c), "value"),
    _R5 + _f("new_vendor_large_contract", 0.5) + ", price_numeric_eur AS value FROM t WHERE rn = 1 AND price_numeric_eur >= 100000",
)
_R6 = ", p6 AS (SELECT *, count(*) OVER () AS n6, 100.0 * count(*) FILTER (price_numeric_eur % 1000 = 0) OVER () / count(*) OVER () AS pct FROM c WHERE price_numeric_eur > 0) "
add(
    "rule_round_number_clustering",
    lambda c: _flat(R.round_number_clustering(c, min_round_pct=30), "value", "round_pct", "total"),
    _R6 + _f("round_number_clustering", 0.3) + ", price_numeric_eur AS value, round(pct, 1) AS round_pct, CAST(n6 AS DOUBLE) AS total FROM p6 WHERE price_numeric_eur % 1000 = 0 AND n6 >= 5 AND pct >= 30",
)
_ALL = [{"id": "threshold_proximity"}, {"id": "no_such_rule"}, {"id": "fragmentation"}, {"id": "new_vendor_large_contract"}, {"id": "round_number_clustering", "params": {"min_round_pct": 30}}]
_FLAGS = (
    _R3 + _R5 + _R6 + ", fl AS (" + _f("threshold_proximity", 0.6) + ", 0 AS rule_ord FROM c WHERE price_numeric_eur >= 90000 AND price_numeric_eur < 100000 UNION ALL " + _f("fragmentation", 0.4) + ", 2 FROM x WHERE n >= 3 UNION ALL "
    + _f("new_vendor_large_contract", 0.5) + ", 3 FROM t WHERE rn = 1 AND price_numeric_eur >= 100000 UNION ALL " + _f("round_number_clustering", 0.3) + ", 4 FROM p6 WHERE price_numeric_eur % 1000 = 0 AND n6 >= 5 AND pct >= 30) "
)
add("rules_all", lambda c: R.evaluate(c, _ALL).drop("details"), _FLAGS + "SELECT rule_id, severity, contract_id, vendor, institution, rule_ord FROM fl")
add(
    "rules_presets",
    lambda c: R.flag_counts(R.evaluate(c)),
    _R2.replace("rn <= 3", "rn <= 1") + _R3 + _R5 + """, f6 AS (SELECT 'threshold_proximity' AS rule_id FROM c WHERE price_numeric_eur >= 90000 AND price_numeric_eur < 100000 UNION ALL SELECT 'vendor_concentration' FROM vt WHERE share > 60 UNION ALL SELECT 'fragmentation' FROM x WHERE n >= 3
    UNION ALL SELECT 'overnight_turnaround' FROM c WHERE published_date = date_concluded UNION ALL SELECT 'new_vendor_large_contract' FROM t WHERE rn = 1 AND price_numeric_eur >= 100000) SELECT rule_id, count(*) AS n_flags FROM f6 GROUP BY 1""",
)
_SEV = "SELECT {k}, round(least(1.0, sum(severity)), 6) AS severity, count(*) AS n_flags FROM fl WHERE {k} IS NOT NULL GROUP BY 1"
add("severity_by_contract", lambda c: R.severity_by_contract(R.evaluate(c, _ALL)), _FLAGS + _SEV.format(k="contract_id"))
add("severity_by_vendor", lambda c: R.severity_by_vendor(R.evaluate(c, _ALL)), _FLAGS + _SEV.format(k="vendor"))
add(
    "flags_for_vendor",
    lambda c: R.flags_for(R.evaluate(c, _ALL), "vendor", "Supplier#000000007").drop("details"),
    _FLAGS + "SELECT rule_id, severity, contract_id, vendor, institution, rule_ord FROM fl WHERE vendor = 'Supplier#000000007'",
)
add("flag_counts", lambda c: R.flag_counts(R.evaluate(c, _ALL)), _FLAGS + "SELECT rule_id, count(*) AS n_flags FROM fl GROUP BY 1")
add(
    "contract_severities",
    lambda c: (lambda x: R.contract_severities(x, R.evaluate(x, [{"id": "threshold_proximity"}])))(P.apply(c, FilterState(date_from="1997-01-01"))),
    """SELECT contract_id, seq, CAST(0.6 AS DOUBLE) AS severity FROM c
    WHERE published_date >= '1997-01-01' AND price_numeric_eur >= 90000 AND price_numeric_eur < 100000""",
)
