"""Queries: dataset maintenance, scalar functions, chat context, page extraction, streaming."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.functions import text as X
from registra.functions.storage import settled, spread
from registra.operators import aggregates as A
from registra.operators import context as Q
from registra.operators import extraction as H
from registra.operators import filters as P
from registra.operators import maintenance as M
from registra.operators.filters import FilterState
from registra.sources import model, star
from registra.streaming import ingest as T

from .base import CAT, SPEND, SUMMARY, W, add, scratch

# ---------------------------------------------------------------- maintenance

_C = ["seq", "contract_id", "buyer", "supplier", "price_numeric_eur", "scanned_service_type"]
_old = lambda c: c.filter("seq % 3 <> 0").select(*_C)
#: Newer rows: some ids are known, some new, some fields blank, one scanned field different.
_new = lambda c: c.filter("seq % 2 = 0").select("seq", "contract_id", F.when(F.col("seq") % 4 == 0, F.lit(" ")).otherwise(F.concat("buyer", F.lit("*"))).alias("buyer"), "supplier", (F.col("price_numeric_eur") + 1).alias("price_numeric_eur"), F.lit("NEW").alias("scanned_service_type"))
_OLDNEW = """, old AS (SELECT seq, contract_id, buyer, supplier, price_numeric_eur, scanned_service_type FROM c WHERE seq % 3 <> 0),
 new AS (SELECT seq, contract_id, CASE WHEN seq % 4 = 0 THEN ' ' ELSE buyer || '*' END AS buyer, supplier, price_numeric_eur + 1 AS price_numeric_eur, 'NEW' AS scanned_service_type FROM c WHERE seq % 2 = 0)"""
add(
    "record_key",
    lambda c: (lambda x: x.select("seq", M.record_key(x)["kind"].alias("kind"), M.record_key(x)["value"].alias("value")))(c.withColumn("contract_id", F.when(F.col("seq") % 3 == 0, F.lit(" ")).otherwise(F.col("contract_id"))).withColumn("contract_url", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("u/"), F.col("seq").cast("string"))))),
    """SELECT seq, CASE WHEN seq % 3 <> 0 THEN 'id' WHEN seq % 2 = 0 THEN 'url' ELSE 'parts' END AS kind, CASE WHEN seq % 3 <> 0 THEN contract_id WHEN seq % 2 = 0 THEN 'u/' || seq ELSE '|' || published_date || '|' || buyer || '|' || coalesce(supplier, '') END AS value FROM c""",
)
add(
    "merge_contracts",
    lambda c: M.merge_contracts(_old(c), _new(c)).select("contract_id", "buyer", "supplier", "price_numeric_eur", "scanned_service_type", F.col("merged_ord._src").alias("source")),
    _OLDNEW + """
 SELECT coalesce(o1.contract_id, n.contract_id) AS contract_id, CASE WHEN n.buyer IS NOT NULL AND trim(n.buyer) <> '' THEN n.buyer ELSE coalesce(o1.buyer, n.buyer) END AS buyer, coalesce(n.supplier, o1.supplier) AS supplier,
 coalesce(n.price_numeric_eur, o1.price_numeric_eur) AS price_numeric_eur, coalesce(o1.scanned_service_type, n.scanned_service_type) AS scanned_service_type, CASE WHEN o1.contract_id IS NULL THEN 1 ELSE 0 END AS source FROM old o1 FULL JOIN new n ON o1.contract_id = n.contract_id""",
)
add(
    "merge_stats",
    lambda c: M.merge_stats(_old(c), _new(c)),
    _OLDNEW + """, b AS (SELECT o1.contract_id AS oid, n.contract_id AS nid, n.buyer AS nb, n.price_numeric_eur AS np, o1.scanned_service_type AS os FROM old o1 FULL JOIN new n ON o1.contract_id = n.contract_id)
 SELECT (SELECT count(*) FROM old) AS existing_before, (SELECT count(*) FROM new) AS incoming, count(*) FILTER (oid IS NULL) AS added, count(*) FILTER (oid IS NOT NULL AND nid IS NOT NULL AND (trim(nb) <> '' OR np IS NOT NULL OR os IS NULL)) AS updated, count(*) AS total_after FROM b""",
)
add(
    "append_new_contracts",
    lambda c: M.append_new(_old(c), _new(c).withColumn("contract_id", F.when(F.col("seq") % 10 == 0, F.lit("")).otherwise(F.col("contract_id")))).select("seq", "contract_id", "is_new"),
    _OLDNEW + " SELECT seq, contract_id, false AS is_new FROM old UNION ALL SELECT seq, CASE WHEN seq % 10 = 0 THEN '' ELSE contract_id END, true FROM new WHERE seq % 10 = 0 OR contract_id NOT IN (SELECT contract_id FROM old)",
)
add(
    "append_with_limit",
    lambda c: M.append_new(_old(c), _new(c), 100).filter("is_new").select("seq"),
    _OLDNEW + " SELECT seq FROM new WHERE contract_id NOT IN (SELECT contract_id FROM old) ORDER BY seq LIMIT 100",
)
add("anti_known_ids", lambda c: c.join(_old(c).select("contract_id"), "contract_id", "left_anti").select("seq"), "SELECT seq FROM c WHERE seq % 3 = 0")
add("union_contracts", lambda c: M.union_contracts(_old(c), _new(c).drop("supplier")).select("seq", "supplier"), _OLDNEW + " SELECT seq, supplier FROM old UNION ALL SELECT seq, NULL FROM new")
add("ordered_distinct", lambda c: M.ordered_distinct(c, "supplier"), "SELECT supplier, min(seq) AS first_seq FROM c GROUP BY 1")
add(
    "dedup_first",
    lambda c: M.dedup_first(c.select("seq", "buyer", "supplier", "price_numeric_eur"), ["buyer", "supplier"]),
    """, t AS (SELECT seq, buyer, supplier, price_numeric_eur, row_number() OVER (PARTITION BY buyer, supplier ORDER BY seq) AS rn FROM c)
    SELECT seq, buyer, supplier, price_numeric_eur FROM t WHERE rn = 1""",
)
#: A source field in each of its shapes, from the lines beyond the first.
def _field():
    own = F.when(F.col("seq") % 4 == 0, F.concat(F.lit('[{"name": "'), "supplier", F.lit('", "ico": "'), "ico_supplier", F.lit('"}, "'), "buyer", F.lit('", {"note": 1}]')))
    return own.when(F.col("seq") % 4 == 1, F.concat("supplier", F.lit("; ;"), "buyer")).when(F.col("seq") % 4 == 2, F.concat("supplier", F.lit(", x, ")))


_expanded = lambda c: M.expand_subcontractors(c.withColumn("scanned_subcontractors", _field())).select("seq", "contract_id", "sub_ord", "subcontractor", "ico_subcontractor")
_EXP = """, e AS (SELECT seq, contract_id, 0 AS sub_ord, supplier AS subcontractor, CASE WHEN seq % 4 = 0 THEN ico_supplier END AS ico_subcontractor FROM c WHERE seq % 4 < 3 AND supplier IS NOT NULL
 UNION ALL SELECT seq, contract_id, 1, CASE WHEN seq % 4 = 2 THEN 'x' ELSE buyer END, NULL FROM c WHERE seq % 4 < 3 AND supplier IS NOT NULL)"""
add("expand_subcontractors", _expanded, _EXP + " SELECT * FROM e")
add(
    "subcontractor_split",
    lambda c: c.withColumn("f", _field()).select("seq", F.size(M.subcontractor_items("f")).alias("n")),
    "SELECT seq, CASE WHEN seq % 4 < 3 AND supplier IS NOT NULL THEN 2 ELSE 0 END AS n FROM c",
)
add(
    "append_subcontractors",
    lambda c: (lambda e: M.append_subcontractors(e.filter("seq % 3 = 0"), e).select("seq", "subcontractor", "is_new"))(_expanded(c)),
    _EXP + " SELECT seq, subcontractor, false AS is_new FROM e WHERE seq % 3 = 0 UNION ALL SELECT seq, subcontractor, true FROM e WHERE seq % 3 <> 0",
)


def _legacy(p: DataFrame) -> DataFrame:
    """Parts as tenders of the old form: numbered part objects with all that they hold, some as a list, some not an object."""
    bidders = F.to_json(F.transform(F.sequence(F.lit(1), F.col("p_size") % 3 + 1), lambda i: F.struct(F.concat("p_brand", F.lit(" "), i.cast("string")).alias("name"), i.cast("string").alias("ico"), (F.col("p_retailprice") + i).alias("proposed_sum_eur"))))
    ai = F.to_json(F.struct(F.col("p_type").alias("winner"), F.concat(F.lit("ai "), "p_brand").alias("notes")))
    ten = F.concat(F.lit('{"notes": "own", "lot": '), F.col("p_size").cast("string"), F.lit(', "ai_extracted": '), ai, F.lit("}"))
    two = F.concat(F.lit('{"error": "'), "p_name", F.lit('", "participants": '), bidders, F.lit("}"))
    listed = F.create_map(F.lit("parts"), F.concat(F.lit('["no object", {"part_number": 7, "notes": "'), "p_name", F.lit('"}]')), F.lit("part_1"), two)
    keyed = F.create_map(F.lit("part_10"), ten, F.lit("part_2"), two, F.lit("part_3"), F.lit("[1]"), F.lit("title"), F.col("p_name"))
    return spread(p, "p_partkey").select(F.col("p_partkey").alias("tender_id"), F.when(F.col("p_partkey") % 5 == 0, listed).otherwise(keyed).alias("legacy"))


def _normalised(p: DataFrame) -> DataFrame:
    rows = M.normalise_parts(_legacy(p)).select("tender_id", F.explode("parts").alias("x"))
    return rows.select("tender_id", "x.part_number", "x.notes", "x.error", F.size(F.coalesce("x.participants", F.array())).alias("bidders"), F.try_element_at("x.fields", F.lit("winner")).alias("winner"), F.try_element_at("x.fields", F.lit("lot")).alias("lot"))


add("tender_parts_normalise", _normalised, """
SELECT p_partkey AS tender_id, 1 AS part_number, NULL AS notes, p_name AS error, p_size % 3 + 1 AS bidders, NULL AS winner, NULL AS lot FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 2, 'ai ' || p_brand, NULL, 0, p_type, CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 7, p_name, NULL, 0, NULL, NULL FROM part WHERE p_partkey % 5 = 0""", "part")
add("tender_bids_of_parts", lambda p: M.tender_bids(M.normalise_parts(_legacy(p))).select("tender_id", "part_number", "pos", "name", "ico", "proposed_sum_eur", "is_winner"), """
SELECT p_partkey AS tender_id, 1 AS part_number, i - 1 AS pos, p_brand || ' ' || i AS name, CAST(i AS VARCHAR) AS ico, p_retailprice + i AS proposed_sum_eur, i = 1 AS is_winner
FROM part, range(1, 4) t(i) WHERE p_partkey % 5 <> 0 AND i <= p_size % 3 + 1""", "part")
_bids = lambda p: p.select(F.col("p_partkey").alias("tender_id"), F.array(F.struct(F.lit(1).alias("part_number"), F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_retailprice").alias("proposed_sum_eur")), F.struct(F.lit("other").alias("name"), (F.col("p_retailprice") + 1).alias("proposed_sum_eur"))).alias("participants"))).alias("parts"))
add(
    "tender_bids",
    lambda p: M.tender_bids(_bids(p)),
    """SELECT p_partkey AS tender_id, 1 AS part_number, 0 AS pos, p_brand AS name, p_retailprice AS proposed_sum_eur, true AS is_winner FROM part UNION ALL
    SELECT p_partkey, 1, 1, 'other', p_retailprice + 1, false FROM part""",
    "part",
)


def _with_documents(p: DataFrame) -> DataFrame:
    """Parts as tenders with three documents each, titled by the part."""
    kinds = [
        F.concat(F.lit("Informácia o výsledku vyhodnotenia ponúk "), "p_brand"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_type"), F.lit(" - INFORMÁCIA O VÝSLEDKU VYHODNOTENIA PONÚK"))).otherwise(F.col("p_type")),
        F.col("p_name"),
    ]
    documents = F.array(*[F.struct(k.alias("document_type"), F.concat(F.lit(f"{i} "), "p_name").alias("title")) for i, k in enumerate(kinds)])
    return p.select(F.col("p_partkey").alias("tender_id"), documents.alias("documents"))


add(
    "result_documents",
    lambda p: M.result_documents(_with_documents(p)).select("tender_id", "result_document_count", F.array_join(F.transform("documents", lambda d: d["title"]), "; ").alias("titles")),
    """
SELECT p_partkey AS tender_id, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS result_document_count, '0 ' || p_name || CASE WHEN p_size % 2 = 0 THEN '; 1 ' || p_name ELSE '' END AS titles FROM part""",
    "part",
)
_work = lambda c: c.withColumns({"scanned_service_type": F.when(F.col("seq") % 5 == 0, F.col("scanned_service_type")), "pdf_text": F.when(F.col("seq") % 3 == 0, F.concat(F.lit("a  b\r\n\n c "), "pdf_text_summary")), "pdf_url": F.when(F.col("seq") % 2 == 0, F.lit("u")), "pdf_local_path": F.when(F.col("seq") % 7 < 3, F.lit("p"))})
_STATUS = "CASE WHEN seq % 5 = 0 AND scanned_service_type IS NOT NULL THEN 'skipped' WHEN seq % 3 = 0 AND pdf_text_summary IS NOT NULL THEN 'process' WHEN seq % 2 = 0 THEN 'fetch' ELSE 'skipped' END"
add("enrichment_worklist", lambda c: M.enrichment_worklist(_work(c)), f"SELECT {_STATUS} AS status, count(*) AS n FROM c GROUP BY 1")
add(
    "enrichment_requests",
    lambda c: M.enrichment_requests(_work(c)).select("seq", "text", F.length("taxonomy").alias("n_taxonomy")),
    f"""SELECT seq, 'abc ' || pdf_text_summary AS text, {len(chr(10).join(f'{k}: ' + ', '.join(v) for k, v in M.TAXONOMY.items()))} AS n_taxonomy FROM c
    WHERE {_STATUS} = 'process'""",
)
_types = list(M.TAXONOMY)
_firsts = [M.TAXONOMY[t][0] for t in _types]
_of = lambda names, c: F.when(F.col(c).isNotNull(), F.get(F.array(*map(F.lit, names)), F.col(c).cast("int") % len(names)))


def _taxed(c: DataFrame) -> DataFrame:
    """Contracts with a type by the supplier (or their own, which the taxonomy does not know) and a subtype by the buyer (or their own)."""
    kind = F.when(F.col("award_type") == "tendered", _of(_types, "ico_supplier")).when(F.col("award_type") == "direct_award", F.col("scanned_service_type"))
    sub = F.when(F.col("published_year") % 2 == 0, F.concat(F.lit(" "), _of(_firsts, "ico_buyer"), F.lit(" "))).otherwise(F.col("scanned_service_subtype"))
    return c.select("seq", kind.alias("service_type"), sub.alias("service_subtype"))


_pick = lambda names, c: "(['" + "', '".join(names) + f"'])[CAST({c} AS INTEGER) % {len(names)} + 1]"
add("service_taxonomy", lambda c: M.service_taxonomy(_taxed(c)), f""", x AS (SELECT seq, CASE WHEN award_type = 'tendered' THEN {_pick(_types, 'ico_supplier')} END AS t,
 CASE WHEN CAST(published_year AS INTEGER) % 2 = 0 THEN {_pick(_firsts, 'ico_buyer')} END AS s, CASE WHEN CAST(published_year AS INTEGER) % 2 = 0 THEN {_pick(_types, 'ico_buyer')} END AS o FROM c)
 SELECT seq, coalesce(t, o) AS service_type, CASE WHEN t IS NULL OR t = o THEN s END AS service_subtype FROM x""")
_resp = lambda c: c.filter("seq % 2 = 0").select("seq", F.to_json(F.struct(F.lit(_types[0]).alias("service_type"), F.lit("zzz").alias("service_subtype"), F.col("buyer").alias("summary"), F.col("price_numeric_eur").alias("contract_value"))).alias("response"))
add(
    "apply_scanned_fields",
    lambda c: M.apply_scanned_fields(c, _resp(c)).select("seq", "scanned_service_type", "scanned_service_subtype", "scanned_summary", "scanned_contract_value"),
    f"""SELECT seq, CASE WHEN seq % 2 = 0 THEN '{_types[0]}' ELSE scanned_service_type END AS scanned_service_type, CASE WHEN seq % 2 <> 0 THEN scanned_service_subtype END AS scanned_service_subtype, CASE WHEN seq % 2 = 0 THEN buyer END AS scanned_summary, CASE WHEN seq % 2 = 0 THEN price_numeric_eur END AS scanned_contract_value
    FROM c""",
)
add(
    "unreadable_text_candidates",
    lambda c: M.unreadable_candidates(_work(c)),
    "SELECT count(*) AS total, count(*) FILTER (seq % 7 < 3) AS candidates, count(*) FILTER (seq % 7 >= 3) AS skipped FROM c",
)
add(
    "contract_tender_join",
    lambda s, d: M.contract_tender_join(star.contracts(s, d), star.tenders(s, d)).select("seq", F.col("tender.subject_name").alias("subject_name"), F.col("tender.estimated_value").alias("estimated_value")),
    W + "SELECT c.seq, p_name AS subject_name, p_retailprice AS estimated_value FROM c LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = public_procurement_id",
    "",
)

# ---------------------------------------------------------------- scalar functions

_price = lambda: F.translate(F.concat(F.format_number("price_numeric_eur", 2), F.lit(" €")), ",.", " ,")
add(
    "parse_price",
    lambda c: c.select("seq", X.parse_price(F.when(F.col("seq") % 11 == 0, F.lit("dohodou")).otherwise(_price())).alias("price")),
    "SELECT seq, CASE WHEN seq % 11 <> 0 THEN CAST(CAST(price_numeric_eur AS DECIMAL(18,2)) AS DOUBLE) END AS price FROM c",
)
_months = "január február marec apríl Máj jún júl august september Október november december".split()
add(
    "parse_slovak_date",
    lambda c: c.select("seq", X.parse_slovak_date(F.concat(F.substring("published_date", 9, 2), F.lit(".")), F.element_at(F.array(*map(F.lit, _months)), F.substring("published_date", 6, 2).cast("int")), F.when(F.col("seq") % 13 == 0, F.lit("x")).otherwise(F.substring("published_date", 1, 4))).alias("day")),
    "SELECT seq, CASE WHEN seq % 13 <> 0 THEN published_date END AS day FROM c",
)
add(
    "parse_dotted_date",
    lambda c: c.select("seq", X.parse_dotted_date(F.when(F.col("seq") % 5 == 0, F.lit("neuvedený")).otherwise(F.date_format(F.col("published_date").cast("date"), "d.M.yyyy"))).alias("day")),
    "SELECT seq, CASE WHEN seq % 5 <> 0 THEN published_date END AS day FROM c",
)
_doc = lambda f, name: lambda d: d.select("doc_id", f(F.col("text")).alias(name))
add(
    "normalize_text",
    _doc(lambda t: F.sha2(X.normalize_text(t), 256), "h"),
    "SELECT doc_id, sha256(lower(regexp_replace(strip_accents(text), '^\\s+|\\s+$', '', 'g'))) AS h FROM documents",
    "documents",
)
add("clean_whitespace", _doc(lambda t: F.sha2(X.clean_whitespace(t), 256), "h"), "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents", "documents")
add(
    "snake_case",
    lambda c: c.select("seq", X.snake_case(F.concat_ws(" / ", "contract_title", "buyer")).alias("s")),
    "SELECT seq, coalesce(nullif(trim(regexp_replace(lower(concat_ws(' / ', contract_title, buyer)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'field') AS s FROM c",
)
_WORD = "[\\p{L}\\p{M}\\p{N}_]"
add("clean_text", _doc(lambda t: F.sha2(X.clean_text(t), 256), "h"), f"""
WITH e AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '\\n{{2,}}', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g') AS t FROM documents),
 k AS (SELECT doc_id, t, regexp_extract_all(t, '\\S+|\\s+') AS ks FROM e)
SELECT doc_id, sha256(regexp_replace(coalesce(array_to_string(list_transform(ks, lambda x, i: CASE WHEN regexp_matches(x, '^\\s') AND i > 1 AND i < len(ks)
 AND regexp_matches(ks[i - 1], '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){_WORD}$') AND regexp_matches(ks[i + 1], '^{_WORD}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') THEN '' ELSE x END), ''), t), '^\\s+|\\s+$', '', 'g')) AS h FROM k""", "documents")
add(
    "safe_filename",
    lambda p: p.select("page_id", X.safe_filename(F.col("url")).alias("name")),
    "SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '._') AS name FROM pages",
    "pages",
)
add("is_readable_text", _doc(lambda t: X.is_readable(t), "ok"), "SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) >= 30 AS ok FROM documents", "documents")
add("truncate_text", _doc(lambda t: F.sha2(X.truncate(t, 500), 256), "h"), "SELECT doc_id, sha256(substring(text, 1, 500)) AS h FROM documents", "documents")
add(
    "sanitise_message",
    lambda m: m.select("conv_id", "turn", "role", F.sha2(F.coalesce(X.sanitise_message(F.concat(F.lit("\x01 "), "text")), F.lit("")), 256).alias("h")),
    "SELECT conv_id, turn, role, sha256(regexp_replace(substring(' ' || text, 1, 4000), '^\\s+|\\s+$', '', 'g')) AS h FROM conversations",
    "conversations",
)
add(
    "token_cost",
    lambda m: m.select("conv_id", "turn", "role", X.token_estimate(F.col("text")).alias("tokens"), X.token_cost(X.token_estimate(F.col("text")), F.lit(100)).alias("cost")),
    "SELECT conv_id, turn, role, length(text) // 4 AS tokens, CAST((length(text) // 4 * 15 + 100 * 60 + 50) // 100 AS DOUBLE) / 1000000 AS cost FROM conversations",
    "conversations",
)
add(
    "mentioned_years",
    lambda c: c.select("seq", F.posexplode(X.mentioned_years(F.concat(F.lit("rok 2015, 12016 a "), "published_date", F.lit(" 20155")))).alias("pos", "year")),
    "SELECT seq, 0 AS pos, '2015' AS year FROM c",
)
_tender = lambda: F.concat(F.lit("https://x.sk/sk/"), F.when(F.col("page_id") % 3 == 0, "tender/").when(F.col("page_id") % 3 == 1, "zakazka/detail/").otherwise("a/77/b/"), F.col("page_id").cast("string"), F.lit("/summary?id=99"))
add(
    "procurement_id",
    lambda p: p.select("page_id", X.procurement_id(_tender()).alias("id"), X.procurement_id(F.col("url")).alias("own")),
    """SELECT page_id, CAST(page_id AS VARCHAR) AS id, nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*', ''), '^[a-z]+://[^/]*', ''), '(\\d+)\\D*$', 1), '') AS own
    FROM pages""",
    "pages",
)
_summary_url = lambda: F.concat(F.lit("HTTPS://josephine.proebiz.com/sk/tender/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "/summary/").otherwise("/documents"))
add(
    "is_tender_summary_url",
    lambda p: p.select("page_id", X.is_tender_summary(_summary_url()).alias("ok"), X.is_tender_summary(F.col("url")).alias("own")),
    "SELECT page_id, page_id % 2 = 0 AS ok, false AS own FROM pages",
    "pages",
)
_portal = lambda: F.concat(F.when(F.col("page_id") % 2 == 0, "https://uvo.gov.sk").otherwise("https://other.sk"), F.lit("/vyhladavanie/vyhladavanie-zakaziek/detail/dokumenty/"), F.col("page_id").cast("string"), F.lit("?a=1#x"))
add(
    "canonical_tender_url",
    lambda p: p.select("page_id", X.canonical_tender_url(_portal()).alias("u")),
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.uvo.gov.sk/vyhladavanie/vyhladavanie-zakaziek/detail/' || page_id || '?a=1' END AS u FROM pages",
    "pages",
)
add(
    "documents_url",
    lambda p: p.select("page_id", X.documents_url(F.concat(F.lit("https://www.uvo.gov.sk/vyhladavanie/vyhladavanie-zakaziek/detail/"), F.col("page_id").cast("string"), F.lit("?d=1"))).alias("u")),
    "SELECT page_id, 'https://www.uvo.gov.sk/vyhladavanie/vyhladavanie-zakaziek/dokumenty/' || page_id || '?d=1' AS u FROM pages",
    "pages",
)
add(
    "listing_url",
    lambda p: p.select("page_id", X.listing_url(F.lit("https://r.sk/list/?page=1&art=2"), F.col("page_id"), {"q": "a b", "art": None}).alias("u")),
    "SELECT page_id, 'https://r.sk/list/?page=' || page_id || '&art=2&q=a+b' AS u FROM pages",
    "pages",
)
add(
    "url_id",
    lambda p: p.select("page_id", X.url_id(F.concat(F.lit("https://r.sk/zmluva/"), F.col("page_id").cast("string"), F.lit("/"))).alias("id"), X.url_id(F.col("url")).alias("own")),
    "SELECT page_id, CAST(page_id AS VARCHAR) AS id, nullif(regexp_extract(url, '/zmluva/(\\d+)/', 1), '') AS own FROM pages",
    "pages",
)
add(
    "cpv_entries",
    lambda p: p.select("p_partkey", F.explode(X.cpv_entries(F.concat(F.lit("45000000-7 - "), "p_brand", F.lit("  72000000-5 - "), "p_type"))).alias("e")).select("p_partkey", "e.code", "e.name"),
    "SELECT p_partkey, '45000000-7' AS code, p_brand AS name FROM part UNION ALL SELECT p_partkey, '72000000-5', p_type FROM part",
    "part",
)
add(
    "json_recover",
    lambda e: e.select("event_id", F.get_json_object(X.json_recover(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(F.col("event_type").alias("k"))), F.lit("\n```"))).otherwise(F.lit("nothing"))), "$.k").alias("k")),
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS k FROM events",
    "events",
)

# ---------------------------------------------------------------- chat context

_messages = lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("message_id"), F.concat("text", F.lit(" a NATION_"), (F.col("conv_id") % 25).cast("string"), F.lit(" Building z roku "), (2009 + F.col("turn")).cast("string")).alias("text"))
_MSG = ", m AS (SELECT concat_ws('-', conv_id, turn, role) AS message_id, text || ' a NATION_' || (conv_id % 25) || ' Building z roku ' || (2009 + turn) AS text FROM conversations)"
_scope = FilterState(institutions=["NATION_6 BUILDING"], date_from="2011-05-01", date_to="2012-01-01")
_ENT = ", ent AS (SELECT DISTINCT message_id, 'institution' AS kind, buyer AS name FROM m JOIN (SELECT DISTINCT buyer FROM c) b ON contains(lower(text), lower(buyer)) WHERE buyer <> 'NATION_6 BUILDING')"
_YEAR = ", y AS (SELECT message_id, unnest(regexp_extract_all(text, '\\b(20[12]\\d)\\b', 1)) AS ys, unnest(range(len(regexp_extract_all(text, '\\b(20[12]\\d)\\b', 1)))) AS pos FROM m), yr AS (SELECT message_id, pos, CAST(ys AS BIGINT) AS year, CASE WHEN CAST(ys AS INTEGER) < 2011 THEN 'before' ELSE 'after' END AS side, CASE WHEN CAST(ys AS INTEGER) < 2011 THEN ys || '-01-01' ELSE ys || '-12-31' END AS suggestion FROM y WHERE CAST(ys AS INTEGER) < 2011 OR CAST(ys AS INTEGER) > 2012)"
add("scope_entity_refusals", lambda s, d: Q.entity_refusals(_messages(s, d), star.contracts(s, d), _scope), W + _MSG + _ENT + " SELECT * FROM ent", "")
add("scope_year_refusals", lambda s, d: Q.year_refusals(_messages(s, d), _scope), W + _MSG + _YEAR + " SELECT * FROM yr", "")
add(
    "scope_refusals",
    lambda s, d: Q.refusals(_messages(s, d), star.contracts(s, d), _scope).select("message_id", "reason", F.size("suggestions").alias("n"), "hint"),
    W + _MSG + _ENT + _YEAR + """, allr AS (SELECT message_id, 0 AS o, 0 AS pos, name AS by_, 'Institution "' || name || '" is not in the current filter scope.' AS reason, 'institutions=' || name AS hint FROM ent
 UNION ALL SELECT message_id, 2, pos, side, 'Year ' || year || CASE side WHEN 'before' THEN ' is before the filter start date (2011-05-01).' ELSE ' is after the filter end date (2012-01-01).' END, NULL FROM yr)
 SELECT message_id, string_agg(reason, ' ' ORDER BY o, pos, by_) AS reason, count(*) AS n, coalesce(string_agg(hint, '&' ORDER BY o, pos, by_), '') AS hint FROM allr GROUP BY 1""",
    "",
)
add(
    "chat_last_n",
    lambda m: P.last_of_session(m, 10).select("conv_id", "turn", "role"),
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations)
    SELECT conv_id, turn, role FROM t WHERE rn <= 10""",
    "conversations",
)
_slim = lambda c: c.select("seq", "contract_id", "contract_title", "buyer", "supplier", "price_numeric_eur", "published_date", "scanned_service_type", "award_type", "ico_supplier")
_KINDS = "SELECT section, count(*) AS n, count(DISTINCT ord) AS ords FROM ({}) GROUP BY 1"
add(
    "scoped_context_sections",
    lambda c: Q.scoped_context(_slim(P.apply(c, FilterState(date_from="1996-01-01")))).groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ord").alias("ords")),
    """SELECT * FROM (VALUES ('summary', 5, 5), ('contract', 20, 20), ('remainder', 1, 1), ('reference', 50, 50)) v(section, n, ords) UNION ALL
    SELECT 'category', count(DISTINCT coalesce(scanned_service_type, 'Nezaradené')), count(DISTINCT coalesce(scanned_service_type, 'Nezaradené')) FROM c
    WHERE published_date >= '1996-01-01'""",
)
#: How a contract is printed in full: what each field is called, and what it holds.
_PRINTED = {
    "Contract ID [contract_id]": "contract_id",
    "Title [contract_title]": "contract_title",
    "Buyer [buyer]": "buyer",
    "Supplier [supplier]": "supplier",
    "Price in EUR (numeric) [price_numeric_eur]": "format('{:,.2f}', price_numeric_eur) || ' EUR'",
    "Published date (normalized) [published_date]": "published_date",
    "Scanned service type [scanned_service_type]": "scanned_service_type",
    "Award type [award_type]": "award_type",
    "Supplier ICO [ico_supplier]": "ico_supplier",
}
_BLOCK = " || chr(10) || ".join(f"'{label}: ' || coalesce({value}, 'not extracted')" for label, value in _PRINTED.items())
add(
    "scoped_context_texts",
    lambda c: Q.scoped_context(_slim(P.apply(c, FilterState(date_from="1996-01-01")))).filter("section <> 'summary'"),
    f""", t AS (SELECT *, row_number() OVER (ORDER BY coalesce(price_numeric_eur, 0.0) DESC, seq) AS rn FROM c WHERE published_date >= '1996-01-01'),
 g AS (SELECT {CAT} AS k, count(*) AS n, {SPEND} AS t, row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS ord FROM t GROUP BY 1)
 SELECT 'category' AS section, ord, k || ': ' || n || ' contracts, ' || format('{{:,.2f}}', t) || ' EUR' AS text FROM g
 UNION ALL SELECT 'contract', rn, {_BLOCK} FROM t WHERE rn <= 20
 UNION ALL SELECT 'remainder', 0, 'Remaining contracts total: ' || format('{{:,.2f}}', {SPEND}) || ' EUR' FROM t WHERE rn > 20
 UNION ALL SELECT 'reference', rn, '- ' || contract_id || ' | ' || coalesce(supplier, '?') || ' | ' || coalesce(buyer, '?') || ' | ' || format('{{:,.2f}}', coalesce(price_numeric_eur, 0.0)) || ' EUR' FROM t WHERE rn BETWEEN 21 AND 70""",
)
add(
    "scoped_context_summary",
    lambda c: Q.scoped_context(_slim(P.apply(c, FilterState(date_from="1996-01-01")))).filter("section = 'summary'").select("ord", "text"),
    f""", a AS (SELECT {SUMMARY}, min(published_date) AS d0, max(published_date) AS d1 FROM c WHERE published_date >= '1996-01-01')
 SELECT 0 AS ord, 'Contracts in scope: ' || contract_count AS text FROM a UNION ALL SELECT 1, 'Total value: ' || format('{{:,.2f}}', total_spend) || ' EUR' FROM a UNION ALL SELECT 2, 'Average value: ' || format('{{:,.2f}}', avg_value) || ' EUR' FROM a UNION ALL SELECT 3, 'Maximum value: ' || format('{{:,.2f}}', max_value) || ' EUR' FROM a UNION ALL SELECT 4, 'Date range: ' || d0 || ' to ' || d1 FROM a""",
)
add(
    "scoped_context_small",
    lambda c: Q.full_contracts(_slim(P.apply(c, FilterState(institutions=["NATION_6 BUILDING"], date_from="2001-01-01")))).select("ord", F.substring_index("text", "\n", 1).alias("first_line")),
    """, t AS (SELECT contract_id, row_number() OVER (ORDER BY seq) AS ord FROM c WHERE buyer = 'NATION_6 BUILDING' AND published_date >= '2001-01-01')
    SELECT ord, 'Contract ID [contract_id]: ' || contract_id AS first_line FROM t WHERE (SELECT count(*) FROM t) <= 100""",
)
add("contract_context_sections", lambda s, d: _contexts(s, d).select("contract_id", "section", "ord"), W + """, h AS (SELECT c.contract_id, p_partkey FROM c LEFT JOIN part ON p_partkey = seq)
SELECT contract_id, 'fields' AS section, 0 AS ord FROM h UNION ALL SELECT contract_id, 'note', 0 FROM h WHERE p_partkey IS NULL UNION ALL SELECT contract_id, 'tender', 0 FROM h WHERE p_partkey IS NOT NULL
UNION ALL SELECT contract_id, 'documents', i FROM h, range(3) t(i) WHERE p_partkey IS NOT NULL UNION ALL SELECT contract_id, 'parts', i FROM h, range(2) t(i) WHERE p_partkey IS NOT NULL AND (i = 0 OR p_partkey % 5 <> 0)""", "")


def _contexts(s: SparkSession, d: str) -> DataFrame:
    """Every contract's context, with a tender of the contract's number where there is a part of it."""
    p = s.read.parquet(f"{d}/part.parquet")
    named = p.select(F.col("p_partkey").alias("tender_id"), F.col("p_name").alias("subject_name"))
    tenders = M.normalise_parts(_legacy(p)).join(_with_documents(p).hint("merge"), "tender_id").join(named.hint("merge"), "tender_id")
    return Q.contract_context(M.contract_tender_join(_slim(star.contracts(s, d)).withColumn("public_procurement_id", F.col("contract_id")), tenders))


#: The same over all contracts, with every section's text.
add("contract_context_all", lambda s, d: _contexts(s, d).select("contract_id", "section", "ord", F.sha2("text", 256).alias("h")), W + """,
x AS (SELECT contract_id, 'fields' AS section, 0 AS ord, 'Contract ID [contract_id]: ' || contract_id || chr(10) || 'Title [contract_title]: ' || coalesce(contract_title, 'not extracted') || chr(10) || 'Buyer [buyer]: ' || buyer || chr(10)
  || 'Supplier [supplier]: ' || coalesce(supplier, 'not extracted') || chr(10) || 'Price in EUR (numeric) [price_numeric_eur]: ' || coalesce(format('{:,.2f}', price_numeric_eur) || ' EUR', 'not extracted') || chr(10)
  || 'Published date (normalized) [published_date]: ' || published_date || chr(10) || 'Scanned service type [scanned_service_type]: ' || coalesce(scanned_service_type, 'not extracted') || chr(10) || 'Award type [award_type]: ' || award_type || chr(10)
  || 'Supplier ICO [ico_supplier]: ' || coalesce(ico_supplier, 'not extracted') || chr(10) || 'Public procurement id [public_procurement_id]: ' || contract_id AS text FROM c
 UNION ALL SELECT contract_id, 'note', 0, 'Note: contract has public_procurement_id=' || contract_id || ' but no matching tender record was found.' FROM c WHERE seq NOT IN (SELECT p_partkey FROM part)
 UNION ALL SELECT contract_id, 'tender', 0, 'Tender id [tender_id]: ' || p_partkey || chr(10) || 'Subject name [subject_name]: ' || p_name FROM c JOIN part ON p_partkey = seq
 UNION ALL SELECT contract_id, 'documents', i, '  Document ' || (i + 1) || ':' || chr(10) || '    document_type: ' || CASE i WHEN 0 THEN 'Informácia o výsledku vyhodnotenia ponúk ' || p_brand WHEN 1 THEN p_type || CASE WHEN p_size % 2 = 0 THEN ' - INFORMÁCIA O VÝSLEDKU VYHODNOTENIA PONÚK' ELSE '' END ELSE p_name END
  || chr(10) || '    title: ' || i || ' ' || p_name FROM c JOIN part ON p_partkey = seq, range(3) t(i)
 UNION ALL SELECT contract_id, 'parts', 0, '  ─── Part 7 ───' || chr(10) || '    Notes: ' || p_name FROM c JOIN part ON p_partkey = seq WHERE p_partkey % 5 = 0
 UNION ALL SELECT contract_id, 'parts', 0, '  ─── Part 1 ───' || chr(10) || '    error: ' || p_name || chr(10) || '    Participants (' || (p_size % 3 + 1) || '):' || chr(10)
  || array_to_string(list_transform(range(1, p_size % 3 + 2), lambda i: '      ' || i || '. ' || p_brand || ' ' || i || ' (ICO: ' || i || ') — proposed: ? (' || (p_retailprice + i) || ' EUR)'), chr(10)) FROM c JOIN part ON p_partkey = seq WHERE p_partkey % 5 <> 0
 UNION ALL SELECT contract_id, 'parts', 1, '  ─── Part 2 ───' || chr(10) || '    lot: ' || p_size || chr(10) || '    winner: ' || p_type || chr(10) || '    Notes: ai ' || p_brand FROM c JOIN part ON p_partkey = seq WHERE p_partkey % 5 <> 0)
SELECT contract_id, section, ord, sha256(text) AS h FROM x""", "")

# ---------------------------------------------------------------- pages

add("page_title", H.page_title, "SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS page_title FROM pages", "pages")
add(
    "page_links",
    H.page_links,
    """SELECT page_id, pos AS ord, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN split_part(url, ':', 1) || ':' || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href ELSE regexp_extract(regexp_replace(url, '[?#].*', ''), '^(.*/)', 1) || href END AS link
 FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1)))) AS pos FROM pages)""",
    "pages",
)
#: Register and tender pages are not among the given ones. They are written here out of each given page: its title, its links and
#: the page itself behind them, so that every answer depends on the whole ``html``.
_BASE = "https://www.crz.gov.sk"


def _page(*parts: str, each: str | None = None, end: str = "") -> Callable[[DataFrame], DataFrame]:
    """Pages of a template: {id}, {title}, {first} (the first link), {size} (length of the title), {n} (number of links); ``each`` is repeated for each link ({link}, {i}).

    Given titles are cut at a length, some of them inside a character reference. What is left of it is text, so its ampersand is written as one:
    before a tag HTML reads "&amp" as a reference even without its semicolon.
    """

    def fill(text: str, values: dict) -> Column:
        pieces = re.split(r"\{(\w+)\}", text)
        return F.concat(*[F.lit(x) if i % 2 == 0 else values[x] for i, x in enumerate(pieces)])

    def run(pages: DataFrame) -> DataFrame:
        links = F.regexp_extract_all("html", F.lit(r'<a\b[^>]*\bhref="([^"]*)"'), F.lit(1))
        title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
        values = {"id": F.col("page_id").cast("string"), "title": F.regexp_replace(title, r"&(?!#?\w+;)", "&amp;"), "first": F.coalesce(F.get(links, F.lit(0)), F.lit("")), "size": F.length(title).cast("string"), "n": F.size(links).cast("string"), "month": (F.col("page_id") % 12 + 1).cast("string"), "year": (2000 + F.length(title) % 25).cast("string")}
        rows = F.array_join(F.transform(links, lambda x, i: fill(each, values | {"link": x, "i": i.cast("string")})), "") if each else F.lit("")
        return spread(pages, "page_id").select("page_id", "url", F.concat(fill("".join(parts), values), rows, F.lit(end), "html").alias("html"))

    return run


_LIST = _page(
    '<table class="table_list"><tbody><tr><td>short</td></tr>',
    each='<tr><td><span class="d-block">3.</span><span class="d-block">Marec</span><span class="d-block">{year}</span></td><td><a href="/zmluva/{id}0{i}/">{title}</a><span>{link}</span></td><td>{size} 0{i},50 €</td><td>{link}</td><td>{title}</td></tr>',
    end="</tbody></table>",
)
_DETAIL = _page(
    '<div class="card"><h2 class="card-header">Identifikácia zmluvy</h2><div class="card-body"><ul><li><strong>Č. zmluvy:</strong> <span>{id}</span></li>',
    "<li><strong>Objednávateľ:</strong><span>{title}</span></li><li><strong>IČO:</strong><span>{size}</span></li><li><strong>Dodávateľ:</strong> {first} </li><li><strong>IČO:</strong><span>{n}</span></li>",
    "<li><strong>Verejné obstarávanie:</strong><a href='https://x.sk/sk/tender/{id}{first}/summary'>{title}</a></li></ul></div></div>",
    "<div class='card'><h2 class='card-header'>Dátumy</h2><div class='card-body'><ul><li><strong>Dátum zverejnenia:</strong><span class='col-auto'>{n}.{month}.{year}</span></li><li><strong>Dátum účinnosti:</strong><span>neuvedený</span></li></ul></div></div>",
    "<div class='card'><h2 class='card-header'>Príloha</h2><div class='card-body'><a href='/y.doc'>y</a>",
    each="<a href='{link}.PDF'>x</a>",
    end="</div></div>",
)
_TENDER = _page(
    "<h2>Informácie</h2><dl><dt>ID zákazky</dt><dd>{id}</dd><dt>Niečo iné</dt><dd>{title}</dd></dl><h2>Termíny</h2><dl><dt>Lehota na predkladanie ponúk</dt><dd>{first}</dd></dl><h2>Dokumenty</h2><table><tbody><tr><td>1</td></tr>",
    each="<tr><td><span class='file-icon' title='no'></span><span title='{link}  {i}'>{link}</span></td><td>{title}</td><td>{size} kB</td><td>{id}</td><td><a href='{link}'><span class='icon external-link'></span></a></td></tr>",
    end="</tbody></table>",
)
_P2 = _page(
    "<main><table><tr><th>Názov zákazky:</th><td>{title}</td></tr><tr><th>Iný údaj</th><td>{first}</td></tr></table></main><table><thead><tr><th>Druh dokumentu</th></tr></thead><tbody>",
    each="<tr onclick=\"window.location.href='{link}'\"><td>{id}</td><td>{link}</td><td>{i}</td><td>{title}</td></tr>",
    end="</tbody></table>",
)
_PG = """WITH pg AS (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t0, length(t0) AS size, trim(regexp_replace(replace(replace(t0, '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS t,
  regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1) AS ls, coalesce(ls[1], '') AS l1, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site FROM pages),
 lk AS (SELECT *, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM pg) """
add(
    "listing_rows",
    lambda p: H.listing_rows(_LIST(p), _BASE).select("page_id", "published_date", "contract_title", "contract_number", "price_numeric_eur", "supplier", "buyer", "contract_url", "contract_id"),
    _PG + """
SELECT page_id, (2000 + size % 25) || '-03-03' AS published_date, t AS contract_title, l AS contract_number, CAST(size || '0' || i || '.5' AS DOUBLE) AS price_numeric_eur, l AS supplier, t AS buyer,
 'https://www.crz.gov.sk/zmluva/' || page_id || '0' || i || '/' AS contract_url, page_id || '0' || i AS contract_id FROM lk""",
    "pages",
)
add(
    "detail_identification",
    lambda p: H.detail_identification(H.label_values(_DETAIL(p)), _BASE).select("page_id", "contract_number_detail", "buyer_detail", "supplier_detail", "ico_buyer", "ico_supplier"),
    _PG + """
SELECT page_id, CAST(page_id AS VARCHAR) AS contract_number_detail, t AS buyer_detail, nullif(l1, '') AS supplier_detail, CAST(size AS VARCHAR) AS ico_buyer, CAST(len(ls) AS VARCHAR) AS ico_supplier FROM pg""",
    "pages",
)
add("detail_dates", lambda p: H.detail_dates(H.label_values(_DETAIL(p))).select("page_id", "date_published", "date_effective"), _PG + """
SELECT page_id, (2000 + size % 25) || '-' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(len(ls) AS VARCHAR), 2, '0') AS date_published, CAST(NULL AS VARCHAR) AS date_effective FROM pg""", "pages")
add("detail_attachments", lambda p: H.detail_attachments(_DETAIL(p), _BASE).select("page_id", "pdf_url", F.array_join("pdf_urls", " ").alias("pdf_urls")), _PG + """
SELECT page_id, 'https://www.crz.gov.sk' || l1 || '.PDF' AS pdf_url, array_to_string(list_transform(ls, lambda x: 'https://www.crz.gov.sk' || x || '.PDF'), ' ') AS pdf_urls FROM pg WHERE len(ls) > 0""", "pages")
add("detail_procurement_link", lambda p: H.detail_procurement_link(H.label_values(_DETAIL(p)), _BASE), _PG + """
SELECT page_id, 'https://x.sk/sk/tender/' || page_id || l1 || '/summary' AS public_procurement_url, CAST(page_id AS VARCHAR) AS public_procurement_id, t AS public_procurement_portal FROM pg""", "pages")
add(
    "canonical_listing_url",
    lambda p: H.canonical_listing_url(_page('<form class="f" id="frm_filter_3" action="/list{first}">')(p), _BASE),
    _PG + "SELECT page_id, 'https://www.crz.gov.sk/list' || l1 AS listing_url FROM pg",
    "pages",
)
add("tender_sections", lambda p: H.tender_sections(_TENDER(p)), _PG + """
SELECT page_id, s AS section, f AS field, CASE v WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN t ELSE l1 END AS value FROM pg, (VALUES ('info', 'notice_id', 0), ('info', 'info_nieco_ine', 1), ('term', 'offer_submission_deadline', 2)) x(s, f, v)""", "pages")
add("tender_documents", lambda p: H.tender_documents(_TENDER(p)), _PG + """
SELECT page_id, l AS document_name, l || ' ' || i AS document_title, t AS document_type, size || ' kB' AS file_size, CAST(page_id AS VARCHAR) AS uploaded_at, true AS is_external_link, site || l AS link FROM lk""", "pages")
add(
    "portal2_detail",
    lambda p: H.portal2_detail(_P2(p)),
    _PG + "SELECT page_id, f AS field, CASE v WHEN 0 THEN t ELSE l1 END AS value FROM pg, (VALUES ('subject_name', 0), ('info_iny_udaj', 1)) x(f, v)",
    "pages",
)
add(
    "portal2_documents",
    lambda p: H.portal2_documents(_P2(p)).select("page_id", "document_name", "document_type", "uploaded_at", "link"),
    _PG + "SELECT page_id, l AS document_name, CAST(page_id AS VARCHAR) AS document_type, t AS uploaded_at, site || l AS link FROM lk",
    "pages",
)
add(
    "portal2_file_meta",
    lambda p: H.portal2_file_meta(_page("<td>Názov súboru: {title}<br>Veľkosť: {size} kB<a href='{first}'>x</a></td>")(p)),
    _PG + "SELECT page_id, t AS document_title, size || ' kB' AS file_size, l1 AS download_link FROM pg",
    "pages",
)

# ---------------------------------------------------------------- files


def _rich(c: DataFrame) -> DataFrame:
    """Contracts with two fields that the schema does not know."""
    extra = F.create_map(F.lit("lot"), (F.col("seq") % 7).cast("string"), F.lit("scanned_note"), F.col("buyer"))
    return c.select(*_CORE, "published_date", extra.alias("extra"))


_CORE = ["seq", "contract_id", "contract_title", "buyer", "supplier", "price_numeric_eur", "category", "award_type"]
_LOADED = ["contract_id", "contract_title", "buyer", "supplier", "price_numeric_eur", "category", "pdf_text_summary", "award_type"]
_LOADED_SQL = "SELECT contract_id, contract_title, buyer, supplier, price_numeric_eur, category, 'not_summarized' AS pdf_text_summary, award_type"


def load_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    model.write_json_arrays(_rich(star.contracts(spark, sf_dir)), folder)
    return model.load_contracts(spark, folder)


def _to_lines(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Contracts one JSON object a line, after every seventh a line that is none."""
    rows = star.contracts(spark, sf_dir)
    bad = F.when(F.col("seq") % 7 == 0, F.array(F.lit("not json"), F.lit(" "), F.lit("[1]"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.to_json(F.struct(*[c for c in _CORE if c != "seq"], (F.col("seq") % 7).alias("lot")))), bad)
    rows.select(F.explode(lines).alias("value")).write.text(folder)


def load_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    _to_lines(spark, sf_dir, folder)
    good, bad = model.load_records(spark, folder)
    return good.select("contract_id", "buyer", F.col("extra.lot").alias("lot"), F.lit(True).alias("accepted")).union(bad.select(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("value"), F.lit(False)))


def migrate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    _to_lines(spark, sf_dir, f"{folder}/in")
    written = model.migrate(spark, f"{folder}/in", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select(*_LOADED, F.lit(written).alias("written"))


def load_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API for records that a program holds in memory: here those of the nation table, which has a row for each nation."""
    held = [{"contract_id": str(r.n_nationkey), "buyer": r.n_name, "region": r.n_regionkey} for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]
    return model.load_from_list(spark, held).select("contract_id", "buyer", "category", "award_type", F.col("extra.region").alias("region"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    rows = star.contracts(spark, sf_dir).withColumns({"contract_url": F.concat(F.lit("u/"), "contract_id"), "price_numeric_eur": F.col("price_numeric_eur").cast("decimal(18,2)")})
    model.write_csv(rows, folder, [F.asc("seq")])
    return spark.read.option("header", True).csv(folder).na.fill("")


add(
    "load_contracts_json",
    lambda s, d: load_arrays(s, d).select(*_LOADED, F.col("extra.lot").alias("lot"), F.col("extra.scanned_note").alias("scanned_note")),
    W + _LOADED_SQL + ", CAST(seq % 7 AS VARCHAR) AS lot, buyer AS scanned_note FROM c",
    "",
)
add("group_by_unknown_field", lambda c: A.group_by(_rich(c), "lot"), "SELECT CAST(seq % 7 AS VARCHAR) AS group_value, count(*) AS contract_count, min(seq) AS first_seq FROM c GROUP BY 1")
add(
    "cond_unknown_field",
    lambda c: P.custom_conditions(_rich(c), P.ConditionGroup([P.Condition("lot", "ge", 3), P.Condition("scanned_note", "contains", "nation_1")])).select("seq"),
    "SELECT seq FROM c WHERE seq % 7 >= 3 AND contains(lower(buyer), 'nation_1')",
)
add(
    "load_records_lines",
    load_lines,
    W + "SELECT contract_id, buyer, CAST(seq % 7 AS VARCHAR) AS lot, true AS accepted FROM c UNION ALL SELECT NULL, NULL, v, false FROM c, (VALUES ('not json'), ('[1]')) t(v) WHERE seq % 7 = 0",
    "",
)
add("migrate_records", migrate_lines, W + _LOADED_SQL + ", (SELECT count(*) FROM c) AS written FROM c", "")
add(
    "load_from_memory",
    load_dicts,
    """SELECT CAST(n_nationkey AS VARCHAR) AS contract_id, n_name AS buyer, 'not_decided' AS category, 'unknown' AS award_type, CAST(n_regionkey AS VARCHAR) AS region
    FROM nation""",
    "",
)
add(
    "write_csv",
    csv_round_trip,
    W + "SELECT contract_id, coalesce(contract_title, '') AS contract_title, buyer, coalesce(supplier, '') AS supplier, coalesce(CAST(CAST(price_numeric_eur AS DECIMAL(18,2)) AS VARCHAR), '') AS price_numeric_eur, published_date, category, award_type, 'u/' || contract_id AS contract_url FROM c",
    "",
)
add(
    "merge_unknown_fields",
    lambda c: (lambda r: M.merge_contracts(r.filter("seq % 2 = 0").select("seq", "contract_id", "extra"), r.filter("seq % 3 = 0").select("seq", "contract_id", F.create_map(F.lit("lot"), F.lit("new"), F.lit("scanned_note"), F.lit("late"), F.lit("blank"), F.lit(" ")).alias("extra"))))(_rich(c)).select("contract_id", F.col("extra.lot").alias("lot"), F.col("extra.scanned_note").alias("scanned_note"), F.size("extra").alias("n")),
    """SELECT contract_id, CASE WHEN seq % 3 = 0 THEN 'new' ELSE CAST(seq % 7 AS VARCHAR) END AS lot, CASE WHEN seq % 2 = 0 THEN buyer ELSE 'late' END AS scanned_note, 2 AS n
    FROM c WHERE seq % 2 = 0 OR seq % 3 = 0""",
)

# ---------------------------------------------------------------- streaming

_FILES = 4  #: files of a page


def _arriving(pages: list[DataFrame], folder: str) -> None:
    """Pages that arrive one after the other, each as a few files."""
    for page in pages:
        page.repartition(_FILES).write.mode("append").parquet(folder)


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Three pages: the first has repeats, the second changes known contracts, the third brings the rest."""
    folder, c = scratch(spark), settled(star.contracts(spark, sf_dir).select(*_C).withColumn("scanned_subcontractors", F.concat("supplier", F.lit("; "), "buyer")))
    first = c.filter("seq % 3 = 0")
    again = first.filter("seq % 2 = 0").withColumns({"seq": F.col("seq") + (1 << 35), "buyer": F.lit(" "), "supplier": F.concat("supplier", F.lit("*"))})
    changed = first.filter("seq % 5 = 0").withColumns({"price_numeric_eur": F.lit(1.0), "scanned_service_type": F.lit("late")})
    _arriving([first.unionByName(again), changed, c.filter("seq % 3 <> 0")], f"{folder}/in")
    source = T.stream_contracts(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, _FILES)
    T.merge_ingest(source, f"{folder}/out", f"{folder}/cp", f"{folder}/subs").awaitTermination()
    return f"{folder}/out", f"{folder}/subs"


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_snapshot(spark, _ingested(spark, sf_dir)[0]).select("contract_id", "buyer", "supplier", "price_numeric_eur", "scanned_service_type", "category")


def stream_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.latest_snapshot(spark, _ingested(spark, sf_dir)[1]).select("contract_id", "subcontractor", "supplier")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts in two pages, half of them twice; some have no id or an empty one."""
    folder, rows = scratch(spark), star.contracts(spark, sf_dir).select("seq", F.expr("CASE WHEN seq % 10 = 3 THEN NULL WHEN seq % 10 = 7 THEN '' ELSE contract_id END").alias("contract_id"))
    _arriving([rows, rows.filter("seq % 2 = 1")], f"{folder}/in")
    source = T.stream_contracts(spark, f"{folder}/in", rows.schema, _FILES)
    T.dedup_ids(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("contract_id")


def stream_dedup_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts in two pages, half of them twice, that meet a dataset which holds a third of them; the checkpoint is new."""
    folder, session = scratch(spark), T.stateful_session(spark)
    rows = star.contracts(session, sf_dir).select("seq", F.expr("CASE WHEN seq % 10 = 3 THEN NULL WHEN seq % 10 = 7 THEN '' ELSE contract_id END").alias("contract_id"))
    rows.filter("seq % 3 = 0").write.parquet(f"{folder}/existing")
    _arriving([rows, rows.filter("seq % 2 = 1")], f"{folder}/in")
    source = T.stream_contracts(session, f"{folder}/in", rows.schema, _FILES)
    fresh = T.dedup_ids(source, session.read.parquet(f"{folder}/existing"))
    fresh.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("contract_id")


def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, events = scratch(spark), spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/*vents.parquet")
    requests = source.select(F.col("user_id").alias("session_id"), (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 77).alias("completion_tokens"), F.col("value").alias("cost_usd"), F.col("event_id").alias("seq"))
    T.usage_ingest(T.running_usage(requests), f"{folder}/out", f"{folder}/cp").awaitTermination()
    out = T.latest_usage(spark, f"{folder}/out")
    return out.select("session_id", "prompt_tokens", "completion_tokens", "cost_usd", "requests", F.col("last.prompt_tokens").alias("last_prompt_tokens"), F.col("last.completion_tokens").alias("last_completion_tokens"), F.col("last.cost_usd").alias("last_cost_usd"))


_PAGED = """, first AS (SELECT * FROM c WHERE seq % 3 = 0), m AS (SELECT contract_id, buyer, CASE WHEN seq % 3 = 0 AND seq % 2 = 0 AND seq % 5 <> 0 THEN supplier || '*' ELSE supplier END AS supplier,
 CASE WHEN seq % 15 = 0 THEN 1.0 ELSE price_numeric_eur END AS price_numeric_eur, CASE WHEN seq % 15 = 0 THEN coalesce(scanned_service_type, 'late') ELSE scanned_service_type END AS scanned_service_type, seq, supplier AS own FROM c)"""
add(
    "stream_merge_ingest",
    stream_merge,
    W + _PAGED + " SELECT contract_id, buyer, CASE WHEN own IS NULL THEN NULL ELSE supplier END AS supplier, price_numeric_eur, scanned_service_type, 'not_decided' AS category FROM m",
    "",
)
add("stream_expand_ingest", stream_expand, W + """, p AS (SELECT *, CASE WHEN seq % 6 = 0 THEN supplier || '*' ELSE supplier END AS first_supplier FROM c WHERE supplier IS NOT NULL)
 SELECT contract_id, supplier AS subcontractor, first_supplier AS supplier FROM p UNION ALL SELECT contract_id, buyer, first_supplier FROM p""", "")
add(
    "stream_dedup_ids",
    stream_dedup,
    W + "SELECT CASE WHEN seq % 10 = 3 THEN NULL WHEN seq % 10 = 7 THEN '' ELSE contract_id END AS contract_id FROM c UNION ALL SELECT CASE WHEN seq % 10 = 3 THEN NULL ELSE '' END FROM c WHERE seq % 10 IN (3, 7)",
    "",
)
add(
    "stream_dedup_known_ids",
    stream_dedup_known,
    W + """SELECT CASE WHEN seq % 10 = 3 THEN NULL WHEN seq % 10 = 7 THEN '' ELSE contract_id END AS contract_id FROM c WHERE seq % 3 <> 0 OR seq % 10 IN (3, 7)
    UNION ALL SELECT CASE WHEN seq % 10 = 3 THEN NULL ELSE '' END FROM c WHERE seq % 10 IN (3, 7)""",
    "",
)
add(
    "stream_usage",
    stream_usage,
    """SELECT user_id AS session_id, CAST(sum(event_id % 1000) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 77) AS BIGINT) AS completion_tokens, round(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE), 6) AS cost_usd, count(*) AS requests, max(event_id) % 1000 AS last_prompt_tokens, max(event_id) % 77 AS last_completion_tokens, arg_max(value, event_id) AS last_cost_usd
    FROM events GROUP BY 1""",
    "",
)
