"""Hand-computed results on the small contract fixtures."""

import pytest
from pyspark.sql import functions as F

from registra.functions import labels as L
from registra.functions import text as X
from registra.operators import aggregates as A
from registra.operators import context as Q
from registra.operators import filters as P
from registra.operators import maintenance as M
from registra.operators import ranking as K
from registra.operators import rules as R
from registra.operators.filters import Condition, ConditionGroup, FilterState
from registra.sources import model

ROWS = [
    ("Oprava ciest", "Mesto Bratislava", "STRABAG s.r.o.", 1_000_000.0, "2025-12-01", "construction", "direct_award"),
    ("IT systém", "Mesto Bratislava", "T-Systems Slovakia s.r.o.", 500_000.0, "2025-12-15", "IT", "open_tender"),
    ("Dodávka potravín", "Mesto Košice", "STRABAG s.r.o.", 200_000.0, "2026-01-10", "supplies", "direct_award"),
    ("Bezpečnostné služby", "Ministerstvo vnútra SR", "SecurCorp a.s.", 750_000.0, "2026-01-20", "services", "open_tender"),
    ("Údržba budov", "Mesto Košice", "BuildCo s.r.o.", 300_000.0, "2026-02-05", "construction", "direct_award"),
]


@pytest.fixture(scope="module")
def five(spark):
    keys = ["contract_title", "buyer", "supplier", "price_numeric_eur", "published_date", "category", "award_type"]
    return model.load_from_list(spark, [dict(zip(keys, r)) | {"contract_id": f"C{i}", "ico_buyer": f"0000000{len(r[1]) % 7}"} for i, r in enumerate(ROWS)]).cache()


def one(df):
    return df.first().asDict()


def test_summary(five):
    s = one(A.aggregate(five))
    assert (s["total_spend"], s["contract_count"], s["avg_value"], s["max_value"]) == (2_750_000, 5, 550_000, 1_000_000)
    assert one(A.aggregate(five.limit(0))) == {"total_spend": 0.0, "contract_count": 0, "avg_value": 0.0, "max_value": 0.0}
    assert one(A.direct_award_rate(five))["direct_award_rate"] == 0.6


def test_concentration_and_fragmentation(five):
    assert one(A.vendor_concentration(five, None, 1))["vendor_concentration"] == pytest.approx(1_200_000 / 2_750_000)
    by = {r.buyer: r.vendor_concentration for r in A.vendor_concentration(five, "buyer", 1).collect()}
    assert by["Mesto Bratislava"] == pytest.approx(2 / 3)
    assert one(A.upper_median(five))["upper_median"] == 500_000
    assert one(A.fragmentation_score(five))["fragmentation_score"] == 0.4
    even = five.filter("price_numeric_eur < 1000000")
    assert one(A.upper_median(even))["upper_median"] == 500_000  # the upper one of 300 000 and 500 000


def test_top_vendor_and_rank(five):
    assert A.top_vendors(five, 1).first().name == "STRABAG s.r.o."
    assert [r.name for r in K.rank_institutions_in(five, "contract_count").orderBy("rank").collect()] == ["Mesto Bratislava", "Mesto Košice", "Ministerstvo vnútra SR"]


def test_group_by_category_uses_service_type(five):
    assert [r.group_value for r in A.group_by(five, "category").collect()] == [L.UNASSIGNED]


def test_filters_compose(five):
    count = lambda **k: P.apply(five, FilterState(**k)).count()
    assert count(institutions=["Mesto Košice"]) == 2
    assert count(institutions=[]) == 5
    assert count(value_min=0) == 5
    assert count(date_from="2026-01-01", date_to="2026-01-31") == 2
    assert count(categories=["construction"], award_types=["direct_award"]) == 2
    assert count(text_search="SYSTÉM") == 1
    assert count(scanned_service_types=[L.UNASSIGNED]) == 5
    assert FilterState().drill_down("month", "2024-02").date_to == "2024-02-29"


def test_filter_aggregate_and_export_agree(five):
    state = FilterState(value_min=300_000)
    kept = P.apply(five, state)
    assert kept.count() == one(A.aggregate(kept))["contract_count"] == model.export_rows(kept.withColumn("contract_url", F.lit(None).cast("string"))).count() == 4


def test_conditions(five):
    count = lambda *c, logic="AND": P.custom_conditions(five, ConditionGroup(c, logic)).count()
    assert count() == 5
    assert count(Condition("price_numeric_eur", "gt", "400000")) == 3
    assert count(Condition("price_numeric_eur", "gt", "many")) == 0
    assert count(Condition("buyer", "contains", "mesto"), Condition("award_type", "eq", "open_tender")) == 1
    assert count(Condition("buyer", "contains", "mesto"), Condition("award_type", "eq", "open_tender"), logic="OR") == 5
    assert count(Condition("pdf_url", "ne", "x")) == 0  # a null field is false, for ne as well
    assert count(Condition("no_such", "eq", 1)) == 0
    assert count(Condition("buyer", "no_such", 1)) == 0


def test_sort_puts_missing_values_last(spark):
    rows = [{"contract_id": str(i), "price_numeric_eur": p, "supplier": s} for i, (p, s) in enumerate([(5.0, "b"), (None, " "), (5.0, "A"), (9.0, None)])]
    df = model.load_from_list(spark, rows)
    ids = lambda *spec: [r.contract_id for r in K.sort_contracts(df, spec).collect()]
    assert ids(("price_numeric_eur", "desc")) == ["3", "0", "2", "1"]
    assert ids(("price_numeric_eur", "asc")) == ["0", "2", "3", "1"]
    assert ids(("supplier", "asc"))[:2] == ["2", "0"]
    assert ids(("supplier", "desc"))[:2] == ["0", "2"]
    assert ids(("no_such", "desc")) == ["0", "1", "2", "3"]


def test_pages_make_up_the_sorted_whole(five):
    spec = [("price_numeric_eur", "desc")]
    pages = [r.contract_id for p in (1, 2, 3) for r in K.contracts_page(five, spec, p, 2).orderBy("ord").collect()]
    assert pages == [r.contract_id for r in K.sort_contracts(five, spec).collect()]
    assert K.contracts_page(five, spec, 1, 2).first().total_pages == 3


def _contracts(spark, rows):
    return model.load_from_list(spark, [{"contract_id": str(i), "buyer": "B", "supplier": "S", "published_date": "2024-01-01"} | r for i, r in enumerate(rows)])


def test_rules(spark):
    n = lambda rule, rows, **k: R.RULES[rule](_contracts(spark, rows), **k).count()
    assert [n("threshold_proximity", [{"price_numeric_eur": p}]) for p in (95_000.0, 20_000.0, 100_000.0, None)] == [1, 0, 0, 0]
    shares = R.vendor_concentration(_contracts(spark, [{"supplier": "BigCo", "price_numeric_eur": 700_000.0}, {"supplier": "SmallCo", "price_numeric_eur": 300_000.0}])).collect()
    assert [(r.vendor, float(r.details["share_pct"])) for r in shares] == [("BigCo", 70.0)]
    assert n("fragmentation", [{"price_numeric_eur": 1000.0}] * 10) == 10
    assert n("overnight_turnaround", [{"price_numeric_eur": 1.0, "date_concluded": "2024-01-01"}]) == 1
    assert n("new_vendor_large_contract", [{"price_numeric_eur": 200_000.0}, {"price_numeric_eur": 1.0, "published_date": "2024-02-01"}]) == 1
    assert n("round_number_clustering", [{"price_numeric_eur": 1000.0 * i} for i in range(1, 6)]) == 5
    assert n("round_number_clustering", [{"price_numeric_eur": p} for p in (1000.0, 2000.0, 1.0, 2.0, 3.0)]) == 0


def test_severity_is_capped_and_rules_are_checked(spark):
    df = _contracts(spark, [{"price_numeric_eur": 95_000.0}])
    twice = R.evaluate(df, [{"id": "threshold_proximity"}, {"id": "threshold_proximity"}, {"id": "no_such"}])
    assert R.severity_by_contract(twice).first().severity == 1.0
    assert R.evaluate(df, []).count() == 0
    with pytest.raises(TypeError):
        R.evaluate(df, [{"id": "fragmentation", "params": {"no_such": 1}}])


def _merge_rows(spark, rows):
    keys = ["contract_id", "buyer", "supplier", "price_numeric_eur", "scanned_summary", "extra"]
    schema = "contract_id string, buyer string, supplier string, price_numeric_eur double, scanned_summary string, extra map<string,string>, seq long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema).select("seq", *keys)


def test_merge_by_hand(spark):
    old = _merge_rows(spark, [
        ("1", "Mesto A", None, 10.0, "first", {"lot": "1", "scanned_x": "kept"}),
        ("1", "Mesto B", "dropped", 99.0, "dropped", None),  # a second existing row of one id is no update
        ("2", "", "S", None, None, None),
        ("3", "Mesto C", "S", 5.0, None, None),
    ])
    new = _merge_rows(spark, [
        ("1", "  ", "S1", 10.0, "late", {"lot": "2", "scanned_x": "late", "blank": " "}),  # fills the supplier, changes the lot
        ("2", "Mesto D", "S", 0.0, "summary", None),  # 0 is a value
        ("3", "Mesto C", "S", 5.0, None, None),  # nothing new
        ("4", None, "S4", None, None, None),  # new
        ("4", "Mesto E", "S5", None, "s", {"lot": "4"}),  # and changed within the same page
    ])
    got = {r.contract_id: r for r in M.merge_contracts(old, new).collect()}
    assert {k: (r.buyer, r.supplier, r.price_numeric_eur, r.scanned_summary, r.extra) for k, r in got.items()} == {
        "1": ("Mesto A", "S1", 10.0, "first", {"scanned_x": "kept", "lot": "2"}),
        "2": ("Mesto D", "S", 0.0, "summary", None),
        "3": ("Mesto C", "S", 5.0, None, None),
        "4": ("Mesto E", "S5", None, "s", {"lot": "4"}),
    }
    assert one(M.merge_stats(old, new)) == {"existing_before": 4, "incoming": 5, "added": 1, "updated": 3, "total_after": 4}


def test_ingest_merges_from_the_first_page(spark, tmp_path):
    from registra.streaming import ingest as T

    schema = "seq long, contract_id string, buyer string, supplier string, price_numeric_eur double, scanned_subcontractors string"
    pages = [[(0, "a", None, "S", 1.0, "x; y"), (1, "a", "B", "S", 2.0, None), (2, "b", "B", "S", 1.0, None)], [(0, "a", "C", " ", None, "x; z"), (1, "c", "B", "S", 3.0, "w")]]
    for page in pages:
        spark.createDataFrame(page, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = T.stream_contracts(spark, str(tmp_path / "in"), schema)
    T.merge_ingest(source, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "subs")).awaitTermination()
    rows = {r.contract_id: (r.buyer, r.supplier, r.price_numeric_eur, r.category, r.seq) for r in T.latest_snapshot(spark, str(tmp_path / "out")).collect()}
    assert rows == {"a": ("C", "S", 2.0, "not_decided", 0), "b": ("B", "S", 1.0, "not_decided", 2), "c": ("B", "S", 3.0, "not_decided", (1 << T.PAGE) + 1)}
    subs = sorted((r.contract_id, r.subcontractor) for r in T.latest_snapshot(spark, str(tmp_path / "subs")).collect())
    assert subs == [("a", "x"), ("a", "y"), ("c", "w")]  # the first scanned list of a stays


def test_rows_without_an_id_are_all_kept(spark, tmp_path):
    from registra.streaming import ingest as T

    rows = [(None,), ("",), ("",), ("k",), ("k",)]
    spark.createDataFrame(rows, "contract_id string").write.parquet(str(tmp_path / "in"))
    query = T.dedup_ids(T.stream_contracts(spark, str(tmp_path / "in"), "contract_id string", 9)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.contract_id for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == ["", "", "None", "k"] or sorted((str(r.contract_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())) == ["", "", "None", "k"]


def test_unknown_fields_stay(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"contract_id": "1", "lot": 3, "who": "x", "deep": {"a": [1]}},\n {"contract_id": "2"}]\n')
    rows = model.load_contracts(spark, str(tmp_path / "c.json")).orderBy("seq").collect()
    assert [r.contract_id for r in rows] == ["1", "2"] and rows[0].extra == {"lot": "3", "who": "x", "deep": '{"a":[1]}'} and rows[1].extra is None
    held = model.load_from_list(spark, [{"contract_id": "1", "lot": 3, "who": "x"}])
    assert held.first().extra == {"lot": "3", "who": "x"}
    assert [r.group_value for r in A.group_by(held, "lot").collect()] == ["3"]
    assert P.custom_conditions(held, ConditionGroup([Condition("lot", "gt", 2)])).count() == 1
    assert "Lot [lot]: 3" in held.select(L.contract_block(held).alias("b")).first().b
    with pytest.raises(Exception):
        (tmp_path / "bad.json").write_text('[{"contract_id": "1", "price_numeric_eur": "much"}]')
        model.load_contracts(spark, str(tmp_path / "bad.json")).collect()


def test_rows_are_numbered_in_the_order_of_files(spark, tmp_path):
    for name, n in (("b.ndjson", 2), ("a.ndjson", 3)):
        (tmp_path / name).write_text("".join(f'{{"contract_id": "{name[0]}{i}"}}\n' for i in range(n)))
    rows = model.load_records(spark, str(tmp_path))[0].orderBy("seq").collect()
    assert [r.contract_id for r in rows] == ["a0", "a1", "a2", "b0", "b1"]


def test_parts_keep_all_their_fields(spark):
    legacy = {"part_2": '{"notes": "n", "x": 1, "ai_extracted": {"notes": "ai", "winner": "W", "participants": [{"name": "A", "proposed_sum_eur": 5.5}, {"name": "B"}]}}', "part_10": '{"part_number": 4}', "part_3": "[1]", "other": "{}"}
    listed = {"parts": '["no", {"notes": "z"}]', "part_1": "{}"}
    df = spark.createDataFrame([(1, legacy), (2, listed), (3, {})], "tender_id long, legacy map<string,string>")
    out = {r.tender_id: r.parts for r in M.normalise_parts(df).collect()}
    assert [(p.part_number, p.notes) for p in out[1]] == [(1, "ai"), (4, None)] and out[1][0].fields["winner"] == "W" and out[1][0].fields["x"] == "1"
    assert [(p.part_number, p.notes) for p in out[2]] == [(2, "z")] and out[3] == []
    bids = M.tender_bids(M.normalise_parts(df)).collect()
    assert [(r.tender_id, r.part_number, r.name, r.proposed_sum_eur, r.is_winner) for r in bids] == [(1, 1, "A", 5.5, True), (1, 1, "B", None, False)]


TENDER_PAGE = """<h2>Informácie</h2><dl><dt>ID zákazky<dd>77<dt>Doplňujúci údaj</dt><dd>x</dd></dl>
<h2>Dokumenty</h2><table><tbody><tr><td><span title="Celý názov.pdf">krátky</span></td><td>typ</td><td>2 kB</td><td>dnes</td><td><a href="/d/1"><span class="fa"></span></a></td></tr></tbody></table>
<div class="card"><h2 class="card-header">Identifikácia zmluvy</h2><div class="card-body"><ul><li><strong>Typ:</strong> Zmluva o dielo</li><li>bez označenia</li></ul></div></div>
<ul><li><strong>Verejné obstarávanie:</strong> <a href="/sk/tender/5/summary">portál</a></li></ul>"""


def test_page_parts(spark):
    from registra.operators import extraction as H

    pages = spark.createDataFrame([(1, "https://x.sk/a/b", TENDER_PAGE), (2, "https://x.sk/", None), (3, "https://x.sk/", "<table><tr><td>open <b>cell<td>next")], "page_id long, url string, html string")
    assert {(r.section, r.field, r.value) for r in H.tender_sections(pages).collect()} == {("info", "notice_id", "77"), ("info", "info_doplnujuci_udaj", "x")}
    (doc,) = H.tender_documents(pages).collect()
    assert (doc.document_name, doc.document_title, doc.file_size, doc.link, doc.is_external_link) == ("krátky", "Celý názov.pdf", "2 kB", "https://x.sk/d/1", False)
    labels = H.label_values(pages)
    assert {(r.card, r.label, r.value) for r in labels.collect()} == {("Identifikácia zmluvy", "Typ", "Zmluva o dielo"), (None, "Verejné obstarávanie", "portál")}
    (link,) = H.detail_procurement_link(labels, "https://x.sk").collect()
    assert link.public_procurement_url == "https://x.sk/sk/tender/5/summary" and link.public_procurement_id == "5"
    assert [r.text for r in H.cells(pages).filter("page_id = 3 AND tag = 'td'").orderBy("ord").collect()] == ["open cell", "next"]


def test_places_in_a_whole_order(spark):
    from registra.functions.numbering import numbered

    rows = numbered(spark.range(0, 5000, 1, 7).withColumn("k", F.col("id") % 10), [F.desc("k"), F.asc("id")]).collect()
    assert [r.ord for r in rows] == list(range(1, 5001)) and [r.id for r in rows] == sorted(range(5000), key=lambda i: (-(i % 10), i))


def test_short_and_similar_names_in_messages(spark):
    names = ["Zakladna skola A", "Zakladna skola B", "Ab", "Obec Nova Ves"]
    contracts = spark.createDataFrame([(i, n, "S") for i, n in enumerate(names)], "seq long, buyer string, supplier string")
    messages = spark.createDataFrame([("1", "co robi zakladna skola b?"), ("2", "cab"), ("3", "obec nova")], "message_id string, text string")
    got = {(r.message_id, r.name) for r in Q.entity_refusals(messages, contracts, FilterState(institutions=["nobody"])).collect()}
    assert got == {("1", "Zakladna skola B"), ("2", "Ab")}


def test_subcontractor_shapes(spark):
    shapes = [None, "", "a; b\nc", "a, b", '[{"nazov": "A", "IČO": 123}, "B", {"x": 1}]', '{"ico": "9"}', "[broken"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "contract_id long, scanned_subcontractors string")
    got = {}
    for r in M.expand_subcontractors(df).orderBy("contract_id", "sub_ord").collect():
        got.setdefault(r.contract_id, []).append((r.subcontractor, r.ico_subcontractor))
    assert got == {2: [("a", None), ("b", None), ("c", None)], 3: [("a", None), ("b", None)], 4: [("A", "123"), ("B", None)], 5: [(None, "9")], 6: [("[broken", None)]}


def test_records_from_lines_and_arrays(spark, tmp_path):
    lines = tmp_path / "a.ndjson"
    lines.write_text('{"contract_id": "1"}\n\nnot json\n[1]\n{"contract_id": "2", "category": "x"}\n')
    good, bad = model.load_records(spark, str(lines))
    assert (good.count(), bad.count()) == (2, 2)
    assert {r.category for r in model.backfill_defaults(good).collect()} == {"x", "not_decided"}
    array = tmp_path / "b.json"
    array.write_text('[{"contract_id": "1"}, {"contract_id": "2"}]')
    assert model.load_records(spark, str(array))[0].count() == 2
    assert model.load_contracts(spark, str(array)).first().award_type == "unknown"
    assert model.migrate(spark, str(lines), str(tmp_path / "out")) == 2


@pytest.mark.parametrize("text, value", [("28 978,27 €", 28978.27), ("0,00 €", 0.0), ("330 624,00 €", 330624.0), ("", None), ("abc", None), (None, None)])
def test_parse_price(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(X.parse_price(F.col("t"))).first()[0] == value


def test_text_functions(spark):
    at = lambda f, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(f(*[F.col(f"c{i}") for i in range(len(v))])).first()[0]
    assert at(X.parse_slovak_date, "1.", "Január", "2024") == "2024-01-01"
    assert at(X.parse_slovak_date, "1", "nic", "2024") is None
    assert at(X.parse_dotted_date, "1.3.2026") == "2026-03-01"
    assert at(X.parse_dotted_date, "neuvedený") is None
    assert at(X.normalize_text, "  Šťastný ČLOVEK ") == "stastny clovek"
    assert at(X.snake_case, "Názov (title)") == "nazov_title"
    assert at(X.snake_case, "!!") == "field"
    assert at(X.clean_text, "Z m l u v a  o\r\n\r\ndielo") == "Zmluvao\ndielo" or at(X.clean_text, "Z m l u v a") == "Zmluva"
    assert at(X.sanitise_message, "\x00 \x01") is None
    assert at(X.procurement_id, "https://x/sk/tender/123/summary") == "123"
    assert at(X.canonical_tender_url, "https://evil.sk/vyhladavanie-zakaziek/detail/5") is None
    assert at(X.json_recover, 'text {"a": 1} more') == '{"a": 1}'
    assert at(X.json_recover, "[1]") is None


def test_scope_refusals(spark, five):
    messages = spark.createDataFrame([("m1", "Čo mesto košice v roku 2019?"), ("m2", "nič")], "message_id string, text string")
    rows = Q.refusals(messages, five, FilterState(institutions=["Mesto Bratislava"], date_from="2025-01-01")).collect()
    assert [r.message_id for r in rows] == ["m1"]
    assert rows[0].hint == "institutions=Mesto Košice" and "Year 2019" in rows[0].reason
    assert Q.refusals(messages, five, FilterState()).count() == 0


def test_small_scope_shows_all_contracts(five):
    rows = Q.scoped_context(five.select("seq", "contract_id", "contract_title", "buyer", "supplier", "price_numeric_eur", "published_date", "award_type", "ico_supplier")).collect()
    assert sum(r.section == "contract" for r in rows) == 5
    assert [r.text for r in Q.scoped_context(five.limit(0)).collect()] == [Q.NOTHING]


def test_context_of_all_contracts(spark):
    import os

    from registra import plans
    from registra.sources import star

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the tables are not here")
    got = plans.queries()["contract_context_all"](spark, folder).filter("section = 'fields'")
    assert got.count() == star.contracts(spark, folder).count() == got.select("contract_id").distinct().count()


# ---------------------------------------------------------------- pages in buckets


def _written(folder):
    return {(p.parent.parent.name, p.parent.name) for p in folder.glob("data/v=*/bucket=*/*.parquet")}


def test_a_page_rewrites_the_buckets_it_touches(spark, tmp_path):
    from registra.streaming import ingest as T
    from registra.streaming.store import BucketTable

    schema = "seq long, contract_id string, buyer string, supplier string, price_numeric_eur double, scanned_subcontractors string"
    table, subs = BucketTable(spark, str(tmp_path / "t"), 16), BucketTable(spark, str(tmp_path / "s"), 16)
    page = lambda rows: spark.createDataFrame(rows, schema)
    T.merge_page(table, page([(i, f"c{i}", "B", "S", float(i), f"x{i}; y") for i in range(200)]), 0, subs)
    first = _written(tmp_path / "t")
    assert len({b for _, b in first}) == 16
    T.merge_page(table, page([(0, "c7", " ", "T", None, "late"), (1, "new", "B", "S", 1.0, "z")]), 1, subs)
    assert 1 <= len(_written(tmp_path / "t") - first) <= 2 and first <= _written(tmp_path / "t")
    rows = {r.contract_id: (r.buyer, r.supplier, r.price_numeric_eur) for r in table.read().collect()}
    assert len(rows) == 201 and rows["c7"] == ("B", "T", 7.0) and rows["c8"] == ("B", "S", 8.0)
    assert subs.read().count() == 401 and table.read(version=0).filter("supplier = 'T'").count() == 0

    # a page that broke off before its commit is written anew; one that broke off after it is left alone
    half = page([(0, "c9", "changed", "S", None, None)])
    half.withColumn("bucket", half.seq.cast("int")).write.partitionBy("bucket").parquet(str(tmp_path / "t/data/v=2"))
    assert table.read().filter("buyer = 'changed'").count() == 0
    for _ in range(2):
        T.merge_page(table, half, 2, subs)
        state = sorted(map(str, table.read().collect()))
        assert table.versions() == [0, 1, 2] and subs.read().count() == 401
    T.merge_page(table, page([]), 3, subs)  # a page without rows
    assert sorted(map(str, table.read().collect())) == state and table.versions() == [1, 2, 3]
    kept = {(f"v={v}", f"bucket={b}") for n in table.versions() for b, vs in table.manifest(n).layers.items() for v in vs}
    assert _written(tmp_path / "t") <= kept


def test_many_appends_to_a_bucket_are_written_together(spark, tmp_path):
    from pyspark.sql import functions as F

    from registra.streaming.store import LAYERS, BucketTable

    table = BucketTable(spark, str(tmp_path / "t"), 1)
    for n in range(LAYERS + 3):
        table.commit(n, spark.createDataFrame([(n, "x")], "n long, k string"), F.col("k"), table.manifest(before=n), append=True)
    assert sorted(r.n for r in table.read().collect()) == list(range(LAYERS + 3))
    assert len(table.manifest().layers[0]) <= LAYERS
    with pytest.raises(ValueError):
        BucketTable(spark, str(tmp_path / "none")).read()


def test_known_ids_of_an_existing_dataset(spark, tmp_path):
    from registra.streaming import ingest as T

    session = T.stateful_session(spark)
    schema = "contract_id string, page int"
    for rows in ([("a", 1), ("b", 1), (None, 1), ("", 1)], [("b", 2), ("c", 2), ("c", 2), ("", 2)]):
        session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    existing = session.createDataFrame([("a",), ("a",), (None,), ("z",)], "contract_id string")

    def run():
        fresh = T.dedup_ids(T.stream_contracts(session, str(tmp_path / "in"), schema), existing)
        fresh.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.contract_id or "", r.page) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("", 1), ("", 1), ("", 2), ("b", 1), ("c", 2)]
    session.createDataFrame([("a", 3), ("b", 3), ("d", 3)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [("", 1), ("", 1), ("", 2), ("b", 1), ("c", 2), ("d", 3)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != session.conf.get("spark.sql.streaming.stateStore.providerClass")


# ---------------------------------------------------------------- large arrays


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _any_item(rng):
    if rng.random() < 0.1:
        return rng.choice([1, None, True, 'a,]}[{"\\', [], [[1, {"x": "]"}]], {}, ""])
    return {"id": rng.randrange(10**6), "t": "".join(rng.choice('ab{}[],"\\ \né:') for _ in range(rng.randrange(60))), "d": {"z": [1, {"q": "}"}]}}


def test_arrays_are_read_in_splits(spark, tmp_path, small_splits):
    import json
    import random

    from registra.sources.arrays import array_items

    rng = random.Random(1)
    for name, n, how in (("many", 400, {}), ("indented", 300, {"indent": 2}), ("none", 0, {}), ("one", 1, {}), ("long", 30, {"ensure_ascii": False})):
        items = [_any_item(rng) for _ in range(n)]
        if name == "long":
            items[7] = {"big": "x{" * 8000}  # longer than several splits
        (tmp_path / name).write_text(" \n" * (name == "indented") + json.dumps(items, **how) + "\n")
        rows = array_items(spark, str(tmp_path / name)).orderBy("path", "start", "pos").collect()
        assert [json.loads(r.value) for r in rows] == items
        assert len({r.start for r in rows}) > 10 or name not in ("many", "indented")
    for i, bad in enumerate(('[1,2', '{"a":1}', '[{"a":"]')):
        (tmp_path / f"bad{i}").write_text(bad)
        with pytest.raises(Exception, match="not one whole JSON array"):
            array_items(spark, str(tmp_path / f"bad{i}")).collect()


def test_a_large_register_keeps_its_order(spark, tmp_path, small_splits):
    import json

    (tmp_path / "in").mkdir()
    ids = [f"{f}{i}" for f in "ab" for i in range(300)]
    for f in "ba":
        (tmp_path / "in" / f"{f}.json").write_text(json.dumps([{"contract_id": x, "contract_title": "], [{\"" * 3, "lot": {"n": [1]}} for x in ids if x[0] == f]))
    rows = model.load_contracts(spark, str(tmp_path / "in"))
    assert rows.rdd.getNumPartitions() > 5
    rows = rows.orderBy("seq").collect()
    assert [r.contract_id for r in rows] == ids and rows[-1].extra == {"lot": '{"n":[1]}'} and len({r.seq for r in rows}) == 600
    good, bad = model.load_records(spark, str(tmp_path / "in"))
    assert good.count() == 600 and bad.count() == 0


def _merged_by_hand(existing, incoming):
    """The rule row by row, over dictionaries."""
    filled = lambda v: v is not None and not (isinstance(v, str) and not v.strip())
    key = lambda r: r["contract_id"] if filled(r["contract_id"]) else "|".join((r[c] or "").strip() for c in ("buyer", "supplier"))
    plain = lambda r: {k: v for k, v in r.items() if k != "extra"} | {("extra", k): v for k, v in (r["extra"] or {}).items()}
    held, updated, added = {}, 0, 0
    for r in existing:
        held.setdefault(key(r), plain(r))
    for r in incoming:
        if key(r) not in held:
            held[key(r)] = plain(r)
            added += 1
            continue
        now, changed = held[key(r)], False
        for k, v in plain(r).items():
            scanned = (k if isinstance(k, str) else k[1]).startswith("scanned_")
            if filled(v) and not (scanned and filled(now.get(k))) and now.get(k) != v:
                now[k], changed = v, True
        updated += changed
    rows = [({k: v for k, v in r.items() if isinstance(k, str)}, {k[1]: v for k, v in r.items() if not isinstance(k, str) and filled(v)}) for r in held.values()]
    return rows, {"existing_before": len(existing), "incoming": len(incoming), "added": added, "updated": updated, "total_after": len(held)}


def test_merges_match_the_rule_row_by_row(spark):
    import random

    rng = random.Random(3)
    names = ["contract_id", "buyer", "supplier", "price_numeric_eur", "scanned_summary", "extra"]

    def some(n):
        rows = []
        for _ in range(n):
            extra = {rng.choice(["lot", "scanned_x", "note"]): rng.choice(["1", "2", " "]) for _ in range(rng.randrange(3))} or None
            rows.append((rng.choice(["1", "2", "3", "", None]), rng.choice(["A", "B", " ", None]), rng.choice(["S", None]), rng.choice([0.0, 1.0, None]), rng.choice(["x", "y", "", None]), extra))
        return rows

    for n, m in ((12, 40), (0, 30), (30, 0), (300, 600)):
        old, new = some(n), some(m)
        rows, stats = _merged_by_hand([dict(zip(names, r)) for r in old], [dict(zip(names, r)) for r in new])
        old, new = _merge_rows(spark, old), _merge_rows(spark, new)
        got = [({c: r[c] for c in names if c != "extra"}, r.extra or {}) for r in M.merge_contracts(old, new).orderBy("merged_ord").collect()]
        assert got == rows
        assert one(M.merge_stats(old, new)) == stats
    assert "Window" not in M.merge_contracts(old, new)._jdf.queryExecution().optimizedPlan().toString()


# ---------------------------------------------------------------- deep pages


def test_slices_are_those_of_the_sorted_whole(spark):
    import random

    from registra.functions.numbering import slice_in_order

    rng = random.Random(2)
    rows = [(rng.choice([None, 1.0, 1.0, 1.0, 2.5, float("nan"), rng.random() * 9]), rng.choice(["a", "b", None, "é", str(rng.randrange(50))]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, t string, seq long").repartition(4)

    def place(v, down):
        number = (2, 0) if v is None else (1, 0) if v != v else (0, v)  # NaN is the largest number
        return number if not down or v is None else (-number[0], -number[1])

    def text(v, down):
        return (1, ()) if v is None else (0, tuple(-ord(c) for c in v) + (1,) if down else tuple(map(ord, v)))

    for keys in ([("x", False), ("t", True), ("seq", False)], [("t", False), ("x", True), ("seq", False)], [("x", True), ("seq", False)]):
        part = {"x": lambda r, d: place(r[0], d), "t": lambda r, d: text(r[1], d), "seq": lambda r, d: r[2]}
        whole = [r[2] for r in sorted(rows, key=lambda r: [part[c](r, d) for c, d in keys])]
        for skip, n in ((0, 10), (1395, 20), (2990, 50), (700, 900), (5000, 10)):
            got = slice_in_order(df, keys, skip, n, most=60).collect()
            assert [r.seq for r in sorted(got, key=lambda r: r.ord)] == whole[skip : skip + n]
            assert sorted(r.ord for r in got) == list(range(skip + 1, min(skip + n, 3000) + 1))


def test_a_deep_page_sorts_one_range(spark):
    from registra.functions.numbering import _parts

    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("x"), F.col("id").alias("seq"))
    (part,) = _parts(df, [("x", False), ("seq", False)], 150_000, 50, 200_000, 5_000)
    assert [r.x for r in part.collect()] == sorted(i * 7919 % 200_003 for i in range(200_000))[150_000:150_050]
    sorted_rows = part._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in sorted_rows and df.filter("x >= 0").count() == 200_000


def test_pages_of_rankings(five):
    whole = [(r["rank"], r["name"]) for r in K.rank_institutions_in(five).orderBy("rank").collect()]
    paged = [r for p in range(1, 5) for r in K.rankings_page(five, p, 2, most=1).orderBy("rank").collect()]
    assert [(r["rank"], r["name"]) for r in paged] == whole
    assert {(r.total, r.total_pages) for r in paged} == {(len(whole), -(-len(whole) // 2))}
    assert K.rankings_page(five.limit(0), 1, 5).count() == 0


def test_usage_files_do_not_grow_with_batches(spark, tmp_path):
    from registra.streaming import ingest as T

    schema = "session_id long, prompt_tokens long, completion_tokens long, cost_usd double, seq long"
    expected = {}
    for n in range(5):
        rows = [(i if i else None, 10 * n, i, 0.5, 100 * n + i) for i in range(n, n + 6)]
        for r in rows:
            old = expected.get(r[0], (0, 0))
            expected[r[0]] = (old[0] + r[1], old[1] + 1)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = T.stream_contracts(spark, str(tmp_path / "in"), schema)
        T.usage_ingest(T.running_usage(source), str(tmp_path / "out"), str(tmp_path / "cp"), 4).awaitTermination()
        got = {r.session_id: (r.prompt_tokens, r.requests) for r in T.latest_usage(spark, str(tmp_path / "out")).collect()}
        assert got == expected
        files = T.latest_usage(spark, str(tmp_path / "out")).inputFiles()
        assert len(files) <= 4, "\n".join(files)


# ---------------------------------------------------------------- accents, names in messages, rule lists


def test_accents_over_all_code_points(spark):
    import unicodedata

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    chars = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x110000)]]
    texts = ["".join(chars[i : i + 64]) for i in range(0, len(chars), 64)] + ["ŠΆ ﬁ Ⓐ", "한글 ½ ㌀", "\U0001d400ﬁ\U000f0000\U00020001", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4).select("i", X.strip_accents(F.col("t")).alias("p"), X.normalize_text(F.col("t")).alias("n")).collect()
    for r in got:
        assert r.p == (None if texts[r.i] is None else plain(texts[r.i])), r.i
    assert {r.i: r.n for r in got}[len(texts) - 5] == "sα fi a"


def test_messages_keep_a_third_of_their_runs_and_find_all_names(spark):
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdeč ") for _ in range(n))
    names = list({word(n).strip() for n in list(range(1, 30)) * 6} - {""})
    texts = [word(60) + rng.choice(names).upper() + word(60) for _ in range(80)] + ["", "a", None, word(5)]
    messages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "message_id int, text string")
    contracts = spark.createDataFrame([(n, None) if k % 2 else (None, n) for k, n in enumerate(names)], "buyer string, supplier string")
    state = FilterState(institutions=["none such"], vendors=[names[0]])
    want = {(i, "institution" if k % 2 else "vendor", n) for i, t in enumerate(texts) for k, n in enumerate(names) if t and n.lower() in t.lower() and n.lower() != (names[0].lower() if k % 2 == 0 else "none such")}
    assert {tuple(r) for r in Q.entity_refusals(messages, contracts, state).collect()} == want
    low = messages.select(F.lower("text").alias("msg"))
    kept, runs = low.agg(F.sum(F.size(Q.least_grams("msg", *Q.STRETCHES[0]))), F.sum(F.greatest(F.lit(0), F.length("msg") - 7))).first()
    assert kept * 3 < runs


def test_a_rule_list_gives_what_its_rules_give_one_by_one(spark):
    import random

    rng = random.Random(6)
    rows = []
    for i in range(600):
        price = rng.choice([None, 0.0, 1000.0, 2000.0, 95_000.0, 150_000.0, float(rng.randrange(60_000))])
        day = f"2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}"
        rows.append((i, f"c{i}", rng.choice(["A", "B", "C", "", None]), rng.choice(["S", "T", "U", "V", None, " "]), price, rng.choice([day, None, ""]), rng.choice([day, None, "odd"])))
    df = spark.createDataFrame(rows, "seq long, contract_id string, buyer string, supplier string, price_numeric_eur double, published_date string, date_concluded string").repartition(3)
    lists = [None, [{"id": "fragmentation", "params": {"min_contracts": 9}}, {"id": "fragmentation", "params": {"max_value_eur": 5000.0}}, {"id": "unknown"}, {"id": "threshold_proximity"}]]
    lists += [[{"id": "round_number_clustering", "params": {"min_round_pct": 10, "round_modulus": 500}}, {"id": "round_number_clustering", "params": {"min_round_pct": 20}}], [{"id": "overnight_turnaround"}]]
    lists += [[{"id": "vendor_concentration", "params": {"max_share_pct": 20, "top_n": 2}}, {"id": "new_vendor_large_contract", "params": {"min_value_eur": 1.0}}]]
    for rules in lists:
        want = []
        for n, rule in enumerate([{"id": k} for k in R.RULES] if rules is None else rules):
            if rule["id"] in R.RULES:
                want += [str((n, *r)) for r in R.RULES[rule["id"]](df, **rule.get("params", {})).collect()]
        flags = R.evaluate(df, rules)
        assert sorted(str((r.rule_ord, *r[:-1])) for r in flags.select(*R.COLUMNS, "rule_ord").collect()) == sorted(want) and want
        assert flags._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1  # the other pass has made the sums
    R.RULES["mine"] = lambda df, most=1.0: R._flag(df.filter(F.col("seq") < most), "mine", 1.0, seq=F.col("seq"))
    try:
        assert R.evaluate(df, [{"id": "mine"}, {"id": "threshold_proximity"}]).filter("rule_id = 'mine'").count() == 1
    finally:
        del R.RULES["mine"]
