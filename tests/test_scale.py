"""What keeps jobs within bounds as tables grow: plans, sizes of tables in tasks, and rows at the edges of modes."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from registra.functions import text as X
from registra.operators import context as Q
from registra.operators import extraction as H
from registra.operators import maintenance as M
from registra.operators.filters import FilterState
from registra.plans import jobs
from registra.streaming import ingest as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def one_page(spark, html):
    return spark.createDataFrame([(1, "https://x.sk/a/", html)], "page_id long, url string, html string")


def test_context_reads_contracts_once_and_never_broadcasts_tenders(spark):
    contracts = spark.createDataFrame([(1, "a", "s", "7"), (2, "b", "s", "8"), (3, "c", "s", None)], "seq long, contract_id string, ico_supplier string, public_procurement_id string")
    tenders = spark.createDataFrame([("7", [("x",)], [])], "tender_id string, documents array<struct<title:string>>, parts array<struct<part_number:int>>")
    joined = M.contract_tender_join(contracts, tenders)
    assert "Broadcast" not in plan(joined)
    context = Q.contract_context(joined)
    assert logical(context).count("LogicalRDD") + logical(context).count("LocalRelation") == 2
    assert sorted((r.contract_id, r.section, r.ord) for r in context.collect()) == [("a", "documents", 0), ("a", "fields", 0), ("a", "parts", 0), ("a", "tender", 0), ("b", "fields", 0), ("b", "note", 0), ("c", "fields", 0)]


def test_messages_are_never_broadcast(spark, monkeypatch):
    messages = spark.createDataFrame([(f"m{i}", f"text {i} of the firm a much longer name, and abc") for i in range(5)], "message_id string, text string")
    contracts = spark.createDataFrame([("Other", "s"), ("A much longer name", "s"), ("abc", "s")], "buyer string, supplier string")
    state = FilterState(institutions=["other"])
    wanted = {(f"m{i}", "institution", n) for i in range(5) for n in ("A much longer name", "abc")}
    for most, broadcasts in ((Q.FEW_NAMES, 1), (0, 0)):
        monkeypatch.setattr(Q, "FEW_NAMES", most)
        found = Q.entity_refusals(messages, contracts, state)
        assert plan(found).count("BroadcastExchange") == broadcasts
        assert {tuple(r) for r in found.collect()} == wanted
    assert Q.entity_refusals(messages, contracts.filter("buyer = 'Other'"), state).count() == 0


def test_parts_of_tenders_are_parsed_once(spark):
    legacy = {"part_1": '{"lot": "1", "notes": "own", "ai_extracted": {"notes": "ai"}}', "part_2": "[1]"}
    tenders = spark.createDataFrame([(1, legacy), (2, {"parts": '["x", {"part_number": 7}, {"a": 1}]'})], "tender_id long, legacy map<string,string>")
    out = M.normalise_parts(tenders)
    assert logical(out).count("from_json") <= 5
    got = {r.tender_id: [(p.part_number, p.notes, dict(p.fields)) for p in r.parts] for r in out.collect()}
    assert got == {1: [(1, "ai", {"lot": "1", "notes": "ai"})], 2: [(7, None, {"part_number": "7"}), (3, None, {"a": "1"})]}


def test_legacy_tenders_and_pages_are_spread(spark):
    parts = spark.createDataFrame([(i, 1, "b", "t", "n", 1.0) for i in range(20)], "p_partkey long, p_size int, p_brand string, p_type string, p_name string, p_retailprice double").coalesce(1)
    assert jobs._legacy(parts).rdd.getNumPartitions() > 1
    assert jobs._DETAIL(one_page(spark, "").coalesce(1)).rdd.getNumPartitions() > 1


@pytest.mark.parametrize("title", ["cut &amp", "cut &quot", "cut &am", "a &amp; b &quot"])
def test_titles_cut_inside_a_reference(spark, title):
    text = title.replace("&amp;", "&")
    given = one_page(spark, f"<title>{title}</title><a href=\"/l\">x</a>")
    labels = H.label_values(jobs._DETAIL(given))
    assert H.detail_identification(labels, jobs._BASE).first().buyer_detail == text
    assert H.detail_procurement_link(labels, jobs._BASE).first().public_procurement_portal == text
    assert {r.value for r in H.tender_sections(jobs._TENDER(given)).filter("field = 'info_nieco_ine'").collect()} == {text}
    assert H.tender_documents(jobs._TENDER(given)).first().document_type == text
    assert H.portal2_detail(jobs._P2(given)).filter("field = 'subject_name'").first().value == text
    assert H.portal2_documents(jobs._P2(given)).first().uploaded_at == text
    assert H.listing_rows(jobs._LIST(given), jobs._BASE).first().contract_title == text
    # pages themselves are read as HTML has it
    assert H.cells(one_page(spark, "<td>cut &amp</td>")).first().text == "cut &"


def test_elements_come_in_small_tables():
    html = "<table><tr>" + "<td>x</td>" * 50 + "</tr></table>"
    pages = pd.DataFrame({"page_id": range(1000), "url": "u", "html": html})
    sizes = [len(t) for t in H._tables(iter([pages]))]
    assert sum(sizes) == 50_000 and max(sizes) < H.CHUNK + 50


def test_pages_are_parsed_once(spark):
    pages = one_page(spark, "")
    for df in (H.label_values(pages), H.detail_attachments(pages, "b"), H.listing_rows(pages, "b"), H.tender_documents(pages), H.portal2_documents(pages)):
        assert logical(df).count("MapInPandas") == 1


def test_cells_know_their_card_and_place(spark):
    html = "<div class='card'><p>before</p><span>s</span><h2 class='card-header'>One</h2><h2 class='card-header'>Two</h2></div><table><tr><th>h</th><td>a<table><tr><td>in</td></tr></table><span>late</span></td><td>b</td></tr></table>"
    rows = {(r.tag, r.glued): (r.card_name, r.pos, r.n_cells) for r in H.cells(one_page(spark, html)).collect()}
    assert rows[("span", "s")] == ("One", None, 0)
    assert rows[("td", "in")] == (None, 0, 1)
    assert rows[("span", "late")] == (None, 0, 2) and rows[("td", "b")] == (None, 1, 2)


@pytest.mark.parametrize("n", [100, 101])
def test_only_small_scopes_print_all_in_full(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("contract_id"), F.lit("t").alias("contract_title"), F.lit("b").alias("buyer"), F.lit("s").alias("supplier"), F.lit("1").alias("ico_supplier"), F.lit(1.0).alias("price_numeric_eur"), F.lit("2020-01-01").alias("published_date"), F.lit("k").alias("scanned_service_type"), F.lit("a").alias("award_type"))
    assert Q.full_contracts(df).count() == (n if n <= 100 else 0)
    assert Q.scoped_context(df).filter("section = 'contract'").count() == (n if n <= 100 else 20)


def test_month_names_are_normalised_once(spark):
    df = spark.createDataFrame([("3.", " Máj ", "2024"), ("3.", "x", "2024"), ("3.", None, "2024")], "d string, m string, y string")
    out = df.select(X.parse_slovak_date(F.col("d"), F.col("m"), F.col("y")).alias("day"))
    assert [r.day for r in out.collect()] == ["2024-05-03", None, None]
    assert logical(out).count("lower(") <= 2


def test_records_of_arrays_are_not_gone_through_by_token(spark, tmp_path, monkeypatch):
    import json
    import random

    from registra.sources import arrays

    r = random.Random(5)
    text = lambda: "".join(r.choice('a {}[],:"\\é') for _ in range(r.randrange(12)))
    items = [{text(): text(), "b": r.choice([1, None, [text(), []], {"c": {"d": text()}}])} for _ in range(400)] + [[1, [2]], text(), 3]
    r.shuffle(items)
    whole = json.dumps(items, ensure_ascii=False)
    (tmp_path / "a.json").write_text(whole)
    got = arrays.array_items(spark, str(tmp_path)).orderBy("path", "start", "pos").collect()
    assert [json.loads(x.value) for x in got] == items

    seen = []
    real = arrays._TOKENS

    class Counts:
        findall = staticmethod(lambda t: seen.append(len(t)) or real.findall(t))
        finditer = staticmethod(lambda t: seen.append(len(t)) or real.finditer(t))

    plain = "[" + ", ".join(json.dumps({"a": "x" * 100, "b": "{,", "c": i}) for i in range(50)) + "]"
    fragments = plain.split("}")
    frame = pd.DataFrame({"value": fragments, "path": "p", "start": 0, "in_string": False, "depth": 0})
    monkeypatch.setattr(arrays, "_TOKENS", Counts)
    assert arrays.effect(plain) == (True, 0, 50)
    out = pd.concat(arrays._items(iter([frame])))
    assert sum(seen) < len(plain) / 5
    assert [json.loads(v)["c"] for v in out[~out["head"] & ~out["tail"]].value] == [*range(1, 50)] or len(out) >= 50
    for t in ('a"{b"[', '"}', "", "{[", 'x"y'):
        for inside in (False, True):
            same, one, other = arrays.effect(t, inside)
            assert (same, one, other) == arrays.effect("\\n" + t, inside)


def test_known_ids_are_joined_without_python(spark, tmp_path):
    schema = "page int, contract_id string"
    spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, ""), (1, None)], schema).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a",), (None,)], "contract_id string").write.parquet(str(tmp_path / "old"))
    existing = spark.read.parquet(str(tmp_path / "old"))
    fresh = T.dedup_ids(T.stream_contracts(spark, str(tmp_path / "in"), schema, 9), existing)
    assert fresh.columns == ["page", "contract_id"]
    text = fresh._jdf.queryExecution().analyzed().toString()
    assert "LeftAnti" in text and "Deduplicate" in text and "TransformWithState" not in text
    for f in (tmp_path / "old").iterdir():  # the existing rows themselves are read once, before the first page
        f.write_bytes(b"")
    fresh.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.page, r.contract_id or "") for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, ""), (1, ""), (1, "b")]


def test_subcontractors_are_parsed_once_and_merges_sort_by_a_hash(spark):
    rows = spark.range(3).selectExpr("id AS seq", "concat('c', id) AS contract_id", "concat('x; y', id) AS scanned_subcontractors", "concat('b', id) AS buyer")
    expanded = M.expand_subcontractors(rows)
    above, below = logical(expanded).split("Generate", 1)
    assert "parse_json" not in above and "Filter" not in below
    assert sorted((r.contract_id, r.sub_ord, r.subcontractor) for r in expanded.collect()) == [(f"c{i}", j, n) for i in range(3) for j, n in enumerate(("x", f"y{i}"))]
    assert M.expand_subcontractors(rows.withColumn("scanned_subcontractors", F.when(F.col("seq") == 1, " ; "))).count() == 0
    merged = M.merge_contracts(rows, rows.withColumn("buyer", F.lit("new")))
    assert re.search(r"Sort \[\w+#\d+L ASC NULLS FIRST, _key#", plan(merged)) and sorted(r.buyer for r in merged.collect()) == ["new"] * 3


def test_short_merges_ask_no_python_for_each_score():
    """Of scores the least is taken by ``min`` as it is: a short merge runs no expression a score."""
    import sys

    from registra.llm import bytepairs as B

    ranks = {bytes([b]): b for b in b"abcd"} | {b"ab": 256, b"cd": 257, b"abcd": 258, b"bc": 259}
    encoder, lines = B.Encoder(ranks, True), []
    sys.setprofile(lambda frame, event, arg: lines.append(frame.f_code.co_name) if event == "call" else None)
    try:
        got = [encoder.merge(x) for x in (b"", b"a", b"abcd", b"abcdabc", b"ba" * 20)]
    finally:
        sys.setprofile(None)
    assert got == [[], [97], [258], [258, 256, 99], [98, *[256] * 19, 97]]
    assert "<genexpr>" not in lines


def test_rows_without_an_id_are_dealt_over_tasks_and_meet_no_id(spark):
    schema = "seq long, contract_id string"
    existing = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "a")], schema)
    # "#5" and "=a" are ids like any other: neither meets a row without an id or the known "a"
    rows = [(5, ""), (6, "a"), (7, "#5"), (8, "=a"), (9, "=a"), (10, None), (11, "b"), (12, "b"), *[(i, "" if i % 2 else None) for i in range(100, 300)]]
    incoming = spark.createDataFrame(rows, schema)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.append_new(existing, incoming)
        tasks = out.filter("is_new").groupBy(F.spark_partition_id().alias("task")).count().collect()
        got = sorted((r.seq, r.contract_id, r.is_new) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    new = [(5, ""), (7, "#5"), (8, "=a"), (10, None), (11, "b"), *rows[8:]]
    assert got == sorted([(1, "a", False), (2, "", False), (3, None, False), (4, "a", False), *[(*r, True) for r in new]])
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 100
    assert [r.seq for r in M.append_new(existing, incoming, 3).filter("is_new").orderBy("seq").collect()] == [5, 7, 8]
