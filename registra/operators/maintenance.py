"""Keeping the contract dataset: merges, appends, expansion into subcontractors, enrichment lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registra.functions.labels import nz
from registra.functions.storage import spread
from registra.functions.text import is_readable, is_tender_summary, truncate, clean_text

# fixed values: service types and their subtypes
TAXONOMY = {
    "Stavebníctvo a rekonštrukcia": ["výstavba", "rekonštrukcia", "oprava a údržba budov", "zateplenie a energetická obnova", "inžinierske práce"],
    "Infraštruktúra a cesty": ["oprava ciest a chodníkov", "cestná infraštruktúra", "kanalizácia a vodovod", "vodné hospodárstvo"],
    "Informačné technológie": ["vývoj softvéru a informačných systémov", "licencie a softvérové produkty", "servery a hardvér", "cloudové služby", "kybernetická bezpečnosť", "telekomunikácie"],
    "Doprava a vozidlá": ["nákup vozidiel", "prenájom vozidiel", "verejná doprava", "preprava a logistika", "dopravné služby"],
    "Energie a médiá": ["elektrická energia", "plyn", "teplo", "energetické služby"],
    "Technická údržba a servis": ["opravy a údržba zariadení", "servisné práce", "technická správa"],
    "Správa a prevádzka nehnuteľností": ["správa budov a priestorov", "prenájom budov a priestorov", "upratovacie a hygienické služby", "odpadové hospodárstvo"],
    "Nákup tovaru a vybavenia": ["zdravotnícke vybavenie a materiál", "kancelárske vybavenie a nábytok", "technika a zariadenia", "oblečenie, uniformy a ochranné pomôcky", "materiál a spotrebný tovar"],
    "Odborné a poradenské služby": ["právne služby", "audit a účtovníctvo", "poradenstvo a konzultácie", "projektovanie a inžiniering", "znalecké posudky a expertízy"],
    "Vzdelávanie a rozvoj": ["školenia a kurzy", "zvyšovanie kvalifikácie", "vzdelávacie programy"],
    "Zdravotná a sociálna starostlivosť": ["zdravotná starostlivosť", "sociálne služby", "rehabilitácia", "opatrovateľská starostlivosť", "dodávka liekov a zdravotníckeho materiálu"],
    "Bezpečnosť a ochrana": ["bezpečnostné služby", "kamerové systémy", "bezpečnostné systémy", "požiarna ochrana"],
    "Marketing a komunikácia": ["reklama a marketing", "PR a mediálna komunikácia", "vydavateľské a tlačové služby"],
    "Potraviny a stravovanie": ["dodávka potravín", "stravovacie služby", "catering"],
}


def is_filled(c: Column | str, kind: T.DataType) -> Column:
    """Not null, not a blank text, not an empty list; 0 and false count as filled."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(kind, T.StringType):
        return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def record_key(df: DataFrame) -> Column:
    """(kind, value): contract id, else URL, else number, date, buyer and supplier together."""
    text = lambda c: nz(F.trim(F.col(c).cast("string"))) if c in df.columns else F.lit(None).cast("string")
    parts = F.concat_ws("|", *[F.coalesce(text(c), F.lit("")) for c in ("contract_number", "published_date", "buyer", "supplier")])
    kinds = F.when(text("contract_id").isNotNull(), F.struct(F.lit("id").alias("kind"), text("contract_id").alias("value")))
    kinds = kinds.when(text("contract_url").isNotNull(), F.struct(F.lit("url").alias("kind"), text("contract_url").alias("value")))
    return kinds.otherwise(F.struct(F.lit("parts").alias("kind"), parts.alias("value")))


def _both(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both sets with their key and place: existing rows before incoming ones, each by seq."""
    rows = existing.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn("_key", record_key(rows)).withColumn("_ord", F.struct("_src", "seq"))


def _filled_entries(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.coalesce(F.length(F.trim(v)) > 0, F.lit(False)))


def _fields(rows: DataFrame, maps: bool) -> list[T.StructField]:
    inner = ("seq", "_src", "_key", "_ord", "_first")
    return [f for f in rows.schema.fields if f.name not in inner and isinstance(f.dataType, T.MapType) == maps]


def _entries(rows: DataFrame, field: str) -> DataFrame:
    """(_key, _ord, name, value): the filled entries of a map."""
    return rows.select("_key", "_ord", F.explode(_filled_entries(F.col(field))).alias("name", "value"))


def _is_scanned(name: Column) -> Column:
    return name.startswith("scanned_")


def _over(old: Column, new: Column) -> Column:
    """Two maps as one: new entries win, but for scanned names that the old one has."""
    none = F.create_map().cast("map<string,string>")
    old = F.coalesce(old, none)
    fresh = F.coalesce(F.map_filter(new, lambda k, v: ~(_is_scanned(k) & F.map_contains_key(old, k))), none)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def merge_contracts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert: the last filled value of each field wins, of scanned fields the first; existing rows come first, then new ones.

    Of existing rows with one key the first counts. Unknown fields (maps) are merged name by name in the same way. ``seq`` numbers each side's rows; the
    result has ``merged_ord`` = (source, seq) of the row that a record began with.

    A field's values combine as pairs of place and value, in any order and grouping, so each task hands on one row per key, however many rows
    share it; the names of a map are aggregated as rows of their own.
    """
    rows = _both(existing, incoming)
    plain, maps = _fields(rows, False), _fields(rows, True)
    whole = F.min_by(F.struct(*[f.name for f in (*plain, *maps)]), "_ord").alias("_begin")
    picked = []
    for f in plain:
        counts = (F.col("_src") == 1) & is_filled(f.name, f.dataType)
        pick = F.min_by if f.name.startswith("scanned_") else F.max_by
        picked.append(pick(F.when(counts, F.col(f.name)), F.when(counts, F.col("_ord"))).alias(f.name))
    # values of texts and structs are aggregated in sorted order: by a hash first, which is compared as one number
    out = rows.groupBy(F.xxhash64("_key").alias("_hash"), "_key").agg(F.min("_ord").alias("merged_ord"), whole, *picked)
    values = []
    for f in plain:
        begun, fresh = F.col("_begin").getField(f.name), F.col(f.name)
        kept = F.when(is_filled(begun, f.dataType), begun) if f.name.startswith("scanned_") else F.lit(None)
        values.append(F.coalesce(kept, fresh, begun).alias(f.name))
    for i, f in enumerate(maps):
        by_name = _entries(rows.filter("_src = 1"), f.name).groupBy("_key", "name").agg(F.max_by("value", "_ord").alias("last"), F.min_by("value", "_ord").alias("first"))
        entry = F.struct("name", F.when(_is_scanned(F.col("name")), F.col("first")).otherwise(F.col("last")))
        out = out.join(by_name.groupBy("_key").agg(F.map_from_entries(F.collect_list(entry)).alias(f"_map{i}")), "_key", "left")
        merged = _over(_filled_entries(F.col("_begin").getField(f.name)), F.col(f"_map{i}"))
        values.append(F.when(F.size(merged) > 0, merged).alias(f.name))
    return out.select("merged_ord", *values)


def merge_stats(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: rows before, incoming, added, updated (incoming rows that changed a field) and after.

    A row changes a field if its filled value differs from the last filled one before it (a scanned field: if there is none). One ordered pass over each
    key's rows tells that for the schema's fields, one over each name's entries for maps.
    """
    rows = _both(existing, incoming)
    whole = F.broadcast(existing.agg(F.count(F.lit(1)).alias("existing_before"))).crossJoin(F.broadcast(incoming.agg(F.count(F.lit(1)).alias("incoming"))))
    along = Window.partitionBy("_key").orderBy("_ord")
    upto = along.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.row_number().over(along) == 1).filter("_src = 1 OR _first")
    changed = F.lit(False)
    for f in _fields(rows, False):
        filled = is_filled(f.name, f.dataType)
        scanned = f.name.startswith("scanned_")
        before = (F.first if scanned else F.last)(F.when(filled, F.col(f.name)), ignorenulls=True).over(upto)
        changed = changed | (filled & (before.isNull() if scanned else ~before.eqNullSafe(F.col(f.name))))
    found = rows.select("_ord", (~F.col("_first") & changed).alias("changed"), "_first")
    updated = found.filter("changed").select("_ord")
    for f in _fields(rows, True):
        entries = _entries(rows, f.name).join(rows.filter("_first").select("_key", F.col("_ord").alias("_begun")), "_key")
        before = F.lag("value").over(Window.partitionBy("_key", "name").orderBy("_ord"))
        differs = F.when(_is_scanned(F.col("name")), before.isNull()).otherwise(~before.eqNullSafe(F.col("value")))
        updated = updated.union(entries.withColumn("changed", differs).filter("changed AND _ord <> _begun").select("_ord"))
    keys = found.filter("_first").agg(F.count_if(F.col("_ord._src") == 1).alias("added"), F.count(F.lit(1)).alias("total_after"))
    updated = updated.distinct().agg(F.count(F.lit(1)).alias("updated"))
    return whole.crossJoin(F.broadcast(keys)).crossJoin(F.broadcast(updated)).select("existing_before", "incoming", "added", "updated", "total_after")


def append_new(existing: DataFrame, incoming: DataFrame, limit: int | None = None) -> DataFrame:
    """Existing rows and those incoming ones whose id is new, the first of each; rows without an id are always new.

    Rows without an id have keys of their own, so they are dealt over all tasks. So are ids: they shrink so much in a shuffle that Spark, which
    goes by bytes, would put nearly all of them into one task.
    """
    of_id = F.concat(F.lit("="), nz("contract_id"))
    keyed = spread(incoming.withColumn("_key", F.coalesce(of_id, F.concat(F.lit("#"), F.col("seq").cast("string")))), "_key")
    rank = F.row_number().over(Window.partitionBy("_key").orderBy("seq"))
    fresh = keyed.withColumn("_n", F.when(nz("contract_id").isNull(), 1).otherwise(rank)).filter("_n = 1").drop("_n")
    known = existing.select(of_id.alias("_key")).filter("_key IS NOT NULL").distinct()
    fresh = fresh.join(known, "_key", "left_anti").drop("_key")
    if limit is not None:
        fresh = fresh.orderBy("seq").limit(limit)
    return existing.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)), allowMissingColumns=True)


def tender_worklist(contracts: DataFrame, saved: DataFrame | None = None, column: str = "public_procurement_url") -> DataFrame:
    """Distinct tender URLs of one portal in the order in which they were first seen, without those already saved."""
    urls = contracts.select(F.trim(column).alias("tender_url"), "seq").filter(is_tender_summary(F.col("tender_url")))
    urls = urls.groupBy("tender_url").agg(F.min("seq").alias("first_seq"))
    return urls if saved is None else urls.join(saved.select("tender_url").distinct(), "tender_url", "left_anti")


def with_errors(saved: DataFrame, failed: DataFrame) -> DataFrame:
    """Saved tenders and a row (tender_url, error) for each that failed."""
    return saved.unionByName(failed.select("tender_url", "error"), allowMissingColumns=True)


_ITEM = "array<struct<name:string,ico:string>>"
_NAMES = ("name", "subcontractor", "nazov", "company", "supplier")
_ICOS = ("ico", "ico_subcontractor", "ico_subdodavatela", "subcontractor_ico", "IČO", "ICO")


def _text_of(item: str, key: str, kinds: str) -> str:
    """SQL: a variant's field as trimmed text where it is of one of the kinds and not blank."""
    at = f"try_variant_get({item}, '$[\"{key}\"]', 'variant')"
    return f"CASE WHEN schema_of_variant({at}) IN ({kinds}) THEN nullif(trim(try_variant_get({item}, '$[\"{key}\"]', 'string')), '') END"


def subcontractor_items(column: str) -> Column:
    """A source field as an array of (name, ico): a JSON list or object, or names between line breaks, semicolons or commas."""
    names = ", ".join(_text_of("x", k, "'STRING'") for k in _NAMES)
    icos = ", ".join(_text_of("x", k, "'STRING', 'BIGINT'") for k in _ICOS)
    item = f"CASE WHEN schema_of_variant(x) = 'STRING' THEN named_struct('name', nullif(trim(try_variant_get(x, '$', 'string')), ''), 'ico', CAST(NULL AS STRING)) WHEN schema_of_variant(x) LIKE 'OBJECT%' THEN named_struct('name', coalesce({names}), 'ico', coalesce({icos})) END"
    text = f"trim(CAST({column} AS STRING))"
    parsed = f"CASE WHEN {text} LIKE '[%' OR {text} LIKE '{{%' THEN try_parse_json({text}) END"
    listed = f"CASE WHEN schema_of_variant({parsed}) LIKE 'ARRAY%' THEN try_variant_get({parsed}, '$', 'array<variant>') WHEN {parsed} IS NOT NULL THEN array({parsed}) END"
    split = f"CASE WHEN {text} RLIKE '[;\\n]' THEN split({text}, '[;\\n]') ELSE split({text}, ',') END"
    plain = f"transform({split}, p -> named_struct('name', nullif(trim(p), ''), 'ico', CAST(NULL AS STRING)))"
    rows = f"CASE WHEN {parsed} IS NOT NULL THEN transform({listed}, x -> {item}) ELSE {plain} END"
    return F.expr(f"coalesce(filter(CAST({rows} AS {_ITEM}), i -> i.name IS NOT NULL OR i.ico IS NOT NULL), array())")


def expand_subcontractors(contracts: DataFrame, column: str = "scanned_subcontractors") -> DataFrame:
    """One row per contract and subcontractor; contracts without any are dropped."""
    rest = contracts.drop("subcontractor", "ico_subcontractor").withColumn("_items", subcontractor_items(column))
    # outer, then filtered: else Spark puts a filter on the parsed field before, which parses it again
    rows = rest.select("*", F.posexplode_outer("_items").alias("sub_ord", "_i")).drop("_items").filter("sub_ord IS NOT NULL")
    return rows.withColumns({"subcontractor": F.col("_i.name"), "ico_subcontractor": F.col("_i.ico")}).drop("_i")


def append_subcontractors(existing: DataFrame, expanded: DataFrame) -> DataFrame:
    """Existing rows and the expanded ones with a new (contract, name, ICO); repeats among the new ones stay."""
    key = ["contract_id", "subcontractor", "ico_subcontractor"]
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in key]
    known = existing.select(*plain).distinct()
    fresh = expanded.select("*", *plain).join(known, [f"_{c}" for c in key], "left_anti").drop(*[f"_{c}" for c in key])
    return existing.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)), allowMissingColumns=True)


_BIDDERS = "array<struct<name:string,ico:string,proposed_sum:string,proposed_sum_eur:double>>"


def normalise_parts(tenders: DataFrame) -> DataFrame:
    """Tenders (tender_id, legacy: their fields as JSON texts by name) -> an array of parts (part_number, notes, error, participants, fields).

    A list called ``parts`` is taken as it is, else the objects called part_N in the order of N; anything but objects is left out. What
    a part's ``ai_extracted`` holds takes the place of its own fields. ``fields`` keeps every field of a part by name, as
    text or JSON text; a part without a number is numbered by its place.
    """
    given = F.from_json(F.try_element_at("legacy", F.lit("parts")), "array<string>")
    keyed = F.transform(F.map_entries("legacy"), lambda e: F.struct(F.regexp_extract(e["key"], r"^part_(\d+)$", 1).try_cast("int").alias("n"), e["value"].alias("json")))
    is_object = lambda j: F.coalesce(F.ltrim(j).startswith("{") & F.try_parse_json(j).isNotNull(), F.lit(False))
    keyed = F.array_sort(F.filter(keyed, lambda e: e["n"].isNotNull() & is_object(e["json"])))
    keyed = F.transform(keyed, lambda e, i: F.struct((i + 1).alias("i"), e["json"].alias("json")))
    given = F.filter(F.transform(given, lambda j, i: F.struct((i + 1).alias("i"), j.alias("json"))), lambda x: is_object(x["json"]))
    none = F.create_map().cast("map<string,string>")
    read = lambda j: F.from_json(j, "map<string,string>")
    # one step after the other, so that each text is parsed once: a lambda's body would be worked out again for every use
    parts = F.transform(F.coalesce(given, keyed), lambda x: F.struct(x["i"].alias("i"), read(x["json"]).alias("own")))
    parts = F.transform(parts, lambda x: F.struct(x["i"].alias("i"), x["own"].alias("own"), F.coalesce(read(F.try_element_at(x["own"], F.lit("ai_extracted"))), none).alias("ai")))
    parts = F.transform(parts, lambda x: F.struct(
        x["i"].alias("i"),
        F.map_concat(F.map_filter(x["own"], lambda k, v: (k != "ai_extracted") & ~F.map_contains_key(x["ai"], k)), x["ai"]).alias("f"),
    ))
    at = lambda x, name: F.try_element_at(x["f"], F.lit(name))
    flat = F.transform(parts, lambda x: F.struct(
        F.coalesce(at(x, "part_number").try_cast("int"), x["i"]).alias("part_number"),
        at(x, "notes").alias("notes"),
        at(x, "error").alias("error"),
        F.from_json(at(x, "participants"), _BIDDERS).alias("participants"),
        x["f"].alias("fields"),
    ))
    return tenders.select("tender_id", flat.alias("parts"))


def tender_bids(tenders: DataFrame) -> DataFrame:
    """One row per part and bidder; the first bidder of a part is its winner."""
    parts = tenders.select("tender_id", F.explode("parts").alias("p"))
    bids = parts.select("tender_id", F.col("p.part_number").alias("part_number"), F.posexplode("p.participants").alias("pos", "b"))
    return bids.select("tender_id", "part_number", "pos", "b.*", (F.col("pos") == 0).alias("is_winner"))


RESULT_DOCUMENT = "informacia o vysledku vyhodnotenia ponuk"  # fixed value


def result_documents(tenders: DataFrame) -> DataFrame:
    """Tenders with only the documents about the outcome, and their number."""
    from registra.functions.text import normalize_text

    kept = F.filter("documents", lambda d: F.contains(normalize_text(d["document_type"]), F.lit(RESULT_DOCUMENT)))
    return tenders.withColumn("documents", kept).withColumn("result_document_count", F.size("documents"))


def enrichment_status(contracts: DataFrame) -> DataFrame:
    """Adds status: skipped (already enriched or nothing to read), fetch (only a PDF) or process (stored text)."""
    text = F.length(F.trim(F.coalesce("pdf_text", F.lit("")))) > 0
    status = F.when(nz("scanned_service_type").isNotNull(), "skipped").when(text, "process").when(nz("pdf_url").isNotNull(), "fetch").otherwise("skipped")
    return contracts.withColumn("status", status)


def enrichment_worklist(contracts: DataFrame) -> DataFrame:
    return enrichment_status(contracts).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def enrichment_requests(contracts: DataFrame, most: int = 22_000) -> DataFrame:
    """Requests for the contracts that are to be processed: cleaned text, cut, and the taxonomy."""
    taxonomy = "\n".join(f"{k}: {', '.join(v)}" for k, v in TAXONOMY.items())
    rows = enrichment_status(contracts).filter("status = 'process'")
    return rows.select("seq", "contract_id", truncate(clean_text(F.col("pdf_text")), most).alias("text"), F.lit(taxonomy).alias("taxonomy"))


def service_taxonomy(df: DataFrame, kind: str = "service_type", sub: str = "service_subtype") -> DataFrame:
    """Types and subtypes outside the taxonomy become null; a subtype alone brings its type, one of another type goes."""
    spark = df.sparkSession
    subs = F.broadcast(spark.createDataFrame([(s, t) for t, ss in TAXONOMY.items() for s in ss], "_sub string, _of string"))
    rows = df.withColumn("_s", F.trim(sub)).join(subs, F.col("_s") == F.col("_sub"), "left")
    known = F.when(F.trim(kind).isin(list(TAXONOMY)), F.trim(kind))
    rows = rows.withColumn("_t", F.coalesce(known, F.col("_of")))
    return rows.withColumns({kind: F.col("_t"), sub: F.when(F.col("_of") == F.col("_t"), F.col("_sub"))}).drop("_s", "_t", "_sub", "_of")


_RESPONSE = "service_type string, service_subtype string, suggested_title string, related_contract_number string, supplier_ico string, contract_value double, payment_reason string, contract_type string, summary string, subcontractors string"


def apply_scanned_fields(contracts: DataFrame, responses: DataFrame) -> DataFrame:
    """Contracts with the fields of their response (seq, response: JSON object) as scanned fields; without a response they stay."""
    r = responses.select("seq", F.from_json("response", _RESPONSE).alias("r")).select("seq", "r.*")
    r = service_taxonomy(r)
    names = [c for c in r.columns if c != "seq"]
    r = r.select("seq", F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in names])
    out = contracts.join(r, "seq", "left")
    has = F.coalesce("_has", F.lit(False))
    for c in names:
        old = F.col(f"scanned_{c}") if f"scanned_{c}" in contracts.columns else F.lit(None)
        out = out.withColumn(f"scanned_{c}", F.when(has, F.col(f"_{c}")).otherwise(old))
    return out.drop("_has", *[f"_{c}" for c in names])


def unreadable_candidates(contracts: DataFrame) -> DataFrame:
    """One row: contracts, those with too little text but a local file, and the rest."""
    wanted = ~is_readable(F.col("pdf_text")) & nz("pdf_local_path").isNotNull()
    return contracts.agg(F.count(F.lit(1)).alias("total"), F.count_if(wanted).alias("candidates"), F.count_if(~wanted).alias("skipped"))


def union_contracts(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def ordered_distinct(df: DataFrame, value: str, order: str = "seq") -> DataFrame:
    """Distinct values with where each was first seen."""
    return df.groupBy(value).agg(F.min(order).alias("first_seq"))


def dedup_first(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row per key; an aggregate, so frequent keys need no sort."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("f"))
    return first.select(*keys, "f.*").select(*df.columns)


def contract_tender_join(contracts: DataFrame, tenders: DataFrame) -> DataFrame:
    """Contracts with their tender as one struct, null where there is none; a blank id never matches."""
    key = nz(F.trim(F.col("public_procurement_id").cast("string")))
    t = tenders.select(F.col("tender_id").cast("string").alias("_t"), F.struct(*tenders.columns).alias("tender"))
    # tenders hold whole documents and parts: sorted and merged, never broadcast for the small files that they come from
    return contracts.withColumn("_k", key).join(t.hint("merge"), F.col("_k") == F.col("_t"), "left").drop("_k", "_t")
