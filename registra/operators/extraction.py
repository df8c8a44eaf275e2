"""Page tables (page_id, url, html) to rows: register listings, contract details and tender pages.

``cells`` turns pages into one table of elements: a small reader on the standard library's HTML parser gives each element of interest
a row with its text, its attributes and where it stands (card, table, row, cell, list item, heading). Everything else is relational
work on that table: filters, groups by where elements stand, and picks by position. Malformed markup is read
leniently: unknown end tags are ignored, an open cell or item ends where the next one begins.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.functions import text as X

#: Elements that become rows; "#text" is a run of text that stands in none of them.
KEPT = frozenset(["a", "dd", "dt", "h2", "li", "span", "strong", "td", "th", "#text"])
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
_WALLS = frozenset(["ul", "ol", "dl", "table"])
#: Where an element stands: the number of the nearest element around it that fits, by column.
_AROUND = {"card": lambda t, c: t == "div" and "card" in c, "body": lambda t, c: t == "div" and "card-body" in c, "tbl": lambda t, c: t == "table", "tbody": lambda t, c: t == "tbody", "tr": lambda t, c: t == "tr", "cell": lambda t, c: t in ("td", "th"), "item": lambda t, c: t == "li", "dl": lambda t, c: t == "dl", "link": lambda t, c: t == "a", "main": lambda t, c: t == "main"}
CELLS = (
    "page_id long, url string, ord int, tag string, text string, glued string, parts array<string>, classes array<string>, title string, href string, "
    + ", ".join(f"{c} int" for c in _AROUND)
    + ", table_classes array<string>, onclick string, heading string, heading_ord int, card_name string, pos int, n_cells int"
)
CHUNK = 2_000  #: elements that a task holds as a table at most, and those of one page more


class _Reader(HTMLParser):
    """Collects one dictionary for each kept element, in the order in which they begin."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[dict] = []  # tag, place and, for kept elements, the row
        self.n = 0
        self.heading: dict | None = None
        self.card_names: dict[int, dict] = {}  # of each card its first header
        self.cells: dict[int, dict[int, int]] = {}  # of each table row the places of its cells

    def _begin(self, tag: str, attrs: dict[str, str]) -> dict:
        self.n += 1
        around = self.open[-1] if self.open else {"at": dict.fromkeys(_AROUND), "table_classes": [], "onclick": None, "mute": False}
        classes = attrs.get("class", "").split()
        node = {"tag": tag, "at": around["at"] | {k: self.n for k, fits in _AROUND.items() if fits(tag, classes)}}
        node["table_classes"] = classes if tag == "table" else around["table_classes"]
        node["onclick"] = attrs.get("onclick") if tag == "tr" else around["onclick"]
        node["mute"] = around["mute"] or tag in ("script", "style")
        if tag in KEPT:
            head = self.heading or {}
            row = {"ord": self.n, "tag": tag, "parts": [], "classes": classes, "title": attrs.get("title"), "href": attrs.get("href") or None, **around["at"], "table_classes": node["table_classes"], "onclick": node["onclick"], "head": head}
            node["row"] = row
            self.found.append(row)
            if tag == "h2":
                self.heading = row
                if "card-header" in classes and row["card"] is not None:
                    self.card_names.setdefault(row["card"], row)
            elif tag == "td" and row["tr"] is not None:
                places = self.cells.setdefault(row["tr"], {})
                places[self.n] = len(places)
        return node

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] in _WALLS or tag not in _ENDS:
                break
            if self.open[i]["tag"] in _ENDS[tag]:
                del self.open[i:]
                if tag != "tr":
                    break
        node = self._begin(tag, {k: v or "" for k, v in attrs})
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._begin(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if not text or (self.open and self.open[-1]["mute"]):
            return
        holders = [n["row"] for n in self.open if "row" in n] or [self._begin("#text", {})["row"]]
        for row in holders:
            row["parts"].append(text)

    def rows(self) -> Iterator[dict]:
        for r in self.found:
            head = r["head"]
            name, places = self.card_names.get(r["card"]), self.cells.get(r["tr"], {})
            yield r | {
                "text": " ".join(" ".join(r["parts"]).split()), "glued": "".join(r["parts"]), "heading": " ".join(head["parts"]) if head else None, "heading_ord": head.get("ord"),
                "card_name": "".join(name["parts"]) if name else None, "pos": places.get(r["ord"] if r["tag"] == "td" else r["cell"]), "n_cells": len(places),
            }


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Elements of pages in tables of about ``CHUNK`` rows, however many pages come at once."""
    names = [c.split()[0] for c in CELLS.split(", ")]

    def table(out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).astype({c: "Int32" for c in (*_AROUND, "heading_ord", "ord", "pos", "n_cells")})

    for part in batches:
        out: list[dict] = []
        for page_id, url, html in zip(part.page_id, part.url, part.html):
            reader = _Reader()
            reader.feed(html or "")
            reader.close()
            out += [{"page_id": page_id, "url": url} | r for r in reader.rows()]
            if len(out) >= CHUNK:
                yield table(out)
                out = []
        yield table(out)


def cells(pages: DataFrame) -> DataFrame:
    """One row for each element of interest of each page; see ``CELLS``. A null page has none.

    ``card_name`` is the first header of the element's card; ``pos`` the place (from zero) of its cell in the table row, and ``n_cells`` how
    many that row has. So what is asked about cards and rows takes one reading of the pages.
    """
    return pages.select("page_id", "url", "html").mapInPandas(_tables, CELLS)


def _is(*tags: str) -> Column:
    return F.col("tag").isin(*tags)


def _has(classes: str, name: str) -> Column:
    return F.array_contains(classes, name)


def _nth(condition: Column, value: Column | str, n: int = 0) -> Column:
    """Aggregate: the value of the n-th element (from zero) that fits, in the order of the page."""
    value = F.col(value) if isinstance(value, str) else value
    found = F.array_sort(F.collect_list(F.when(condition, F.struct("ord", value.alias("v")))))
    return F.get(F.transform(found, lambda x: x["v"]), F.lit(n))


def _first(condition: Column, value: Column | str) -> Column:
    """Aggregate: the value of the first element that fits."""
    return F.min_by(F.col(value) if isinstance(value, str) else value, F.when(condition, F.col("ord")))


def _positions(rows: DataFrame) -> DataFrame:
    """Elements in cells of table rows: ``pos`` is their cell's place, ``n_cells`` counts the row's cells."""
    return rows.filter("tr IS NOT NULL AND pos IS NOT NULL")


def listing_rows(pages: DataFrame, base: str) -> DataFrame:
    """Rows of a register listing: date parts, title, link, number, price, parties and id."""
    rows = _positions(cells(pages).filter(_has("table_classes", "table_list") & F.col("tbody").isNotNull())).filter("n_cells >= 5")
    at = lambda pos, *tags: (F.col("pos") == pos) & _is(*tags)
    day = at(0, "span") & _has("classes", "d-block")
    raw = rows.groupBy("page_id", "tr").agg(
        *[_nth(day, "glued", i).alias(c) for i, c in enumerate(("day", "month", "year"))],
        _first(at(1, "a"), "glued").alias("title"), _first(at(1, "a"), "href").alias("href"), _first(at(1, "span"), "glued").alias("number"),
        _first(at(2, "td"), "glued").alias("price"), _first(at(3, "td"), "glued").alias("supplier"), _first(at(4, "td"), "glued").alias("buyer"),
    )
    whole = F.col("year").isNotNull()
    raw = raw.withColumns({c: F.when(whole, F.col(c)) for c in ("day", "month", "year")})
    link = X.absolute_url(F.lit(base), F.col("href"))
    return raw.select(
        "page_id", F.col("tr").alias("ord"), F.col("day").alias("published_day"), F.col("month").alias("published_month"), F.col("year").alias("published_year"),
        X.parse_slovak_date(F.col("day"), F.col("month"), F.col("year")).alias("published_date"), F.col("title").alias("contract_title"), F.col("number").alias("contract_number"),
        F.col("price").alias("price_raw"), X.parse_price(F.col("price")).alias("price_numeric_eur"), "supplier", "buyer", link.alias("contract_url"), X.url_id(link).alias("contract_id"),
    )


def label_values(pages: DataFrame) -> DataFrame:
    """(page_id, url, ord, card, label, value, href, link_text): list items with a label, in cards and elsewhere (card null)."""
    rows = cells(pages).withColumn("item", F.when(_is("li"), F.col("ord")).otherwise(F.col("item")))
    items = rows.filter("item IS NOT NULL").groupBy("page_id", "url", "item").agg(
        _first(_is("li"), F.when(F.col("body").isNotNull(), F.col("card_name"))).alias("card"),
        _first(_is("strong"), "text").alias("raw"), _first(_is("span"), "text").alias("span"), _first(_is("li"), "text").alias("whole"),
        _first(_is("a"), "href").alias("href"), _first(_is("a"), "text").alias("link_text"),
    )
    label = F.trim(F.regexp_replace("raw", r":+$", ""))
    at = F.expr("instr(whole, raw)")  # without the label
    rest = F.concat(F.substring(F.col("whole"), F.lit(1), at - 1), F.substring(F.col("whole"), at + F.length("raw"), F.length("whole")))
    value = F.nullif(F.when(F.col("span").isNotNull(), F.col("span")).otherwise(F.btrim(rest, F.lit(" :"))), F.lit(""))
    return items.filter(label != "").select("page_id", "url", F.col("item").alias("ord"), "card", label.alias("label"), value.alias("value"), "href", F.when(F.col("link_text") != "", F.col("link_text")).alias("link_text"))


def detail_identification(labels: DataFrame, base: str) -> DataFrame:
    """Fields of the identification card; an ICO belongs to the party named last before it."""
    rows = labels.filter(F.contains(X.normalize_text(F.col("card")), F.lit("identifik"))).withColumn("n", X.normalize_text(F.col("label")))
    has = lambda t: F.contains("n", F.lit(t))
    number, ident = has("c. zmluvy") | has("cislo zmluvy"), has("id zmluvy")
    open_ = ~number & ~ident
    party = F.when(open_ & has("objednavatel"), "buyer").when(open_ & has("dodavatel"), "supplier").when(open_ & has("rezort"), "rezort")
    before = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("party", party).withColumn("entity", F.last("party", ignorenulls=True).over(before))
    field = (
        F.when(number, "contract_number_detail").when(ident, "contract_id_detail").when(F.col("party") == "rezort", "rezort")
        .when(F.col("party").isNotNull(), F.concat("party", F.lit("_detail"))).when(F.col("n") == "typ", "contract_type")
        .when(F.col("n") == "ico", F.concat(F.lit("ico_"), "entity"))
    )
    rows = rows.withColumn("field", field)
    names = "contract_number_detail contract_id_detail buyer_detail supplier_detail rezort contract_type ico_buyer ico_supplier ico_rezort".split()
    return rows.groupBy("page_id").agg(*[F.max_by(F.when(F.col("field") == c, F.col("value")), F.when(F.col("field") == c, F.col("ord"))).alias(c) for c in names])


def detail_dates(labels: DataFrame) -> DataFrame:
    """The four dates of the dates card."""
    rows = labels.filter(F.contains(X.normalize_text(F.col("card")), F.lit("datum"))).withColumn("n", X.normalize_text(F.col("label")))
    # fixed values: the labels of the four dates
    names = {"date_published": "datum zverejnenia", "date_concluded": "datum uzavretia", "date_effective": "datum ucinnosti", "date_valid_until": "datum platnosti do"}
    return rows.groupBy("page_id").agg(*[F.max_by(F.when(F.contains("n", F.lit(t)), X.parse_dotted_date(F.col("value"))), F.when(F.contains("n", F.lit(t)), F.col("ord"))).alias(c) for c, t in names.items()])


def detail_attachments(pages: DataFrame, base: str) -> DataFrame:
    """Absolute links to PDF files of the attachments card, in order; the first is the primary one."""
    links = cells(pages).filter(_is("a") & F.col("body").isNotNull() & F.contains(F.lower("href"), F.lit(".pdf")))
    links = links.filter(F.contains(X.normalize_text(F.col("card_name")), F.lit("priloha")))
    links = links.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ord", X.absolute_url(F.lit(base), F.col("href")).alias("u")))).alias("l"))
    return links.select("page_id", F.transform("l", lambda x: x["u"]).alias("pdf_urls"), F.get(F.transform("l", lambda x: x["u"]), F.lit(0)).alias("pdf_url"))


def detail_procurement_link(labels: DataFrame, base: str) -> DataFrame:
    """The procurement link: of the identification card, else the first anywhere in the page."""
    rows = labels.filter(F.contains(X.normalize_text(F.col("label")), F.lit("verejne obstaravanie")))
    inside = F.coalesce(F.contains(X.normalize_text(F.col("card")), F.lit("identifik")), F.lit(False))
    best = rows.groupBy("page_id").agg(
        F.min_by(F.struct("href", "link_text"), F.when(F.col("href").isNotNull(), F.struct((~inside).alias("o"), "ord"))).alias("l"),
        F.max_by(F.when(inside, F.col("value")), F.when(inside, F.col("ord"))).alias("portal"),
    )
    url = X.absolute_url(F.lit(base), F.col("l.href"))
    return best.select("page_id", url.alias("public_procurement_url"), X.procurement_id(url).alias("public_procurement_id"), F.coalesce("l.link_text", "portal").alias("public_procurement_portal"))


def canonical_listing_url(pages: DataFrame, base: str) -> DataFrame:
    """The listing that a page's filter form leads to; null where it is the page itself."""
    form = F.regexp_extract("html", r"(?is)<form\b[^>]*\bid=[\"']frm_filter_[^>]*>", 0)
    action = F.nullif(F.regexp_extract(form, r"(?is)\baction=[\"']([^\"']+)[\"']", 1), F.lit(""))
    url = X.absolute_url(F.lit(base), action)
    same = F.rtrim(url, F.lit("/")) == F.rtrim(F.col("url"), F.lit("/"))
    return pages.select("page_id", F.when(~same, url).alias("listing_url"))


# fixed values: labels of the first portal's tender pages and the fields they become
SECTIONS = {
    "informacie": ("info", {
        "ID zákazky": "notice_id", "Názov predmetu": "subject_name", "Číslo spisu": "file_reference", "Číslo z vestníka VO": "bulletin_vo_number",
        "Číslo z vestníka EU": "bulletin_eu_number", "Druh postupu": "procedure_type", "Typ šablóny": "template_type", "Druh obstarávania": "procurement_type",
        "Výsledok obstarávania": "procurement_result", "Predpokladaná hodnota": "estimated_value", "Hlavný CPV": "main_cpv", "Doplňujúci CPV": "additional_cpv",
        "Obstarávanie sa delí na časti": "is_divided_into_parts", "Elektronická aukcia": "electronic_auction", "Centrálne obstarávanie": "central_procurement",
        "NUTS": "nuts", "Stručný opis": "short_description", "Kritérium na vyhodnotenie ponúk": "evaluation_criterion", "Na vyhodnotenie je určená cena": "evaluation_price_basis",
    }),
    "verejny obstaravatel": ("buyer", {
        "Názov organizácie": "buyer_organization_name", "Adresa": "buyer_address", "Procesný garant": "buyer_process_guarantor",
        "Internetový odkaz na profil obstarávateľa": "buyer_profile_url",
    }),
    "terminy": ("term", {"Lehota na predkladanie ponúk": "offer_submission_deadline", "Plánované otváranie ponúk": "planned_opening_time"}),
}
# fixed values: labels (without accents) of the second portal's tender pages
PORTAL2 = {
    "nazov zakazky": "subject_name",
    "obstaravatel": "buyer_organization_name",
    "datum vytvorenia": "info_date_created",
    "datum poslednej aktualizacie": "info_date_last_updated",
    "stav zakazky": "procurement_result",
    "cpv zakazky": "main_cpv",
    "nuts zakazky": "nuts",
    "druh zakazky": "procurement_type",
    "druh postupu": "procedure_type",
    "spolufinancovanie z fondov eu": "info_eu_funds_cofinancing",
    "obrana / bezpecnost": "info_defense_security",
    "datum zverejnenia": "info_date_published",
    "elektronicka aukcia": "electronic_auction",
}


def _under_headings(rows: DataFrame, part: str) -> DataFrame:
    """Elements in the first list or table (column ``part``) after each heading."""
    first = F.min(part).over(Window.partitionBy("page_id", "heading_ord"))
    return rows.filter(F.col(part).isNotNull() & F.col("heading_ord").isNotNull()).withColumn("first", first).filter(F.col(part) == F.col("first"))


def tender_sections(pages: DataFrame) -> DataFrame:
    """(page_id, section, field, value): label lists below the three headings, labels translated or prefixed."""
    spark = pages.sparkSession
    words = F.broadcast(spark.createDataFrame([(s, label, name) for s, (_, names) in SECTIONS.items() for label, name in names.items()], "s string, label string, field string"))
    prefixes = F.broadcast(spark.createDataFrame([(s, p) for s, (p, _) in SECTIONS.items()], "s string, prefix string"))
    later = Window.partitionBy("page_id", "dl").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    rows = _under_headings(cells(pages).filter(_is("dt", "dd")), "dl").withColumn("value", F.first(F.when(_is("dd"), F.col("text")), ignorenulls=True).over(later))
    rows = rows.filter(_is("dt") & (F.col("text") != "") & F.col("value").isNotNull()).select("page_id", "ord", X.normalize_text(F.col("heading")).alias("s"), F.col("text").alias("label"), "value")
    rows = rows.join(prefixes, "s").join(words, ["s", "label"], "left").withColumn("field", F.coalesce("field", F.concat("prefix", F.lit("_"), X.snake_case(F.col("label")))))
    return rows.groupBy("page_id", F.col("prefix").alias("section"), "field").agg(F.max_by("value", "ord").alias("value"))


def _with_links(rows: DataFrame) -> DataFrame:
    return rows.withColumn("link", X.absolute_url(F.col("url"), F.col("href"))).drop("href", "url", "tr")


def tender_documents(pages: DataFrame) -> DataFrame:
    """Rows of the documents table of the first portal."""
    tables = _under_headings(cells(pages), "tbl").filter((F.lower(F.trim("heading")) == "dokumenty") & F.col("tbody").isNotNull())
    rows = _positions(tables).filter("n_cells >= 4")
    cell = lambda pos: _first((F.col("pos") == pos) & _is("td"), "text")
    titled = (F.col("pos") == 0) & _is("span") & F.col("title").isNotNull()
    last = F.col("pos") == F.col("n_cells") - 1
    first_link = F.min(F.when(last & _is("a") & F.col("href").isNotNull(), F.col("ord"))).over(Window.partitionBy("page_id", "tr"))
    rows = rows.withColumn("first_link", first_link)
    out = rows.groupBy("page_id", "url", "tr").agg(
        cell(0).alias("document_name"), F.coalesce(_first(titled & ~_has("classes", "file-icon"), "title"), _first(titled, "title")).alias("document_title"),
        cell(1).alias("document_type"), cell(2).alias("file_size"), cell(3).alias("uploaded_at"), _first(_is("a") & (F.col("ord") == F.col("first_link")), "href").alias("href"),
        F.coalesce(_first(_is("span") & (F.col("link") == F.col("first_link")), F.exists("classes", lambda x: F.contains(x, F.lit("external-link")))), F.lit(False)).alias("is_external_link"),
    )
    return _with_links(out.withColumn("document_title", F.nullif(X.clean_whitespace(F.col("document_title")), F.lit(""))))


def portal2_detail(pages: DataFrame) -> DataFrame:
    """(page_id, field, value): header and value cells of the main tables of the second portal."""
    words = F.broadcast(pages.sparkSession.createDataFrame(list(PORTAL2.items()), "n string, field string"))
    rows = cells(pages).filter(F.col("main").isNotNull() & F.col("tr").isNotNull() & _is("th", "td"))
    rows = rows.groupBy("page_id", "tr").agg(_first(_is("th"), "text").alias("label"), _first(_is("td"), "text").alias("value"))
    rows = rows.withColumn("label", F.regexp_replace("label", ":+$", "")).filter((F.col("label") != "") & (F.col("value") != ""))
    rows = rows.withColumn("n", X.normalize_text(F.col("label"))).join(words, "n", "left")
    rows = rows.withColumn("field", F.coalesce("field", F.concat(F.lit("info_"), X.snake_case(F.col("label")))))
    return rows.groupBy("page_id", "field").agg(F.max_by("value", "tr").alias("value"))


def portal2_documents(pages: DataFrame) -> DataFrame:
    """Rows of the second portal's documents table, which is known by a header; links come from the rows' click handlers."""
    known = F.when(_is("th") & F.contains(F.lower("text"), F.lit("druh dokumentu")), F.col("tbl"))
    rows = cells(pages).withColumn("wanted", F.min(known).over(Window.partitionBy("page_id")))
    rows = _positions(rows.filter((F.col("tbl") == F.col("wanted")) & F.col("tbody").isNotNull())).filter("n_cells >= 4")
    cell = lambda pos: _first((F.col("pos") == pos) & _is("td"), "text")
    out = rows.groupBy("page_id", "url", "tr").agg(cell(1).alias("document_name"), cell(0).alias("document_type"), cell(3).alias("uploaded_at"), F.first("onclick", ignorenulls=True).alias("onclick"))
    target = F.nullif(F.regexp_extract("onclick", r"window\.location\.href\s*=\s*['\"]([^'\"]+)['\"]", 1), F.lit(""))
    out = out.select("page_id", "url", "tr", "document_name", F.nullif("document_name", F.lit("")).alias("document_title"), "document_type", F.lit(None).cast("string").alias("file_size"), "uploaded_at", target.alias("href"), F.lit(False).alias("is_external_link"))
    return _with_links(out)


def portal2_file_meta(pages: DataFrame) -> DataFrame:
    """Title and size of the file cell (the text after the colon) and its link."""
    rows = cells(pages).withColumn("line", F.explode("parts")).withColumn("n", X.normalize_text(F.col("line")))
    value = F.nullif(F.trim(F.regexp_replace("line", "^[^:]*:", "")), F.lit(""))
    pick = lambda t: F.max_by(F.when(F.startswith("n", F.lit(t)), value), F.when(F.startswith("n", F.lit(t)), F.col("ord")))
    return rows.groupBy("page_id").agg(pick("nazov suboru").alias("document_title"), pick("velkost").alias("file_size"), _first(_is("a") & F.col("href").isNotNull(), "href").alias("download_link"))


def page_title(pages: DataFrame) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", F.nullif(X.clean_whitespace(title), F.lit("")).alias("page_title"))


def page_links(pages: DataFrame) -> DataFrame:
    """Links of each page in order, made absolute."""
    links = F.regexp_extract_all("html", F.lit(r"<a\b[^>]*\bhref=\"([^\"]*)\""), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(links).alias("ord", "href"))
    return rows.select("page_id", "ord", "href", X.absolute_url(F.col("url"), F.col("href")).alias("link"))
