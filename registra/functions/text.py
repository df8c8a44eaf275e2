"""Text, date, price and URL clean-up as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: month names without accents
MONTHS = {
    "januar": 1,
    "februar": 2,
    "marec": 3,
    "april": 4,
    "maj": 5,
    "jun": 6,
    "jul": 7,
    "august": 8,
    "september": 9,
    "oktober": 10,
    "november": 11,
    "december": 12,
}


def _decompositions() -> tuple[str, str, str, list[str]]:
    """Unicode's compatibility decompositions without combining marks, of all code points: those to one character or none as two
    strings for ``translate``, those to several characters as a string and a list.
    """
    ones, marks, many = [], [], []
    for code in [*range(0xD800), *range(0xE000, 0x110000)]:
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain != char:
            (ones if len(plain) == 1 else many if plain else marks).append((char, plain))
    return "".join(c for c, _ in ones + marks), "".join(p for _, p in ones), "".join(c for c, _ in many), [p for _, p in many]


_WITH, _WITHOUT, _MANY, _PARTS = _decompositions()
#: A character for each of those that become several: its code less ``_BASE`` is the place in the list of what they become.
_BASE = 0x20000
_PLACES = "".join(chr(_BASE + i) for i in range(len(_MANY)))
_BETWEEN = "\x1f"  # stands in no decomposition


def _ranges(chars: str) -> str:
    """A regular expression's class of characters that come in rising order."""
    out, codes = [], [ord(c) for c in chars]
    for code in codes:
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


_HAS_MANY = _ranges(_MANY)


def strip_accents(c: Column) -> Column:
    """Characters taken apart as Unicode's compatibility decomposition does, and combining marks dropped. Texts without ligatures and the like are
    translated in one step; others character by character.
    """
    parts = F.split(F.lit(_BETWEEN.join(_PARTS)), _BETWEEN)
    several = lambda x: F.get(parts, F.ascii(F.translate(x, _MANY, _PLACES)) - _BASE)
    apart = F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda x: F.when(x.rlike(_HAS_MANY), several(x)).otherwise(x))
    return F.translate(F.when(c.rlike(_HAS_MANY), F.array_join(apart, "")).otherwise(c), _WITH, _WITHOUT)


_SPACE = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE, "")


def normalize_text(c: Column) -> Column:
    """Lower case, trimmed, without accents and other marks; null is empty."""
    return F.coalesce(F.lower(strip(strip_accents(c))), F.lit(""))


def clean_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def snake_case(c: Column) -> Column:
    out = F.trim(F.regexp_replace(normalize_text(c), "[^a-z0-9]+", "_"))
    return F.coalesce(F.nullif(F.btrim(out, F.lit("_")), F.lit("")), F.lit("field"))


def parse_price(c: Column) -> Column:
    """Slovak price text as a double, null where it is none."""
    text = F.regexp_replace(c, "€|â‚¬| | ", "")
    return F.replace(strip(text), F.lit(","), F.lit(".")).try_cast("double")


def parse_slovak_date(day: Column, month: Column, year: Column) -> Column:
    """Day, name of the month and year as YYYY-MM-DD; the day's range is not checked."""
    known = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    number = F.try_element_at(known, normalize_text(month))  # the name is normalised once, not for each month
    d, y = F.regexp_replace(strip(day), r"\.+$", "").try_cast("int"), strip(year).try_cast("int")
    return F.when(d.isNotNull() & y.isNotNull() & number.isNotNull(), F.format_string("%04d-%02d-%02d", y, number, d))


def parse_dotted_date(c: Column) -> Column:
    """DD.MM.YYYY as YYYY-MM-DD by its text; "not given" and other shapes are null."""
    parts = F.split(strip(c), r"\.", -1)
    pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    whole = F.concat(F.get(parts, F.lit(2)), F.lit("-"), pad(F.get(parts, F.lit(1))), F.lit("-"), pad(F.get(parts, F.lit(0))))
    return F.when((F.size(parts) == 3) & ~F.contains(normalize_text(c), F.lit("neuvedeny")), whole)


def clean_text(c: Column) -> Column:
    """Contract text: line breaks and blanks evened out, letters set apart glued together."""
    # fixed values: the four patterns
    c = F.regexp_replace(c, "\r", "\n")
    c = F.regexp_replace(c, "\n{2,}", "\n")
    c = F.regexp_replace(c, "[ \t]{2,}", " ")
    return strip(F.regexp_replace(c, r"(?U)(\b\w)\s+(?=\w\b)", "$1"))


def safe_filename(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.btrim(out, F.lit("._")), F.lit("")), F.lit("document"))


def is_readable(c: Column, least: int = 30) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, r"\s", "")) >= least, F.lit(False))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def procurement_id(url: Column) -> Column:
    """The number after /tender/, else after /detail/, else the last number in the path."""
    path = _path(url)
    first = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    return F.coalesce(first(r"/tender/(\d+)(?:/|$)"), first(r"/detail/(\d+)(?:/|$)"), F.try_element_at(F.regexp_extract_all(path, F.lit(r"(\d+)"), 1), F.lit(-1)))


def is_tender_summary(url: Column) -> Column:
    return F.coalesce(strip(url).rlike(r"(?i)^https?://josephine\.proebiz\.com/.*/tender/\d+/summary/?$"), F.lit(False))


_PORTAL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(?i:uvo\.gov\.sk|www\.uvo\.gov\.sk|ww\.uvo\.gov\.sk)(?::\d+)?(?:[/?#].*)?$"
_TENDER = r"/(?:vyhladavanie/vyhladavanie-zakaziek|vyhladavanie-zakaziek)/(?:detail(?:/dokumenty)?|dokumenty)/(\d+)"


def canonical_tender_url(url: Column) -> Column:
    """Tender pages of the second portal in one form; scheme and query stay, other hosts and pages are null."""
    u = strip(url)
    scheme, number = F.regexp_extract(u, _PORTAL, 1), F.regexp_extract(u, _TENDER, 1)
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]+)", 1)
    return F.when((scheme != "") & (number != ""), F.concat(F.lower(scheme), F.lit("://www.uvo.gov.sk/vyhladavanie/vyhladavanie-zakaziek/detail/"), number, query))


def documents_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^([^?#]*/vyhladavanie/vyhladavanie-zakaziek/)detail/(\d+)", "$1dokumenty/$2")


def listing_url(url: Column, page: Column, params: dict[str, str | None] | None = None) -> Column:
    """The URL with the parameters in place of its own and the page number; others keep their place."""
    base, query = F.substring_index(F.substring_index(url, "#", 1), "?", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_extract(x, "=(.*)", 1).alias("v")))
    new = {k: F.url_encode(F.lit(str(v))) for k, v in (params or {}).items() if v is not None} | {"page": page.cast("string")}
    for k, v in new.items():
        put = F.struct(F.lit(k).alias("k"), v.alias("v"))
        pairs = F.when(F.exists(pairs, lambda x: x["k"] == k), F.transform(pairs, lambda x: F.when(x["k"] == k, put).otherwise(x))).otherwise(F.concat(pairs, F.array(put)))
    return F.concat(base, F.lit("?"), F.array_join(F.transform(pairs, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&"))


def url_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/zmluva/(\d+)/", 1), F.lit(""))


def cpv_entries(c: Column) -> Column:
    """Array of (code, name) of a text that repeats "12345678-9 - name"."""
    text, pattern = clean_whitespace(c), r"(\d{8}-\d)\s*-\s*(.*?)(?=\s+\d{8}-\d\s*-|$)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("code"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("name"))
    named = F.transform(pairs, lambda x: F.struct(x["code"].alias("code"), F.trim(x["name"]).alias("name")))
    return F.coalesce(F.filter(named, lambda x: x["name"] != ""), F.array().cast("array<struct<code:string,name:string>>"))


def json_recover(c: Column) -> Column:
    """The JSON object in a text, also from its first to its last brace; null where there is none."""
    return F.when(F.try_parse_json(c).isNotNull() & strip(c).startswith("{"), strip(c)).otherwise(_braced(c))


def _braced(c: Column) -> Column:
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)


def sanitise_message(c: Column, most: int = 4000) -> Column:
    """Without control characters, cut and trimmed; null where nothing is left."""
    return F.nullif(strip(F.substring(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), 1, most)), F.lit(""))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def token_cost(prompt: Column, completion: Column) -> Column:
    """0.00015 for a thousand prompt and 0.0006 for a thousand completion tokens, to a millionth, halves up; in whole numbers."""
    return F.floor((prompt * 15 + completion * 60 + 50) / 100) / 1_000_000


def mentioned_years(c: Column) -> Column:
    """Every year from 2010 to 2029 in a text, in order."""
    return F.regexp_extract_all(c, F.lit(r"\b(20[12]\d)\b"), F.lit(1))


def absolute_url(base: Column, link: Column) -> Column:
    """A link of a page made absolute: with a scheme, from the host, from the root or beside the page."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(_path(base), r"^(.*/)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, _path(base), link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )
