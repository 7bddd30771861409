"""Extraction of fields, links and cards from raw pages by declarative rules.

A rule is (kind, argument); the first rule of a field that finds something fills it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogkit.functions.empty import once, strip
from catalogkit.functions.text import clean_ws
from catalogkit.operators.ordered import keep_first


def _found(c: Column) -> Column:
    return once(c, lambda x: F.when(x != "", x))


def strip_tags(c: Column) -> Column:
    return clean_ws(F.regexp_replace(c, r"(?s)<[^>]*>", " "))


def page_title(html: Column, site: str = "") -> Column:
    """The first heading, else the document title up to a bar; the site's own name is none."""
    heading = strip_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    title = strip(F.substring_index(strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), "|", 1))
    return F.coalesce(*[once(c, lambda x: F.when((x != site) & (x != ""), x)) for c in (heading, title)])


def clean_title(c: Column, suffixes: Sequence[str], code: Column | None = None) -> Column:
    out = strip(F.substring_index(c, "|", 1))
    for s in suffixes:
        out = F.regexp_replace(out, re.escape(s) + r"\z", "")
    out = F.when(F.startswith(F.upper(out), F.upper(code)), F.substring(out, F.length(code) + 1, F.length(out))).otherwise(out) if code is not None else out
    return strip(out)


#: a JSON text with its escapes, and a JSON scalar
_TEXT = r'"(?:[^"\\]|\\.)*"'
_SCALAR = rf"{_TEXT}|-?[0-9][0-9.eE+-]*|true|false"


def _unquoted(literal: Column) -> Column:
    """The value of a JSON scalar as text."""
    return F.get_json_object(F.concat(F.lit('{"v":'), literal, F.lit("}")), "$.v")


def json_field(html: Column, name: str) -> Column:
    """A scalar of embedded JSON, as text, wherever the field stands first; its text may hold commas and escapes."""
    return _found(_unquoted(_found(F.regexp_extract(html, rf'(?s)"{re.escape(name)}"\s*:\s*({_SCALAR})', 1))))


def json_names(html: Column, field: str) -> Column:
    """The names in a field that is one object or an array of them."""
    inside = rf"(?:{_TEXT}|[^\]\}}\"])*"
    block = F.regexp_extract(html, rf'(?s)"{re.escape(field)}"\s*:\s*(\[(?:{_TEXT}|[^\]"])*\]|\{{{inside}\}})', 1)
    return F.array_distinct(F.transform(F.regexp_extract_all(block, F.lit(rf'"name"\s*:\s*({_TEXT})'), F.lit(1)), _unquoted))


def json_list(html: Column, field: str, *synonyms: str) -> Column:
    """The first occurrence of a field, or else of a synonym, in repeated JSON fragments, split at separators."""
    first = F.coalesce(*[json_field(html, f) for f in (field, *synonyms)], F.lit(""))
    return F.filter(F.split(first, r"[、,;/]\s*"), lambda x: x != "")


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, in either kind of quotes."""
    return _found(F.coalesce(_found(F.regexp_extract(tag, rf'(?is)(?<![\w-]){name}\s*=\s*"([^"]*)"', 1)), _found(F.regexp_extract(tag, rf"(?is)(?<![\w-]){name}\s*=\s*'([^']*)'", 1))))


def og_image(html: Column) -> Column:
    """The preview image, with the meta tag's attributes in either order and either kind of quotes."""
    return attribute(F.regexp_extract(html, r"""(?is)<meta\b[^>]*property\s*=\s*["']og:image["'][^>]*>""", 0), "content")


def definition(html: Column, names: Sequence[str]) -> Column:
    """The description after the first term of one of the names."""
    return F.coalesce(*[_found(strip_tags(F.regexp_extract(html, rf"(?is)<dt[^>]*>\s*{re.escape(n)}\s*:?\s*</dt>\s*<dd[^>]*>(.*?)</dd>", 1))) for n in names])


def labelled_rows(pages: DataFrame, synonyms: DataFrame, pattern: str = r"(?is)<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>", key: str = "page_id", contains: bool = False) -> DataFrame:
    """(page_id, field, value): label and value pairs whose label a synonym (label, field) names.

    With ``contains`` a label that holds a synonym, or is part of one, counts too, after those that equal one.  Neither side
    is tested against all of the other: the parts of each distinct label, of those lengths that synonyms have, meet the
    synonyms in an equi-join, and the parts of the synonyms, of those lengths that labels have, the labels.  Empty
    labels and synonyms name nothing."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("l"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("v"))
    long = pages.select(key, F.posexplode(pairs).alias("pos", "p"))
    long = long.select(key, "pos", F.lower(F.regexp_replace(strip_tags(F.col("p.l")), r"[:：]\s*\z", "")).alias("label"), strip_tags(F.col("p.v")).alias("value")).where("value <> ''")
    known = synonyms.select(F.lower("label").alias("name"), "field").where("name <> ''").distinct()
    if not contains:
        named = long.join(known, F.col("label") == F.col("name")).withColumn("far", F.lit(0))
    else:
        labels = long.select("label").where("label <> ''").distinct()
        near = parts_that_match(labels, "label", known.select("name").distinct(), "name").unionByName(parts_that_match(known.select("name").distinct(), "name", labels, "label")).distinct()
        named = long.join(near, "label").join(known, "name").withColumn("far", F.when(F.col("name") == F.col("label"), 0).otherwise(1))
    return named.groupBy(key, "field").agg(F.min_by("value", F.struct("far", "pos", "value")).alias("value"))


def parts_that_match(texts: DataFrame, text: str, wanted: DataFrame, name: str) -> DataFrame:
    """(text, name) where a text of ``texts`` holds one of ``wanted``; both tables hold one column of distinct, not empty texts."""
    lengths = F.broadcast(wanted.select(F.length(name).alias("__n")).distinct())
    cut = texts.join(lengths, F.col("__n") <= F.length(text))
    places = cut.withColumn("__at", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("__n") + 1)))
    found = places.select(text, F.substring(F.col(text), F.col("__at"), F.col("__n")).alias(name)).distinct()
    return found.join(wanted, name).select(text, name)


def link_texts(html: Column, href: str, noise: Sequence[str] = (), shortest: int = 1) -> Column:
    """Texts of the links whose address matches, without noise words, first occurrences in order."""
    texts = F.transform(F.regexp_extract_all(html, F.lit(rf'(?is)<a[^>]*href="[^"]*{href}[^"]*"[^>]*>(.*?)</a>'), F.lit(1)), strip_tags)
    return F.array_distinct(F.filter(texts, lambda t: (F.length(t) >= shortest) & ~t.isin(*noise or [""])))


def links(html: Column) -> Column:
    """The addresses of the page's links, in either kind of quotes, first occurrences in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)(?<![\w-])href\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)))


def _resolved(path: Column) -> Column:
    """A path without its . and .. parts."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(""))


def absolute_url(link: Column, page_url: Column) -> Column:
    """Links made absolute by the page's address, with . and .. resolved; a query or fragment stays on the page."""
    scheme, host = F.regexp_extract(page_url, r"^(https?:)", 1), F.regexp_extract(page_url, r"^(https?://[^/?#]+)", 1)
    own = F.regexp_extract(page_url, r"^https?://[^/?#]+([^?#]*)", 1)
    path, more = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)\z", 1)
    folder = F.regexp_extract(own, r"^(.*/)", 1)
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    return (
        F.when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(link == "", page_url).when(F.startswith(link, F.lit("#")), F.concat(F.regexp_extract(page_url, r"^([^#]*)", 1), link))
        .when(F.startswith(link, F.lit("?")), F.concat(host, own, link)).otherwise(F.concat(host, _resolved(full), more))
    )


def lazy_image(html: Column, attributes: Sequence[str] = ("data-src", "data-original", "src")) -> Column:
    """The first image's address, by the preferred attribute."""
    tag = F.regexp_extract(html, r"(?is)<img\b[^>]*>", 0)
    return F.coalesce(*[attribute(tag, a) for a in attributes])


def cards(pages: DataFrame, card: str, fields: dict[str, str], key: str = "page_id") -> DataFrame:
    """A row per card of list pages: each field by its pattern, the first card of each code over pages in order."""
    long = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(card), F.lit(0))).alias("pos", "card"))
    rows = long.select(key, "pos", *[_found(strip_tags(F.regexp_extract("card", p, 1))).alias(f) for f, p in fields.items()])
    return keep_first(rows.where("code IS NOT NULL"), ["code"], [F.col(key), F.col("pos")])


def page_gates(pages: DataFrame, shortest: int = 2000, blocked: Sequence[str] = (), needed: Sequence[str] = ()) -> DataFrame:
    """Adds ``reject_reason``: short, blocked, no_fields (all of ``needed`` null) or null."""
    low = F.lower("html")
    stopped = F.lit(False)
    for phrase in blocked:
        stopped = stopped | low.contains(phrase.lower())
    empty = F.coalesce(*[F.col(c).cast("string") for c in needed]).isNull() if needed else F.lit(False)
    reason = F.when(F.col("html").isNull() | (F.length("html") < shortest), "short").when(stopped, "blocked").when(empty, "no_fields")
    return pages.withColumn("reject_reason", reason)


def sane_duration(c: Column, low: int = 5, high: int = 600) -> Column:
    return F.when(c.between(low, high), c)


def duration(html: Column, unit: str = "min", labels: Sequence[str] = ("duration",)) -> Column:
    """Minutes by the first of: number and unit, ISO duration, labelled number; out of range is none."""
    iso = r"PT(?:(\d+)H)?(?:(\d+)M)?"
    parts = lambda x: [F.regexp_extract(x, iso, i).try_cast("int") for i in (1, 2)]
    whole = lambda h, m: F.when(h.isNotNull() | m.isNotNull(), 60 * F.coalesce(h, F.lit(0)) + F.coalesce(m, F.lit(0)))
    tries = [F.regexp_extract(html, rf"(?i)(\d{{1,4}})\s*{unit}", 1).try_cast("int"), once(F.regexp_extract(html, iso, 0), lambda x: whole(*parts(x)))]
    tries += [F.regexp_extract(html, rf"(?i){re.escape(x)}\D{{0,20}}(\d{{1,4}})", 1).try_cast("int") for x in labels]
    return F.coalesce(*[once(t, lambda x: sane_duration(x)) for t in tries])


def iso_date(c: Column) -> Column:
    """The first date in the text as YYYY-MM-DD; slashes, dots and local units are read too."""
    p = r"(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})"
    year = F.regexp_extract(c, p, 1)
    return F.when(year != "", F.concat_ws("-", year, F.lpad(F.regexp_extract(c, p, 2), 2, "0"), F.lpad(F.regexp_extract(c, p, 3), 2, "0")))


def profile_header(html: Column) -> Column:
    """struct(name, reading, roman) of a heading ``name (reading / roman)``."""
    head = strip_tags(F.regexp_extract(html, r"(?is)<h[12][^>]*>(.*?)</h[12]>", 1))
    p = r"^(.*?)\s*[（(]\s*([^/）)]*?)\s*(?:/\s*([^）)]*?)\s*)?[）)]"
    group = lambda x, i: _found(F.regexp_extract(x, p, i))
    return once(head, lambda x: F.struct(F.coalesce(group(x, 1), _found(x)).alias("name"), group(x, 2).alias("reading"), group(x, 3).alias("roman")))


def sizes(c: Column, letters: Sequence[str] = ("T", "B", "W", "H")) -> Column:
    """struct of whole numbers after each letter of a size text such as ``T160 / B85 / W58 / H86``; null where absent."""
    return once(c, lambda t: F.struct(*[F.regexp_extract(t, rf"(?i)(?<![A-Za-z]){x}\s*[:：]?\s*(\d{{2,3}})", 1).try_cast("int").alias(x.lower()) for x in letters]))


def names_without_notes(c: Column) -> Column:
    """Names of a list parted by separators, without what stands in brackets, in order and once."""
    bare = F.regexp_replace(c, r"[（(][^）)]*[）)]", "")
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(bare, F.lit("")), r"[、,;/]"), strip), lambda x: x != ""))


def accept_snippets(snippets: DataFrame) -> DataFrame:
    """(code, title, snippet) rows that name the code they were asked for; adds ``date``."""
    text = F.upper(F.concat_ws(" ", "title", "snippet"))
    return snippets.where(F.contains(text, F.upper("code"))).withColumn("date", iso_date(F.col("snippet")))


def unlinked_names(html: Column, start: str, end: str, excluded_class: str) -> Column:
    """Link texts of a section, without links that a sibling of the given class follows."""
    section = F.regexp_extract(html, rf"(?is){start}(.*?){end}", 1)
    kept = F.regexp_replace(section, rf'(?is)<a\b[^>]*>[^<]*</a>\s*<\w+[^>]*class="[^"]*{excluded_class}[^"]*"', "")
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(kept, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), strip_tags), lambda t: t != ""))


def extract_pages(pages: DataFrame, rules: dict[str, Column], site: str, priority: int, withheld: Sequence[str] = ()) -> DataFrame:
    """Observations of one site: every field by its column rule; withheld fields stay null."""
    fields = [F.lit(None).cast("string").alias(f) if f in withheld else c.alias(f) for f, c in rules.items()]
    return pages.select("page_id", *fields, F.col("url").alias("source_url"), F.lit(site).alias("source"), F.lit(priority).alias("priority"), "html")
