"""Identifiers, names, dates, URLs and other text, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogkit.functions.empty import strip

#: fixed values: prefixes with formats of their own, and the digits they take
SPECIAL_IDS = {"FC2": r"\d{5,7}", "GETCHU": r"\d+", "GYUTTO": r"\d+"}


def _upper(c: Column) -> Column:
    return F.upper(strip(c))


def trim_zeros(digits: Column) -> Column:
    """Leading zeros go only from more than three digits; all zeros leave one."""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(digits) > 3, bare).otherwise(digits)


def normalize_id(c: Column) -> Column:
    """Upper case, one hyphen between letters and digits, padding zeros trimmed; null gives ""."""
    #: fixed values: the grammar of identifiers, joined and parted
    d = _upper(c)
    out = d
    for prefix, digits in reversed(SPECIAL_IDS.items()):
        own = F.regexp_extract(d, rf"^{prefix}[-_]?({digits})$", 1)
        out = F.when(own != "", F.concat(F.lit(f"{prefix}-"), own)).otherwise(out)
    for pattern in (r"^([A-Z]{2,})(\d{2,5})$", r"^([A-Z]{2,10})[-_](\d{2,5})$"):
        letters = F.regexp_extract(d, pattern, 1)
        out = F.when(letters != "", F.concat_ws("-", letters, trim_zeros(F.regexp_extract(d, pattern, 2)))).otherwise(out)
    return F.coalesce(out, F.lit(""))


def guess_id_type(c: Column) -> Column:
    d = normalize_id(c)
    out = F.when(d.rlike(r"^[A-Za-z\d_]{7,19}$"), "cid").otherwise("normal")
    for prefix, digits in reversed(SPECIAL_IDS.items()):
        out = F.when(d.rlike(rf"^{prefix}[-_]?{digits}$"), prefix.lower()).otherwise(out)
    return out


def canon_code(c: Column, split: bool = True) -> Column:
    """Separators become hyphens; with ``split`` letters and digits are parted too.  Digits stay as they are.

    Without ``split`` each run of white space and underscores becomes one hyphen."""
    d = _upper(c)
    if not split:
        return F.regexp_replace(d, r"(?U)[\s_]+", "-")
    d = F.translate(d, " _.", "---")
    return F.regexp_replace(d, r"^([A-Z]+)(\d+)$", "$1-$2")


def extract_code(c: Column) -> Column:
    """The first code in free text, or null."""
    pattern = r"([A-Za-z]{2,8})[_ -]?(\d{2,5})"  #: fixed value: what a code in running text looks like
    letters = F.regexp_extract(c, pattern, 1)
    return F.when(letters != "", F.upper(F.concat_ws("-", letters, F.regexp_extract(c, pattern, 2))))


def parse_code(c: Column) -> Column:
    """struct(series, number) of a code, one trailing letter aside; null if it is none."""
    bare = F.regexp_replace(c, "[A-Za-z]$", "")
    pattern = r"^([A-Za-z]+[0-9]*)-([0-9]+)$"  #: fixed value: series and number of a code
    number = F.regexp_extract(bare, pattern, 2).try_cast("bigint")
    series = F.regexp_extract(bare, pattern, 1)
    return F.when(series != "", F.struct(series.alias("series"), number.alias("number")))


def code_prefix(c: Column) -> Column:
    return F.regexp_extract(_upper(c), "^([A-Z]+)", 1)


def is_code_prefix(value: Column, code: Column) -> Column:
    """Whether the value is no more than the code's leading letters."""
    own = code_prefix(code)
    return F.coalesce((own != "") & (own == _upper(value)), F.lit(False))


def clean_ws(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normalize_name(c: Column, variants: dict[str, str] | None = None) -> Column:
    """Cut at a bracket of either width; then the spelling that ``variants`` (a short literal map) prefers."""
    name = strip(F.substring_index(F.substring_index(strip(F.coalesce(c, F.lit(""))), "（", 1), "(", 1))
    if not variants:
        return name
    known = F.create_map(*[F.lit(x) for pair in variants.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def normalize(c: Column, variants: dict[str, str] | None = None) -> Column:
    """Codes (text starting with a Latin letter) as codes, all else as names."""
    return F.when(c.rlike("^[A-Za-z]"), canon_code(c)).otherwise(normalize_name(c, variants))


def is_chinese(c: Column) -> Column:
    """Han characters and no kana."""
    return F.coalesce(c.rlike(r"[一-鿿㐀-䶿]") & ~c.rlike(r"[぀-ヿ]"), F.lit(False))


def has_kana(c: Column, ignore_marks: bool = False) -> Column:
    """Kana of any width; with ``ignore_marks`` the middle dot and iteration marks do not count."""
    text = F.regexp_replace(c, "[・ヽヾ]", "") if ignore_marks else c
    return F.coalesce(text.rlike(r"[぀-ゟ゠-ヿｦ-ﾟ]"), F.lit(False))


def convert_chars(c: Column, source: str, target: str) -> Column:
    """Character-wise conversion (such as traditional to simplified) by a table the caller gives."""
    return F.translate(c, source, target)


def rewrite_url(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered (pattern, replacement) rules; patterns end with \\z to bind to the end."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def status_from_text(c: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """The status of the first phrase that the text holds, or null."""
    out = F.lit(None).cast("string")
    for phrase, status in reversed(phrases):
        out = F.when(c.contains(phrase), status).otherwise(out)
    return out


def year_in(c: Column, pattern: str) -> Column:
    """The year in the first group of the pattern, or null."""
    return F.regexp_extract(c, pattern, 1).try_cast("int")


#: fixed values: how texts speak of a first and of a renewed year
DEBUT_YEAR = r"(\d{4})\s*年?\s*(?:\d{1,2}\s*月\s*)?(?:デビュー|出道|debut)"
COMEBACK_YEAR = r"(\d{4})\s*年?\s*(?:\d{1,2}\s*月\s*)?(?:復帰|复出|復出|comeback)"


def debut_year(c: Column) -> Column:
    return year_in(F.lower(c), DEBUT_YEAR)


def comeback_year(c: Column) -> Column:
    return year_in(F.lower(c), COMEBACK_YEAR)


def active_span(c: Column, start: str = r"(\d{4})\s*[-~–]", end: str = r"\d{4}\s*[-~–]\s*(\d{4})") -> Column:
    return F.struct(year_in(c, start).alias("start"), year_in(c, end).alias("end"))


def former_marker(lead: Column, tags: Column, words: Sequence[str]) -> Column:
    """Which of the texts marks a former role: lead, tags, or null."""
    pattern = "|".join(words)
    return F.when(lead.rlike(pattern), "lead").when(tags.rlike(pattern), "tags")


def is_recent(date: Column, as_of: Column, days: int = 720) -> Column:
    """Whether the first of the date's month is no more than ``days`` before ``as_of``; unreadable dates are not."""
    month = F.concat(F.regexp_extract(date, r"^(\d{4}-\d{2})", 1), F.lit("-01")).try_cast("date")
    return F.coalesce(month >= F.date_sub(as_of, days), F.lit(False))


def date_precision(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(c.rlike(r"^\d{4}-\d{2}$"), "month").when(c.rlike(r"^\d{4}$"), "year")


def stringify(c: Column, is_array: bool = False) -> Column:
    if is_array:
        return F.coalesce(F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), ";"), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def number_or(c: Column, default: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def duration_minutes(c: Column) -> Column:
    """The first number of at most four digits of a mixed duration text."""
    return F.regexp_extract(c, r"(\d{1,4})", 1).try_cast("int")


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def safe_name(c: Column, limit: int = 120) -> Column:
    """A file name without forbidden characters, of at most ``limit`` characters."""
    t = clean_ws(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|]', "_"))
    return F.rtrim(F.substring(t, 1, limit))


def fill_template(template: str, **fields: Column) -> Column:
    """``{name}`` places filled with columns (null gives nothing)."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return strip(out)


def zero_pad(c: Column, width: Column) -> Column:
    """Pads with zeros and never cuts."""
    text = c.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(text))), text)


def name_candidates(c: Column, swaps: Sequence[tuple[str, str]] = ()) -> Column:
    """Spellings to try, in order and distinct: as it is, with iteration marks written out, with characters swapped."""
    spelled = F.regexp_replace(c, "(.)々", "$1$1")
    return F.array_distinct(F.array(c, spelled, *[F.translate(spelled, a, b) for a, b in swaps]))


def rewrite_prefix(code: Column, rules: dict[str, str]) -> Column:
    """Codes whose letters have a rule (a short literal map) get other letters."""
    letters = code_prefix(code)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), letters)
    return F.when(known.isNotNull(), F.concat(known, F.substring(_upper(code), F.length(letters) + 1, F.length(code)))).otherwise(code)


def link_from_template(template: Column, code: Column) -> Column:
    return F.replace(template, F.lit("{code}"), F.url_encode(code))


def display_value(translated: Column, original: Column, translate: bool = True) -> Column:
    """Translation, else original, else ""."""
    return F.coalesce(F.nullif(translated, F.lit("")), original, F.lit("")) if translate else F.coalesce(original, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first text that is neither null nor empty, such as a poster, else the cover."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def media_kind(ext: Column) -> Column:
    """cover, video or other, by the lower-cased extension with its dot."""
    e = F.lower(ext)
    #: fixed values: the extensions of either kind
    return F.when(e.rlike(r"\.(jpg|jpeg|png|webp|gif|bmp)$"), "cover").when(e.rlike(r"\.(mp4|iso|mkv|ts|wmv|mov)$"), "video").otherwise("other")
