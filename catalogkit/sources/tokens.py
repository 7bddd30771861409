"""Pages as streams of elements, for rules that depend on the order and nesting of tags.

One Arrow pass reads each page once and gives a row per element: its place, depth, parent, tag, attributes and text.
Rules are joins and windows over these rows: children share a parent, and siblings follow each other by their place.

Elements close as browsers close them, as far as such rules need: void elements hold nothing, a closing tag closes
the elements left open inside its own, one without an open element is ignored, some elements end where a like one
starts (IMPLIED), and what is open at the end of a page ends there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogkit.functions.text import clean_ws

# fixed values: elements without content, and elements that end where one of the given names starts
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = tuple("p div ul ol dl table section article header footer nav h1 h2 h3 h4 h5 h6 pre form".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "p": BLOCKS, "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table div section body html select".split())  # an implied end looks no further than these

ELEMENT = "place int, depth int, parent int, tag string, attrs map<string,string>, text string"
ARROW = pa.schema([("place", pa.int32()), ("depth", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])


class Elements(HTMLParser):
    """The elements of one page in the order of their starts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[int] = []
        self.text: list[str] = []
        self.size = 0

    def end(self, n: int) -> None:
        """Ends the open elements from number ``n`` on."""
        for at in self.open[n:]:
            self.found[at]["end"] = self.size
        del self.open[n:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for n in range(len(self.open) - 1, -1, -1):
            own = self.found[self.open[n]]["tag"]
            if tag in IMPLIED.get(own, ()):
                self.end(n)
            if own in SCOPES:
                break
        known: dict[str, str] = {}
        for name, value in attrs:
            known.setdefault(name, value or "")  # the first of a repeated attribute counts
        parent = self.open[-1] if self.open else None
        self.found.append({"place": len(self.found), "depth": len(self.open), "parent": parent, "tag": tag, "attrs": list(known.items()), "start": self.size, "end": self.size})
        if tag not in VOID:
            self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements

    def handle_endtag(self, tag: str) -> None:
        for n in range(len(self.open) - 1, -1, -1):
            if self.found[self.open[n]]["tag"] == tag:
                self.end(n)
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.found[self.open[-1]]["tag"] not in ("script", "style"):
            self.text.append(data)
            self.size += len(data)


def elements_of(html: str | None, wanted: frozenset[str] | None = None) -> list[dict]:
    """The elements of a page, of ``wanted`` tags if given, with all text inside each."""
    page = Elements()
    page.feed(html or "")
    page.close()
    page.end(0)
    text = "".join(page.text)
    return [{**{k: e[k] for k in ("place", "depth", "parent", "tag", "attrs")}, "text": text[e["start"] : e["end"]]} for e in page.found if wanted is None or e["tag"] in wanted]


def elements(pages: DataFrame, key: str = "page_id", html: str = "html", tags: Sequence[str] | None = None) -> DataFrame:
    """(key, place, depth, parent, tag, attrs, text) of every element, or those of some ``tags``; text is all text inside.

    A null or empty page has none.  Of a repeated attribute the first counts; names of tags and attributes are in lower
    case.  Text inside nested elements is repeated in each, so name the ``tags`` where pages nest deeply."""
    wanted = frozenset(tags) if tags else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = elements_of(batch.column(1)[i].as_py(), wanted)
                if found:
                    rows = pa.RecordBatch.from_pylist(found, ARROW)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(found), batch.column(0).type), *rows.columns], names=["key", *ARROW.names])

    chosen = pages.select(F.col(key), F.col(html).cast("string").alias("html"))
    return chosen.mapInArrow(run, f"key {dict(chosen.dtypes)[key]}, {ELEMENT}").withColumnRenamed("key", key)


def with_next(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Adds ``next``: the element after each among its siblings, as struct(tag, attrs, text); null for the last."""
    siblings = Window.partitionBy(key, "parent").orderBy("place")
    return rows.withColumn("next", F.lead(F.struct("tag", "attrs", "text")).over(siblings))


def has_class(attrs: str, name: str):
    """Whether an element's class attribute holds the word ``name``: ``male`` is not in ``female``."""
    return F.coalesce(F.array_contains(F.split(F.trim(F.col(attrs)["class"]), r"\s+"), name), F.lit(False))


def unmarked(pages: DataFrame, mark_class: str, mark_text: str, tag: str = "a", inside: str | None = None, key: str = "page_id") -> DataFrame:
    """(key, names): the texts of links, or of another ``tag``, in order and once, but those whose next sibling has the class
    ``mark_class`` or holds ``mark_text``; with ``inside`` only those somewhere in an element of that class.  Pages without
    any have no row."""
    rows = with_next(elements(pages, key), key)
    marked = has_class("next.attrs", mark_class) | F.coalesce(F.contains("next.text", F.lit(mark_text)), F.lit(False))
    links = rows.where((F.col("tag") == tag) & ~marked).select(key, "place", clean_ws(F.col("text")).alias("name")).where("name <> ''")
    if inside is not None:
        # an element's descendants are the elements after it and before the next one that is no deeper
        later = Window.partitionBy(key).orderBy("place").rowsBetween(1, Window.unboundedFollowing)
        scope = F.when(has_class("attrs", inside), F.struct("place", "depth"))
        ends = F.array_min(F.transform(F.filter(F.collect_list(F.struct("place", "depth")).over(later), lambda e: e["depth"] <= F.col("depth")), lambda e: e["place"]))
        scopes = rows.withColumn("end", F.when(scope.isNotNull(), ends)).where(scope.isNotNull()).select(F.col(key).alias("__k"), F.col("place").alias("start"), F.coalesce("end", F.lit(2**31 - 1)).alias("end"))
        links = links.join(scopes, (F.col(key) == F.col("__k")) & (F.col("place") > F.col("start")) & (F.col("place") < F.col("end")), "left_semi")
    first = links.groupBy(key, "name").agg(F.min("place").alias("place"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))
