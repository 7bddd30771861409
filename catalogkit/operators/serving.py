"""Search, facets, groups, rankings and sorts over a curated items table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogkit.functions.text import link_from_template

NONE = "array<string>"


def _array(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(NONE)) if name in df.columns else F.array().cast(NONE)


def add_search_blob(items: DataFrame, texts: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Adds ``search_blob``: all searched fields lower-cased, parted by a control character.

    Stored with the table, a search reads one column and tests one substring."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts] + [F.array_join(_array(items, c), "\u0001") for c in arrays]
    return items.withColumn("search_blob", F.lower(F.concat_ws("\u0001", *parts)))


def search(items: DataFrame, query: str) -> DataFrame:
    """Rows whose search blob holds the query; an empty query gives all."""
    q = query.strip().lower()
    return items.where(F.col("search_blob").contains(q)) if q else items


def facet_filter(items: DataFrame, kind: str, value: str) -> DataFrame:
    """Exact facet: tag (tags, labels or translated tags), maker (maker or label), series, director."""
    if kind == "tag":
        every = F.concat(_array(items, "labels"), _array(items, "tags"), _array(items, "tags_zh"))
        return items.where(F.array_contains(every, value))
    if kind == "maker":
        return items.where((F.col("maker") == value) | (F.col("label") == value))
    if kind in ("series", "director"):
        return items.where(F.col(kind) == value)
    raise ValueError(f"unknown facet {kind}")


def combined_filter(items: DataFrame, owner: str = "", tag: str = "", maker: str = "", series: str = "") -> DataFrame:
    """All criteria, each a trimmed, lower-cased substring; blank ones are ignored."""
    out = items
    name = owner.strip().lower()
    if name:
        out = out.where(F.lower(F.coalesce("owner", F.lit(""))).contains(name) | F.exists(_array(items, "cast"), lambda x: F.lower(x).contains(name)))
    wanted = tag.strip().lower()
    if wanted:
        out = out.where(F.exists(_array(items, "tags"), lambda x: F.lower(x).contains(wanted)))
    k = maker.strip().lower()
    if k:
        out = out.where(F.lower(F.coalesce("maker", F.lit(""))).contains(k) | F.lower(F.coalesce("label", F.lit(""))).contains(k))
    k = series.strip().lower()
    if k:
        out = out.where(F.lower(F.coalesce("series", F.lit(""))).contains(k))
    return out


def lookup(items: DataFrame, code: str) -> DataFrame:
    return items.where(F.col("code") == code)


def records_of(items: DataFrame, main: str = "all", param: str | None = None) -> DataFrame:
    """The record set of a view: all, entity, or a facet."""
    if main == "all":
        return items
    return items.where(F.col("owner") == param) if main == "entity" else facet_filter(items, main, param)


def entities_of_group(entities: DataFrame, field: str, value: str | None) -> DataFrame:
    return entities.where(F.col(field).eqNullSafe(value))


def _facet_values(items: DataFrame, kind: str) -> DataFrame:
    if kind == "tag":
        values = F.explode(_array(items, "tags"))
    elif kind == "maker":
        values = F.explode(F.array("maker", "label"))
    else:
        values = F.col(kind)
    return items.select(values.alias("value")).where("value <> ''")


def facet_browse(items: DataFrame, kind: str, limit: int = 80) -> DataFrame:
    """(value, n) of the most frequent values; maker counts makers and labels both."""
    return _facet_values(items, kind).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def facet_totals(items: DataFrame, kinds: Sequence[str] = ("tag", "maker", "series", "director")) -> DataFrame:
    """(kind, values): how many distinct values each facet has."""
    out = None
    for kind in kinds:
        one = _facet_values(items, kind).agg(F.count_distinct("value").alias("values")).select(F.lit(kind).alias("kind"), "values")
        out = one if out is None else out.unionByName(one)
    return out


#: fixed values: how many values of each kind the overview shows
OVERVIEW = {"maker": 15, "tag": 24, "director": 10, "owner": 15}


def overview(items: DataFrame, shown: dict[str, int] = OVERVIEW) -> DataFrame:
    """(kind, place, value, n): the most frequent values of each kind."""
    out = None
    for kind, n in shown.items():
        top = facet_browse(items, kind, n)
        one = top.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(F.desc("n"), "value")).alias("place"), "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def year_of(date: str = "date") -> Column:
    return F.nullif(F.substring(date, 1, 4), F.lit(""))


def group_by_field(items: DataFrame, key: Column, by_key: bool = False) -> DataFrame:
    """(key, n): groups by count, the null group (blank keys) last; ``by_key`` sorts by key descending."""
    groups = items.groupBy(F.nullif(key, F.lit("")).alias("key")).agg(F.count("*").alias("n"))
    return groups.orderBy(F.col("key").isNull(), *([F.desc("key")] if by_key else [F.desc("n"), "key"]))


def group_records(items: DataFrame, key: Column, order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` records of each group, ranked: the nested view as rows."""
    own = Window.partitionBy("group").orderBy(*order)
    return items.withColumn("group", F.nullif(key, F.lit(""))).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= cap)


def stats_overview(items: DataFrame) -> DataFrame:
    """One row: items, first and last year, rated items and the mean of their ratings."""
    rated = F.when(F.col("rating") != 0, F.col("rating"))
    return items.agg(F.count("*").alias("items"), F.min(year_of()).alias("first_year"), F.max(year_of()).alias("last_year"), F.count(rated).alias("rated"), F.round(F.avg(rated), 4).alias("mean_rating"))


def items_per_year(items: DataFrame) -> DataFrame:
    """(year, n, bar): bar is the percentage of the largest year."""
    years = items.select(year_of().alias("year")).where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n"))
    return years.withColumn("bar", F.round(100 * F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))), 4))


def entity_detail(items: DataFrame) -> DataFrame:
    """(owner, items, first_year, last_year, rated, mean_rating): ratings to one decimal."""
    rated = F.when(F.col("rating") != 0, F.col("rating"))
    return items.groupBy("owner").agg(F.count("*").alias("items"), F.min(year_of()).alias("first_year"), F.max(year_of()).alias("last_year"), F.count(rated).alias("rated"), F.round(F.avg(rated), 1).alias("mean_rating"))


def newest_entities(items: DataFrame, n: int = 12) -> DataFrame:
    """The owners with the latest item dates."""
    return items.where("owner <> ''").groupBy("owner").agg(F.max("date").alias("latest")).orderBy(F.desc_nulls_last("latest"), "owner").limit(n)


def sort_items(items: DataFrame, mode: str) -> DataFrame:
    """date_desc, date_asc, rating, duration or code; nulls sort as "" or 0, and the code breaks ties."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    orders = {"date_desc": lambda: [text("date").desc()], "date_asc": lambda: [text("date")], "rating": lambda: [number("rating").desc()], "duration": lambda: [number("duration").desc()], "code": lambda: []}
    return items.orderBy(*orders[mode](), F.col("code"))


def latest(items: DataFrame, n: int = 60) -> DataFrame:
    return sort_items(items, "date_desc").limit(n)


def head_and_rest(rows: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of a report with ``omitted``, how many are left out; a report is a table of totals."""
    every = rows.agg(F.count("*").alias("n")).scalar()
    return rows.orderBy(*order).limit(n).withColumn("omitted", F.greatest(every - n, F.lit(0)))


def link_union(items: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(code, pos, site, url): manual links, trailer, source, then generated ones; of equal URLs the first.

    ``templates``: (site, template with {code}) in order."""
    fixed = F.concat(
        F.transform(F.map_entries(F.coalesce("external_links", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("site"), e["value"].alias("url"))),
        F.array(F.struct(F.lit("trailer").alias("site"), F.col("trailer").alias("url")), F.struct(F.lit("source").alias("site"), F.col("source_url").alias("url"))),
    )
    own = items.select("code", F.posexplode(fixed).alias("pos", "l")).select("code", "pos", "l.site", "l.url")
    listed = F.array(*[F.struct(F.lit(site).alias("site"), link_from_template(F.lit(template), F.col("code")).alias("url")) for site, template in templates])
    made = items.select("code", F.posexplode(listed).alias("ord", "l")).select("code", (F.col("ord") + 1000).alias("pos"), "l.site", "l.url")
    every = (own.unionByName(made) if templates else own).where("url <> ''")
    return every.groupBy("code", "url").agg(F.min(F.struct("pos", "site")).alias("f")).select("code", "f.pos", "f.site", "url")
