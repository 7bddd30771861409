"""Substring search over many fields by an inverted index of character grams.

The index is three tables.  ``terms`` holds every distinct searched value, lower-cased, once: texts of the items, their
owners' translations and aliases, and the translations of their tags.  ``grams`` posts each term under its distinct grams
of one to GRAM characters.  ``posts`` says which items a term belongs to.  A query takes the terms that all its grams
name (its own text, if it is short), verifies each by ``contains`` and follows them to items.  So its work grows with
the postings that it reads and the items that it finds, not with the catalogue.

``write`` stores each table in folders by the hash of its key, sorted within them.  A query's grams are known before its
plan is made, so of a stored index only the folders of these grams are read; terms and posts are joined by folder too, for Spark to
leave out the folders of no candidate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
DIGITS = 2  # hexadecimal digits of a stored index's folders
TEXTS = ("code", "title", "owner", "maker", "label", "series")
ARRAYS = ("tags", "tags_zh")
Index = dict[str, DataFrame]


def _term(c: Column) -> Column:
    return F.unhex(F.md5(c))


def searched_values(items: DataFrame, owners: DataFrame, clusters: DataFrame, tag_map: DataFrame, texts: Sequence[str] = TEXTS, arrays: Sequence[str] = ARRAYS, key: str = "code", owner: str = "owner", tags: str = "tags") -> DataFrame:
    """(key, value) of everything by which an item is found; columns that the items lack are left out.

    ``owners`` and ``tag_map`` are (src, dst), ``clusters`` (canonical, alias).  Dictionaries meet the items' distinct
    (key, owner) and (key, tag) pairs in equi-joins."""
    own = F.array(*[F.col(c).cast("string") for c in texts if c in items.columns])
    lists = [F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")) for c in arrays if c in items.columns]
    direct = items.select(key, F.explode(F.concat(own, *lists)).alias("value"))
    owned = items.select(key, F.col(owner).alias("__s")).where("__s <> ''")
    tagged = items.select(key, F.explode(F.array_distinct(tags)).alias("__s")).where("__s <> ''")
    found = direct
    for left, right in ((owned, owners.select("src", "dst")), (owned, clusters.select("canonical", "alias")), (tagged, tag_map.select("src", "dst"))):
        told = right.toDF("__s", "value").where("value <> ''").distinct()
        found = found.unionByName(left.join(told, "__s").select(key, "value"))
    return found.select(key, F.lower("value").alias("value")).where("value <> ''").distinct()


def build(values: DataFrame, key: str = "code") -> Index:
    """terms (term, value), grams (gram, term) and posts (term, key) of (key, value) rows."""
    posts = values.select(_term(F.col("value")).alias("term"), key)
    terms = values.select("value").distinct().select(_term(F.col("value")).alias("term"), "value")

    def cuts(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("value") - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring("value", i, F.lit(n)))

    long = F.flatten(F.array(*[cuts(n) for n in range(1, GRAM + 1)]))
    grams = terms.select("term", F.explode(F.array_distinct(long)).alias("gram"))
    return {"terms": terms, "grams": grams.select("gram", "term"), "posts": posts}


def _bucket(term: Column, digits: int) -> Column:
    """One of 16 to the power of ``digits`` folders."""
    return F.substring(F.hex(term), 1, digits)


def write(index: Index, path: str, files: int = 1, digits: int = DIGITS) -> None:
    """Stores the tables below ``path``: each in folders by the hash of gram or term, of ``files`` files, sorted by it.

    Searches of the index need the same ``digits``."""
    for name, by, key in (("grams", "gram", _term(F.col("gram"))), ("terms", "term", F.col("term")), ("posts", "term", F.col("term"))):
        dealt = index[name].withColumn("bucket", _bucket(key, digits)).repartition("bucket", F.pmod(F.xxhash64(*index[name].columns), F.lit(files)))
        dealt.sortWithinPartitions("bucket", by).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Index:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("terms", "grams", "posts")}


def grams_of(query: str) -> list[str]:
    """The grams that every term with the query holds: its own text if it is short, else all its grams of GRAM characters."""
    return [query] if len(query) <= GRAM else sorted({query[i : i + GRAM] for i in range(len(query) - GRAM + 1)})


def search(index: Index, queries: Sequence[str], items: DataFrame | None = None, key: str = "code", digits: int = DIGITS) -> DataFrame:
    """(query, key) of the items that hold a query, trimmed and lower-cased, in a searched value.

    ``queries`` are a user's, so few.  An empty one finds all ``items`` (none, if these aren't given)."""
    spark = index["terms"].sparkSession
    asked = {q: q.strip().lower() for q in dict.fromkeys(queries)}
    wanted = [(q, w, g, len(grams_of(w))) for q, w in asked.items() if w for g in grams_of(w)]
    table = spark.createDataFrame(wanted, "query string, wanted string, gram string, need int")
    known = sorted({g for _, _, g, _ in wanted})
    grams = index["grams"]
    if "bucket" in grams.columns:
        grams = grams.where(F.col("bucket").isin(*sorted({hashlib.md5(g.encode()).hexdigest()[:digits].upper() for g in known})))
    met = grams.where(F.col("gram").isin(*known)).select("gram", "term").join(F.broadcast(table), "gram")
    near = met.groupBy("query", "wanted", "need", "term").agg(F.count("*").alias("n")).where("n = need").select("query", "wanted", "term", _bucket(F.col("term"), digits).alias("bucket"))
    on = {name: ["bucket", "term"] if "bucket" in index[name].columns else ["term"] for name in ("terms", "posts")}
    held = near.join(index["terms"], on["terms"]).where(F.contains("value", "wanted")).select("query", "bucket", "term")
    found = held.join(index["posts"], on["posts"]).select("query", key).distinct()
    for q, w in asked.items():
        if not w and items is not None:
            found = found.unionByName(items.select(F.lit(q).alias("query"), key))
    return found


def search_everywhere(items: DataFrame, queries: Sequence[str], owners: DataFrame, clusters: DataFrame, tag_map: DataFrame, key: str = "code", store: str | None = None, **fields) -> DataFrame:
    """``search`` through an index that is built for this call only.

    Its three tables come of the same values: with ``store``, a new folder, these are made once and written there."""
    values = searched_values(items, owners, clusters, tag_map, key=key, **fields)
    if store:
        values.write.parquet(store)
        values = items.sparkSession.read.parquet(store)
    return search(build(values, key), queries, items, key)
