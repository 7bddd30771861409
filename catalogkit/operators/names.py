"""Alias clusters and what is built on them.  Clusters reach one hop and are not transitive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.functions.text import canon_code


def alias_clusters(edges: DataFrame, curated: DataFrame) -> DataFrame:
    """(canonical, alias): for each curated name itself, its aliases, and the clusters of those that list it.

    ``edges``: (canonical, alias); ``curated``: (name)."""
    c = curated.select(F.col("name").alias("canonical")).distinct()
    e = edges.select("canonical", "alias").distinct()
    listed_by = e.join(c.select(F.col("canonical").alias("alias")), "alias").select(F.col("alias").alias("own"), F.col("canonical").alias("other"))
    own = c.select("canonical", F.col("canonical").alias("alias"))
    direct = e.join(c, "canonical", "left_semi")
    head = listed_by.select(F.col("own").alias("canonical"), F.col("other").alias("alias"))
    beside = listed_by.join(e, F.col("other") == F.col("canonical")).select(F.col("own").alias("canonical"), "alias")
    return own.unionByName(direct).unionByName(head).unionByName(beside).distinct()


def alias_collisions(clusters: DataFrame) -> DataFrame:
    """(alias, owners) of the names in two or more clusters; owners sorted."""
    return clusters.groupBy("alias").agg(F.array_sort(F.collect_set("canonical")).alias("owners")).where("size(owners) > 1")


def canonicalise_owner(items: DataFrame, clusters: DataFrame, owner: str = "owner") -> DataFrame:
    """Owners that are an alias of exactly one cluster get its name; canonical, collided and unknown names stay."""
    # each row tells of its alias and of its canonical name, so that the clusters are made once
    told = F.array(F.struct(F.col("alias").alias("name"), F.col("canonical").alias("of")), F.struct(F.col("canonical").alias("name"), F.lit(None).cast("string").alias("of")))
    names = clusters.select(F.explode(told).alias("t")).groupBy(F.col("t.name").alias("__a"))
    known = names.agg(F.min("t.of").alias("__canonical"), F.max("t.of").alias("__last"), F.bool_or(F.col("t.of").isNull()).alias("__head"))
    known = known.where("NOT __head AND __canonical = __last").select("__a", "__canonical")
    joined = items.join(known, F.col(owner) == F.col("__a"), "left")
    return joined.select(*[F.coalesce("__canonical", owner).alias(c) if c == owner else F.col(c) for c in items.columns])


def expand_query(clusters: DataFrame, text: str) -> DataFrame:
    """(canonical) of the clusters with a name that holds the text."""
    if not text.strip():
        return clusters.select("canonical").where(F.lit(False))
    return clusters.where(F.lower("alias").contains(text.strip().lower())).select("canonical").distinct()


def sync_aliases(edges: DataFrame, profiles: DataFrame, shortest_ascii: int = 5) -> DataFrame:
    """New (canonical, alias) edges from profiles (name, aliases): not the name itself, not known, not a
    canonical name elsewhere, and no short ASCII."""
    found = profiles.select(F.col("name").alias("canonical"), F.explode("aliases").alias("alias")).where("alias <> '' AND alias <> canonical").distinct()
    found = found.where(~(F.col("alias").rlike(r"^[\x00-\x7F]+$") & (F.length("alias") < shortest_ascii)))
    found = found.join(edges, ["canonical", "alias"], "left_anti")
    return found.join(edges.select(F.col("canonical").alias("alias")).distinct(), "alias", "left_anti").select("canonical", "alias")


def attach_value(items: DataFrame, dictionary: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``: the dictionary's (src, dst) value of the key, null where it has none or an empty one; of several the smallest."""
    found = dictionary.where("dst <> ''").groupBy(F.col("src").alias("__s")).agg(F.min("dst").alias(out))
    return items.join(found, F.col(key) == F.col("__s"), "left").drop("__s")


def look_up_name(items: DataFrame, dictionary: DataFrame, name: str, normalized: str, out: str) -> DataFrame:
    """Adds ``out``: the dictionary's (src, dst) value of the name, else of the normalised name; of several the smallest."""
    dictionary = dictionary.groupBy("src").agg(F.min("dst").alias("dst"))
    one = dictionary.select(F.col("src").alias("__s1"), F.col("dst").alias("__d1"))
    two = dictionary.select(F.col("src").alias("__s2"), F.col("dst").alias("__d2"))
    joined = items.join(one, F.col(name) == F.col("__s1"), "left").join(two, F.col(normalized) == F.col("__s2"), "left")
    return joined.select(*items.columns, F.coalesce("__d1", "__d2").alias(out))


def probe_candidates(entities: DataFrame, candidates: str, directory: DataFrame, key: str = "name") -> DataFrame:
    """(key, hit): the first candidate spelling that ``directory`` (name) lists."""
    long = entities.select(key, F.posexplode(candidates).alias("pos", "candidate"))
    hits = long.join(directory.select(F.col("name").alias("candidate")).distinct(), "candidate", "left_semi")
    return hits.groupBy(key).agg(F.min_by("candidate", "pos").alias("hit"))


def pick_exact(hits: DataFrame, wanted: str = "code", found: str = "found_code", target: str = "target") -> DataFrame:
    """(code, target) where exactly one target among a request's hits has the requested code."""
    exact = hits.where(canon_code(F.col(wanted)) == canon_code(F.col(found)))
    return exact.groupBy(wanted).agg(F.count_distinct(target).alias("n"), F.min(target).alias(target)).where("n = 1").drop("n")
