"""Tag dictionaries: merging, lookup maps, translation of arrays, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogkit.functions.empty import strip
from catalogkit.functions.text import has_kana, is_chinese

def _filled(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def merge_dictionary(rows: DataFrame, priority: Sequence[str], curated: DataFrame | None = None, translate_key_source: str = "translate", to_traditional: Column | None = None) -> DataFrame:
    """One row per key from (source, file_ord, row_ord, id, url, ja, zh_cn, zh_tw, en, translate, note).

    The key is ja (translate for one source), else en, zh_cn, id.  Rows count in order of ``priority``
    (others after it), then of reading.  id and url come from the first row even if blank, other columns
    from the first that has them; zh_cn falls back from the curated value over zh_cn, a Chinese translate
    and a Chinese zh_tw to the key.  Sorted by key, blank keys last.
    """
    rank = F.lit(99)
    for i, name in reversed(list(enumerate(priority))):
        rank = F.when(F.col("source") == name, i).otherwise(rank)
    own = F.when(F.col("source") == translate_key_source, F.coalesce(_filled(F.col("translate")), _filled(F.col("ja")))).otherwise(_filled(F.col("ja")))
    key = F.coalesce(own, _filled(F.col("en")), _filled(F.col("zh_cn")), _filled(F.col("id")))
    ordered = rows.withColumn("key", key).where("key IS NOT NULL").withColumn("ord", F.struct(rank.alias("rank"), F.col("file_ord"), F.col("row_ord")))
    first = lambda c: F.min_by(_filled(F.col(c)), F.when(_filled(F.col(c)).isNotNull(), F.col("ord"))).alias(c)
    notes = F.array_sort(F.collect_list(F.when(_filled(F.col("note")).isNotNull(), F.struct("ord", F.col("note").alias("n")))))
    merged = ordered.groupBy("key").agg(
        F.min_by(F.coalesce("id", F.lit("")), "ord").alias("id"), F.min_by(F.coalesce("url", F.lit("")), "ord").alias("url"),
        *[first(c) for c in ("ja", "zh_cn", "zh_tw", "en", "translate")],
        F.array_join(F.array_distinct(F.transform(notes, lambda x: x["n"])), " / ").alias("note"),
        F.array_join(F.array_sort(F.collect_set("source")), ";").alias("source"),
    )
    if curated is not None:
        merged = merged.join(curated.select(F.col("src").alias("key"), F.col("dst").alias("curated")), "key", "left")
    else:
        merged = merged.withColumn("curated", F.lit(None).cast("string"))
    chinese = lambda c: F.when(is_chinese(F.col(c)), F.col(c))
    cn = F.coalesce("curated", "zh_cn", chinese("translate"), chinese("zh_tw"), "key")
    tw = F.coalesce("zh_tw", to_traditional if to_traditional is not None else F.lit(None).cast("string"), F.lit(""))
    return merged.select("key", "id", "url", "ja", cn.alias("zh_cn"), tw.alias("zh_tw"), "en", "note", "source").orderBy(F.asc_nulls_last("key"), "zh_cn")


def build_tag_map(rows: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """(src, dst): per row the first non-blank of zh_cn, zh_tw, translate under each of ja, en, id.

    The first mapping in order of (file, row, key column) wins; ``curated`` (src, dst) overrides all."""
    value = F.coalesce(_filled(F.col("zh_cn")), _filled(F.col("zh_tw")), _filled(F.col("translate")))
    keys = F.array(*[F.struct(F.lit(i).alias("k"), _filled(F.col(c)).alias("src")) for i, c in enumerate(("ja", "en", "id"))])
    long = rows.select("file_ord", "row_ord", value.alias("dst"), F.explode(keys).alias("key")).where("dst IS NOT NULL AND key.src IS NOT NULL")
    found = long.groupBy(F.col("key.src").alias("src")).agg(F.min_by("dst", F.struct("file_ord", "row_ord", "key.k")).alias("dst"))
    if curated is None:
        return found
    best = curated.select("src", F.col("dst").alias("__curated"))
    return found.join(best, "src", "full").select("src", F.coalesce("__curated", "dst").alias("dst"))


def _by_array(items: DataFrame, col: str, tag_map: DataFrame, value: Column, out: str, keep: Column | None = None) -> DataFrame:
    """Adds ``out``: the array of ``value`` over (tag, dst) of each tag, in order.

    Every distinct array is translated once and met again by its value, so that keys may repeat or be null, and
    dictionaries have any size; of a tag that a dictionary holds twice the smallest value counts."""
    tag_map = tag_map.groupBy("src").agg(F.min("dst").alias("dst"))
    arrays = items.select(F.col(col).alias("__a")).where("__a IS NOT NULL").distinct()
    long = arrays.select("__a", F.posexplode("__a").alias("pos", "tag")).join(tag_map.select(F.col("src").alias("tag"), "dst"), "tag", "left")
    kept = long.where(keep) if keep is not None else long
    done = kept.groupBy("__a").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"]).alias("__l"))
    joined = items.join(done, F.col(col) == F.col("__a"), "left")
    return joined.withColumn(out, F.coalesce("__l", F.array().cast("array<string>"))).drop("__a", "__l")


def translate_aligned(items: DataFrame, col: str, tag_map: DataFrame, out: str = "tags_zh", convert: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``out``: translations of the same length and order; a miss or blank mapping keeps the tag, null gives "".

    A null array gives an empty one."""
    value = F.coalesce(F.nullif(F.col("dst"), F.lit("")), F.col("tag"), F.lit(""))
    return _by_array(items, col, tag_map, F.translate(value, *convert) if convert else value, out)


def normalize_tags(items: DataFrame, col: str, tag_map: DataFrame, out: str = "tags_norm", convert: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``out``: blank tags and tags mapped to blank dropped, others translated, first occurrences kept."""
    value = F.when(F.col("dst").isNotNull(), strip(F.col("dst"))).otherwise(F.col("tag"))
    value = F.translate(value, *convert) if convert else value
    found = _by_array(items, col, tag_map, value, out, keep=(strip(F.col("tag")) != "") & (value != ""))
    return found.withColumn(out, F.array_distinct(out))


def tag_coverage(items: DataFrame, col: str, tag_map: DataFrame) -> DataFrame:
    """(hits, total, pct): how many tag occurrences the map knows; blanks count in the total."""
    long = items.select(F.explode(col).alias("src")).join(tag_map.select("src", F.lit(1).alias("hit")), "src", "left")
    out = long.agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("hits"), F.count("*").alias("total"))
    return out.withColumn("pct", F.when(F.col("total") > 0, F.round(100 * F.col("hits") / F.col("total"), 2)).otherwise(0.0))


def uncovered_tags(items: DataFrame, col: str, tag_map: DataFrame) -> DataFrame:
    """(tag, n) of the tags that the map does not know."""
    long = items.select(F.explode(col).alias("tag")).where("tag <> ''")
    return long.join(tag_map.select(F.col("src").alias("tag")), "tag", "left_anti").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def global_tag_map(items: DataFrame, key: str, tags: str, translated: str) -> DataFrame:
    """(src, dst) from aligned arrays of equal length; the first item by key, then position, wins."""
    zipped = F.arrays_zip(F.col(tags).alias("src"), F.col(translated).alias("dst"))
    long = items.where(F.size(tags) == F.size(translated)).select(key, F.posexplode(zipped).alias("pos", "z"))
    long = long.select(key, "pos", "z.src", "z.dst").where("src <> '' AND dst <> ''")
    return long.groupBy("src").agg(F.min_by("dst", F.struct(key, "pos")).alias("dst"))


def fix_dictionary(rows: DataFrame, convert: tuple[str, str]) -> DataFrame:
    """zh_cn written where the best value, without kana, converts to something else; adds ``fixed``."""
    base = F.coalesce(_filled(F.col("zh_cn")), _filled(F.col("zh_tw")), _filled(F.col("translate")))
    simple = F.translate(base, *convert)
    fixed = F.coalesce(base.isNotNull() & ~has_kana(base) & (simple != F.coalesce("zh_cn", F.lit(""))), F.lit(False))
    return rows.withColumn("fixed", fixed).withColumn("zh_cn", F.when(F.col("fixed"), simple).otherwise(F.col("zh_cn")))
