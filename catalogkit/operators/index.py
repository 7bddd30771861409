"""Owner groups, entity tables, status inference and read-through lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.functions.text import former_marker, is_recent, normalize_id
from catalogkit.operators.ordered import keep_first, one_per_key, top_per_group

OTHER = "other"


def resolve_owner(items: DataFrame, owner: str = "owner", cast: str = "cast", other: str = OTHER) -> Column:
    """The owner, else the first of the cast, else the bucket for the rest."""
    first = F.nullif(F.get(F.col(cast), F.lit(0)), F.lit("")) if cast in items.columns else F.lit(None).cast("string")
    return F.coalesce(F.nullif(F.col(owner), F.lit("")), first, F.lit(other))


def owner_codes(items: DataFrame, key: str = "code") -> DataFrame:
    """(owner, code), each once: the index as rows, which no owner makes large."""
    return items.select(resolve_owner(items).alias("owner"), F.col(key).alias("code")).distinct()


def group_index(items: DataFrame, nested: bool = False, cap: int | None = None, key: str = "code", chunk_rows: int = 10_000) -> DataFrame:
    """(owner, chunk, work_count, codes), codes sorted and distinct, work_count of the whole owner.

    An owner of more than ``chunk_rows`` codes has several chunks, dealt by a hash of the code, since the bucket for
    the rest may hold a large part of the table; others have chunk 0 alone.  ``nested`` adds the items as structs,
    ``cap`` at most that many of an owner."""
    owned = items.withColumn("__owner", resolve_owner(items))
    pairs = owned.select("__owner", key).where(F.col(key).isNotNull()).distinct()
    counts = owned.select("__owner").distinct().join(pairs.groupBy("__owner").agg(F.count("*").alias("n")), "__owner", "left").select(F.col("__owner").alias("owner"), F.coalesce("n", F.lit(0)).alias("work_count"))
    place = F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long")
    chunk = F.coalesce(F.pmod(place, F.greatest(F.ceil(F.col("work_count") / chunk_rows), F.lit(1))), F.lit(0)).cast("int")
    out = pairs.withColumnRenamed("__owner", "owner").join(counts, "owner", "right").withColumn("chunk", chunk)
    out = out.groupBy("owner", "chunk").agg(F.first("work_count").alias("work_count"), F.array_sort(F.collect_list(key)).alias("codes"))
    if not nested:
        return out
    columns = [c for c in items.columns if c != key]
    once = keep_first(owned, ["__owner", key], [F.struct(*columns)] if columns else [F.lit(1)])
    once = top_per_group(once, ["__owner"], [F.col(key)], cap) if cap else once
    dealt = once.withColumnRenamed("__owner", "owner__").join(counts.withColumnRenamed("owner", "owner__"), "owner__").withColumn("chunk", chunk)
    works = dealt.groupBy(F.col("owner__"), "chunk").agg(F.array_sort(F.collect_list(F.struct(key, *columns))).alias("works")).withColumnRenamed("owner__", "owner")
    return out.join(works, ["owner", "chunk"])


def attach_profiles(index: DataFrame, profiles: DataFrame) -> DataFrame:
    """Owner groups with their profile's columns; without one the name is the owner's.  Of profiles that share a name the
    smallest counts."""
    p = one_per_key(profiles, ["name"]).withColumnRenamed("name", "__name")
    return index.join(p, F.col("owner") == F.col("__name"), "left").withColumn("name", F.coalesce("__name", "owner")).drop("__name")


def flatten_index(index: DataFrame) -> DataFrame:
    """One row per nested item with its group's owner and avatar, which stand for the item's own."""
    outer = ["owner", *(["avatar"] if "avatar" in index.columns else [])]
    fields = [f for f in index.schema["works"].dataType.elementType.fieldNames() if f not in outer]
    return index.select(*outer, F.explode("works").alias("w")).select(*outer, *[F.col(f"w.`{f}`").alias(f) for f in fields])


def global_counts(items: DataFrame) -> DataFrame:
    return items.agg(F.count_distinct(resolve_owner(items)).alias("entities"), F.count("*").alias("items"))


def entity_stats(items: DataFrame, dated_only: bool = False) -> DataFrame:
    """(owner, work_count, first_date, last_date); dates compare as text, blank ones do not count."""
    rows = items.withColumn("__owner", resolve_owner(items)).withColumn("__date", F.nullif(F.trim(F.col("date")), F.lit("")))
    rows = rows.where("__date IS NOT NULL") if dated_only else rows
    return rows.groupBy(F.col("__owner").alias("owner")).agg(F.count("*").alias("work_count"), F.min("__date").alias("first_date"), F.max("__date").alias("last_date"))


def entity_table(profiles: DataFrame, stats: DataFrame, clusters: DataFrame, buckets: Sequence[str] = (OTHER,), labels: Sequence[str] = (), status_labels: dict[str, str] | None = None) -> DataFrame:
    """All entities of either side: type, aliases (cluster first, without the name), counts, the status' label and a note;
    real ones first, then by count and name.

    ``status_labels`` is a short literal map; a status that it lacks stays as it is.  The note says what an entity
    lacks: no_profile, no_items."""
    joined = profiles.join(stats, profiles.name == stats.owner, "full").withColumn("entity", F.coalesce("name", "owner"))
    names = clusters.where("alias <> canonical").groupBy(F.col("canonical").alias("__c")).agg(F.array_sort(F.collect_set("alias")).alias("__names"))
    joined = joined.join(names, F.col("entity") == F.col("__c"), "left")
    none = F.array().cast("array<string>")
    own = F.coalesce("aliases", none) if "aliases" in profiles.columns else none
    aliases = F.array_except(F.array_distinct(F.concat(F.coalesce("__names", none), own)), F.array("entity"))
    status = F.col("status") if "status" in profiles.columns else F.lit(None).cast("string")
    if status_labels:
        status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in status_labels.items() for x in pair]), status), status)
    note = F.concat_ws("; ", F.when(F.col("name").isNull(), "no_profile"), F.when(F.col("owner").isNull(), "no_items"))
    kind = F.when(F.col("entity").isin(*buckets), "bucket").when(F.col("entity").isin(*labels or [""]), "label").otherwise("person")
    out = joined.select(F.col("entity").alias("name"), kind.alias("type"), aliases.alias("aliases"), F.coalesce("work_count", F.lit(0)).alias("work_count"), "first_date", "last_date", F.col("owner").isNull().alias("profile_only"), status.alias("status"), note.alias("note"))
    return out.orderBy(F.col("type") != "person", F.desc("work_count"), "name")


def infer_status(entities: DataFrame, as_of: Column, window_days: int = 720, former_words: Sequence[str] = ("former", "retired"), force: bool = False, guess: str = "inferred") -> DataFrame:
    """Status of (name, lead, tags, status, status_source, first_date, last_date, debut_year).

    Set by another source it stays (unless ``force``); a marker of a former role gives retired, a last date
    within the window active, anything else unknown.  The debut falls back to the first date."""
    keep = (F.coalesce("status", F.lit("")) != "") & (F.coalesce("status_source", F.lit("")) != guess) & F.lit(not force)
    marker = former_marker(F.col("lead"), F.col("tags"), former_words)
    new = F.when(marker.isNotNull(), "retired").when(is_recent(F.col("last_date"), as_of, window_days), "active").otherwise("unknown")
    source = F.when(marker.isNotNull(), F.concat(F.lit(f"{guess}:"), marker)).otherwise(guess)
    year = F.substring("first_date", 1, 4).try_cast("int")
    return entities.select(
        *[c for c in entities.columns if c not in ("status", "status_source", "debut_year")],
        F.when(keep, F.col("status")).otherwise(new).alias("status"), F.when(keep, F.col("status_source")).otherwise(source).alias("status_source"),
        F.coalesce("first_date", F.col("debut_year").cast("string")).alias("debut"), F.coalesce("debut_year", year).alias("debut_year"),
    )


def cache_split(keys: DataFrame, cache: DataFrame, key: str = "code") -> DataFrame:
    """(key, fetch_status): hit, miss (looked up before and not there) or untried.  ``cache``: key, payload (null for a miss).

    Of several entries of a key one hit makes it a hit."""
    c = cache.groupBy(key).agg(F.lit(True).alias("__seen"), F.bool_or(F.col("payload").isNotNull()).alias("__hit"))
    status = F.when(F.col("__seen").isNull(), "untried").when(F.col("__hit"), "hit").otherwise("miss")
    return keys.select(key).distinct().join(c, key, "left").select(key, status.alias("fetch_status"))


def read_through(keys: DataFrame, store: DataFrame, observed: DataFrame, key: str = "code", canon: bool = False) -> DataFrame:
    """Per distinct key the stored row if it has a title, else the observed one, else a pending stub if an
    owner is known; ``origin`` says which.  ``keys``: key and ``owner``; with ``canon`` keys are brought to their
    canonical form first.  Of several stored or observed rows of a key the smallest counts."""
    fields = [c for c in store.columns if c in observed.columns and c not in (key, "owner", "source")]
    s = store.where("title <> ''").select(key, F.lit(True).alias("__s"), *[F.col(f).alias(f"s_{f}") for f in [*fields, "owner", "source"]])
    o = observed.select(key, F.lit(True).alias("__o"), *[F.col(f).alias(f"o_{f}") for f in [*fields, "owner", "source"]])
    s, o = one_per_key(s, [key]), one_per_key(o, [key])
    keys = keys.withColumn(key, normalize_id(F.col(key))) if canon else keys
    asked = keys.groupBy(key).agg(F.min("owner").alias("hint"))
    joined = asked.join(s, key, "left").join(o, key, "left").where("__s OR __o OR hint <> ''")
    pick = lambda f: F.when(F.col("__s"), F.col(f"s_{f}")).when(F.col("__o"), F.col(f"o_{f}"))
    origin = F.when(F.col("__s"), "store").when(F.col("__o"), "fetched").otherwise("pending")
    return joined.select(key, F.coalesce(pick("owner"), "hint").alias("owner"), *[pick(f).alias(f) for f in fields], F.coalesce(pick("source"), F.lit("pending")).alias("source"), origin.alias("origin"))


def entity_names(index: DataFrame) -> DataFrame:
    return index.select("name").distinct()


def save_index(index: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """The index as a table in ``buckets`` buckets by owner, sorted in each; ``path`` is its folder, if not the warehouse's.

    Profiles saved alike by their name (``save_profiles``) meet it without an exchange."""
    _save(index, table, buckets, "owner", path)


def save_profiles(profiles: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """One profile of each name, dealt as ``save_index`` deals owners."""
    _save(one_per_key(profiles, ["name"]), table, buckets, "name", path)


def _save(rows: DataFrame, table: str, buckets: int, key: str, path: str | None) -> None:
    # a file for each bucket, not one for each bucket and task
    writer = rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def profiled_items(spark: SparkSession, index_table: str, profile_table: str) -> DataFrame:
    """``flatten_index`` of the saved index with the saved profiles' columns, without an exchange where both have as many buckets."""
    index, profiles = spark.table(index_table), spark.table(profile_table)
    met = index.join(profiles.withColumnRenamed("name", "__name"), F.col("owner") == F.col("__name"), "left")
    return flatten_index(met.withColumn("name", F.coalesce("__name", "owner")).drop("__name"))
