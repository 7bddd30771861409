"""Merging of observations into items: good values are never overwritten.

``fill_merge`` takes one observation per item, ``chain_fill`` folds an item's observations in order of
priority and stops early, ``priority_merge`` picks each field from the best source that has it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogkit.functions.empty import has_value, is_blank, is_unset
from catalogkit.functions.text import normalize_name
from catalogkit.operators.ordered import one_per_key, union_arrays

TEXT = T.StringType()
PENDING = "pending"


@dataclass(frozen=True)
class Roles:
    """Names of the columns with rules of their own; None where a table has none."""

    key: str = "code"
    owner: str | None = "owner"
    cast: str | None = "cast"
    tags: str | None = "tags"
    source: str | None = "source"
    variants: dict[str, str] = field(default_factory=dict)

    def name(self, c: Column) -> Column:
        return normalize_name(c, self.variants)


def _kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def guarded_cast(owner: Column, cast: Column, roles: Roles) -> Column:
    """The observed cast, or null if it is a single name other than the owner."""
    alone = F.filter(cast, lambda x: x.isNotNull() & (x != ""))
    other = (F.size(alone) == 1) & (F.coalesce(owner, F.lit("")) != "") & (roles.name(owner) != roles.name(F.get(alone, F.lit(0))))
    return F.when(~F.coalesce(other, F.lit(False)), cast)


def merged_fields(old: dict[str, Column], new: dict[str, Column], kinds: dict[str, T.DataType], roles: Roles, guard: str = "strict") -> dict[str, Column]:
    """The merged columns of one step.  ``guard`` strict drops a foreign single-name cast before anything is
    filled; compat lets it fill an empty cast and guards only the union."""
    out: dict[str, Column] = {}
    owner = old.get(roles.owner) if roles.owner else None
    for name, kind in kinds.items():
        was, now = old[name], new[name]
        if name == roles.source:
            out[name] = F.when((was.isNull() | (was == PENDING)) & now.isNotNull(), now).otherwise(was)
            continue
        if name == roles.cast and owner is not None:
            safe = guarded_cast(owner, now, roles)
            filled = F.when(is_blank(was, kind) & ~is_blank(now, kind), safe if guard == "strict" else now).otherwise(was)
            out[name] = F.when(is_blank(was, kind) & (is_blank(safe, kind) | F.lit(guard == "compat")), F.coalesce(filled, was)).otherwise(union_arrays(was, safe))
            continue
        if name in (roles.cast, roles.tags):
            out[name] = F.when(is_blank(now, kind), was).otherwise(union_arrays(was, now))
            continue
        out[name] = F.when(is_blank(was, kind) & ~is_blank(now, kind), now).otherwise(was)
    return out


def fill_merge(old: DataFrame, new: DataFrame, fields: Sequence[str], roles: Roles = Roles(), guard: str = "strict") -> DataFrame:
    """Items with their empty fields filled; adds ``changed`` and ``changed_keys``.

    Of several new rows of a key the smallest counts (``ordered.one_per_key``), so that items never multiply."""
    names = [f for f in fields if f in old.columns and f in new.columns]
    joined = old.join(one_per_key(new.select(roles.key, *[F.col(f).alias(f"__{f}") for f in names]), [roles.key]), roles.key, "left")
    merged = merged_fields({f: F.col(f) for f in old.columns}, {f: F.col(f"__{f}") for f in names}, {f: _kind(old, f) for f in names}, roles, guard)
    keys = F.filter(F.array(*[F.when(~merged[f].eqNullSafe(F.col(f)), F.lit(f)) for f in names]), lambda x: x.isNotNull())
    rest = [c for c in old.columns if c not in merged]
    return joined.select(*rest, *[merged[f].alias(f) for f in names], keys.alias("changed_keys")).withColumn("changed", F.size("changed_keys") > 0)


def chain_fill(items: DataFrame, observations: DataFrame, fields: Sequence[str], stop_on: Sequence[str] | None = None, title: str = "title", roles: Roles = Roles(), guard: str = "strict") -> DataFrame:
    """Folds each item's observations by (priority, source); adds ``filled_from``, the sources that changed it.

    The chain stops after a source that changed something once all of ``stop_on`` (or, without it, the
    title) has a value.  A source that changes nothing never stops it.  Of several observations of an item by one
    source at one priority the smallest counts, so that the gathered array is as small as there are sources.
    Observations without a key are left out.
    """
    names = [f for f in fields if f in observations.columns]
    kinds = {f: _kind(items, f) for f in names}
    observations = one_per_key(observations.where(F.col(roles.key).isNotNull()).select(roles.key, "priority", "source", *names), [roles.key, "priority", "source"])
    seen = observations.groupBy(roles.key).agg(F.array_sort(F.collect_list(F.struct("priority", F.col("source").alias("by"), *[F.col(f).alias(f"n_{f}") for f in names]))).alias("__seen"))
    joined = items.join(seen, roles.key, "left")
    state = F.struct(*[F.col(f).alias(f) for f in names], F.array().cast("array<string>").alias("filled_from"), F.lit(False).alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        was = {f: acc[f] for f in names}
        if roles.owner and roles.owner not in was:
            was[roles.owner] = F.col(roles.owner)
        merged = merged_fields(was, {f: x[f"n_{f}"] for f in names}, kinds, roles, guard)
        changed = F.lit(False)
        for f in names:
            changed = changed | ~merged[f].eqNullSafe(acc[f])
        wanted = list(stop_on) if stop_on else [title]
        done = F.lit(True)
        for f in wanted:
            done = done & ~is_blank(merged[f], kinds[f])
        after = F.struct(*[merged[f].alias(f) for f in names], F.when(changed, F.array_append(acc["filled_from"], x["by"])).otherwise(acc["filled_from"]).alias("filled_from"), (changed & done).alias("stop"))
        return F.when(acc["stop"], acc).otherwise(after)

    folded = F.aggregate(F.coalesce(F.col("__seen"), F.array().cast(seen.schema["__seen"].dataType)), state, step)
    rest = [c for c in items.columns if c not in names]
    out = joined.select(*rest, folded.alias("__s"))
    return out.select(*rest, *[F.col(f"__s.{f}") for f in names], F.col("__s.filled_from").alias("filled_from"))


def priority_merge(observations: DataFrame, fields: Sequence[str], key: str = "code") -> DataFrame:
    """Per key and field the value of the lowest priority that is not blank."""
    return observations.groupBy(key).agg(*[
        F.min_by(F.when(~is_blank(F.col(f), _kind(observations, f)), F.col(f)), F.when(~is_blank(F.col(f), _kind(observations, f)), F.struct("priority", "source"))).alias(f)
        for f in fields
    ])


def attribution_conflict(owner: Column, cast: Column, roles: Roles = Roles()) -> Column:
    """struct(conflict, suggested): the owner is not among the cast; a cast of one is the suggestion."""
    names = F.filter(cast, lambda x: x.isNotNull() & (x != ""))
    conflict = (F.coalesce(owner, F.lit("")) != "") & (F.size(names) > 0) & ~F.exists(names, lambda x: roles.name(x) == roles.name(owner))
    conflict = F.coalesce(conflict, F.lit(False))
    return F.struct(conflict.alias("conflict"), F.when(conflict & (F.size(names) == 1), F.get(names, F.lit(0))).alias("suggested"))


def gap_fill(items: DataFrame, new: DataFrame, fields: Sequence[str], curated: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Objective fields filled where they hold no value (coverage sense); the owner only by a curated name.

    Adds ``filled``, the array of filled fields.  ``curated`` has a column ``name``."""
    names = [f for f in fields if f in new.columns]
    own = one_per_key(new.select(roles.key, *[F.col(f).alias(f"__{f}") for f in names]), [roles.key])
    if roles.owner in names:
        own = own.join(curated.select(F.col("name").alias(f"__{roles.owner}"), F.lit(True).alias("__ok")).distinct(), f"__{roles.owner}", "left")
    joined = items.join(own, roles.key, "left")
    take = {f: ~has_value(F.col(f), _kind(items, f)) & has_value(F.col(f"__{f}"), _kind(items, f)) & (F.coalesce(F.col("__ok"), F.lit(False)) if f == roles.owner else F.lit(True)) for f in names}
    filled = F.filter(F.array(*[F.when(take[f], F.lit(f)) for f in names]), lambda x: x.isNotNull())
    return joined.select(*[F.when(take[c], F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in take else F.col(c) for c in items.columns], filled.alias("filled"))


#: fixed values: what a second source of profiles may give, its link's column and the profile's
SECOND_SOURCE = ("reading", "birthday", "height", "bust", "waist", "hip", "cup", "debut", "agency", "hobby", "blood_type", "birthplace")


def profile_fill(profiles: DataFrame, fetched: DataFrame, fields: Sequence[str], key: str = "name", aliases: str | None = "aliases", photo: tuple[str, str] | None = ("photo", "avatar"), link: tuple[str, str] | None = ("url", "link")) -> DataFrame:
    """Profiles filled where unset (a missing profile starts as its name alone); adds ``changed_keys``.

    Aliases are joined in order, the photo stands in for a missing avatar and the page's address for a missing link.
    A second source is the same operator with its own ``fields`` (SECOND_SOURCE) over the names that a probe found."""
    joined = profiles.join(one_per_key(fetched.select(key, *[F.col(c).alias(f"__{c}") for c in fetched.columns if c != key]), [key]), key, "full")
    out: dict[str, Column] = {}
    for f in fields:
        kind = _kind(profiles, f)
        out[f] = F.when(is_unset(F.col(f), kind) & has_value(F.col(f"__{f}"), kind), F.col(f"__{f}")).otherwise(F.col(f))
    if aliases and aliases in profiles.columns:
        extra = F.filter(F.coalesce(F.col(f"__{aliases}"), F.array().cast("array<string>")), lambda x: x != F.col(key))
        out[aliases] = F.when(F.size(extra) > 0, union_arrays(F.col(aliases), extra)).otherwise(F.col(aliases))
    if photo and photo[0] in fetched.columns and photo[1] in profiles.columns:
        now = out.get(photo[1], F.col(photo[1]))
        out[photo[1]] = F.when(is_unset(now, TEXT) & has_value(F.col(f"__{photo[0]}"), TEXT), F.col(f"__{photo[0]}")).otherwise(now)
    if link and link[0] in fetched.columns and link[1] in profiles.columns:
        now = out.get(link[1], F.col(link[1]))
        out[link[1]] = F.when(is_unset(now, TEXT) & has_value(F.col(f"__{link[0]}"), TEXT), F.col(f"__{link[0]}")).otherwise(now)
    keys = F.filter(F.array(*[F.when(~c.eqNullSafe(F.col(f)), F.lit(f)) for f, c in out.items()]), lambda x: x.isNotNull())
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in profiles.columns], keys.alias("changed_keys"))


def image_merge(items: DataFrame, found: DataFrame, key: str = "code", force: bool = False) -> DataFrame:
    """Samples, cover, poster and background from image observations (key, priority, cover, samples).

    Items with samples are left alone unless ``force``; the first source with samples counts; nothing
    already there is overwritten, and a cover must be an absolute URL."""
    nothing = F.array().cast("array<string>")
    with_samples = F.size(F.coalesce("samples", nothing)) > 0
    best = found.groupBy(key).agg(F.min_by(F.struct(F.col("cover").alias("c"), F.col("samples").alias("s")), F.struct(~with_samples, "priority")).alias("__n"))
    old = F.coalesce("sample_images", nothing)
    go = F.col("__n").isNotNull() & ((F.size(old) == 0) | F.lit(force))
    new = F.coalesce("__n.s", nothing)
    samples = F.when(go, union_arrays(old, new)).otherwise(F.col("sample_images"))
    absolute = F.when(F.col("__n.c").rlike("^https?://"), F.col("__n.c"))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    cover = F.when(go, F.coalesce(empty("cover"), absolute)).otherwise(F.col("cover"))
    poster = F.when(go, F.coalesce(empty("poster"), cover)).otherwise(F.col("poster"))
    background = F.when(go, F.coalesce(empty("background"), F.get(new, F.lit(0)))).otherwise(F.col("background"))
    swap = {"sample_images": samples, "cover": cover, "poster": poster, "background": background}
    return items.join(best, key, "left").select(*[swap.get(c, F.col(c)).alias(c) for c in items.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, action): non-blank new values win; action is created, updated or skipped."""
    fresh = one_per_key(new.select(F.trim(key).alias(key), F.trim(value).alias("__new")).where(f"{key} <> '' AND __new <> ''"), [key])
    joined = old.select(key, value, F.lit(True).alias("__old")).join(fresh, key, "full")
    action = F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(value)), "updated").otherwise("skipped")
    return joined.select(key, F.coalesce("__new", value).alias(value), action.alias("action"))


def observed_record(old: DataFrame, parsed: DataFrame, primary: str, key: str = "code") -> DataFrame:
    """A fresh record from a parsed page: a known owner and an old cover stand in, the source says if a page was read."""
    joined = old.select(key, F.col("owner").alias("hint"), F.col("cover").alias("__cover")).join(one_per_key(parsed, [key]), key, "left")
    status = F.when(F.col("title").isNotNull(), primary).otherwise(PENDING)
    own = {"owner": F.coalesce("hint", "owner"), "cover": F.coalesce("cover", "__cover")}
    return joined.select(key, *[own.get(c, F.col(c)).alias(c) for c in parsed.columns if c not in (key, "source")], status.alias("source"))
