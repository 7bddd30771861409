"""Selection of targets, resumable work, column whitelists and curated names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogkit.functions.empty import has_value, is_blank, strip


def select_targets(items: DataFrame, codes: DataFrame | None = None, missing: str | None = None, everything: bool = False, limit: int | None = None, key: str = "code") -> DataFrame:
    """The rows to work on: listed codes, else rows whose field is blank, else all, else pending ones.

    Pending means a blank title or a source that is null or ``pending``.  ``limit`` is on sorted keys."""
    if codes is not None:
        out = items.join(codes.select(F.upper(strip(F.col(key))).alias("__c")).distinct(), F.upper(key) == F.col("__c"), "left_semi")
    elif missing:
        out = items.where(is_blank(F.col(missing), items.schema[missing].dataType))
    elif everything:
        out = items
    else:
        out = items.where(is_blank(F.col("title"), T.StringType()) | F.col("source").isNull() | (F.col("source") == "pending"))
    return out.orderBy(key).limit(limit) if limit else out


def resume_filter(items: DataFrame, primary: str, force: bool = False) -> DataFrame:
    """Rows not yet from the primary source (all with ``force``)."""
    return items if force else items.where(~F.col("source").eqNullSafe(primary))


def with_gaps(items: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows in which some field holds no value."""
    some = F.lit(False)
    for f in fields:
        some = some | ~has_value(F.col(f), items.schema[f].dataType)
    return items.where(some)


def with_none_of(profiles: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows in which no field holds a value."""
    some = F.lit(False)
    for f in fields:
        some = some | has_value(F.col(f), profiles.schema[f].dataType)
    return profiles.where(~some)


def only_fields(observations: DataFrame, fields: Sequence[str], always: Sequence[str] = ("code", "source", "source_url", "priority")) -> DataFrame:
    """Columns outside the whitelist become null."""
    keep = {*fields, *always}
    return observations.select(*[F.col(c) if c in keep else F.lit(None).cast(observations.schema[c].dataType).alias(c) for c in observations.columns])


def curated(entities: DataFrame, special: Sequence[str]) -> DataFrame:
    """(name) of the entities without the synthetic buckets."""
    return entities.select("name").where(F.col("name").isNotNull() & ~F.col("name").isin(*special)).distinct()


def without_placeholders(rows: DataFrame, column: str, placeholders: Sequence[str]) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*placeholders))
