"""Ordered-per-key behaviours.  Orders are always total: no bare first(), mode() or dropDuplicates()."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return _ranked(df, keys, order).where("__rank = 1").drop("__rank")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    return _ranked(df, keys, [F.col(c).desc() for c in order]).where("__rank = 1").drop("__rank")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, with their rank."""
    return _ranked(df, keys, order).where(F.col("__rank") <= n).withColumnRenamed("__rank", "rank")


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key: the smallest by its other columns as JSON text.  A key that is unique keeps its row."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*rest)
    return df.groupBy(*keys).agg(F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias("__row")).select(*keys, "__row.*")


def prefix(c: Column, n: int = 12) -> Column:
    """The first ``n`` values of an array; null gives none."""
    return F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n)


def union_arrays(old: Column, new: Column) -> Column:
    """Old values, then the non-empty new ones not seen before."""
    seen = F.coalesce(old, F.array().cast("array<string>"))
    return F.array_distinct(F.concat(seen, F.filter(F.coalesce(new, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))


def union_keys(*keys: DataFrame) -> DataFrame:
    """Distinct union of one-column key tables."""
    out = keys[0]
    for k in keys[1:]:
        out = out.union(k)
    return out.distinct()


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti")
