"""Snapshots compared by digests first.

A snapshot's keys are dealt into leaves by their hash, and ``fanout`` leaves make a node.  A leaf's digest adds up hashes of
its rows, a node's hashes its leaves' digests: a tree of ``fanout`` squared leaves, some thousands of numbers however
large the snapshot.  Trees are compared from the top: only leaves that differ below nodes that differ are joined row by row.
Rows of equal leaves are read for their digest, unless trees and snapshots are stored, but never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.operators.audit import sweep_snapshots
from catalogkit.operators.merge import Roles

FANOUT = 64
KEYLESS = -1  # the leaf of rows without a key, which equal no others and so always differ


def leaf_of(key: str, fanout: int = FANOUT) -> Column:
    return F.when(F.col(key).isNull(), KEYLESS).otherwise(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(fanout * fanout))).cast("int")


def leaves(rows: DataFrame, key: str, columns: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """(node, leaf, n, digest): one row of each leaf; equal rows in any order and partitioning give equal digests."""
    text = F.to_json(F.struct(F.col(key), *[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    hashed = rows.select(leaf_of(key, fanout).alias("leaf"), F.xxhash64(text).cast("decimal(20,0)").alias("a"), F.xxhash64(F.lit(1), text).cast("decimal(20,0)").alias("b"))
    sums = hashed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select(F.floor(F.col("leaf") / fanout).cast("int").alias("node"), "leaf", "n", F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"))


def nodes(tree: DataFrame) -> DataFrame:
    """(node, digest) over the leaves of each node, at most ``fanout``."""
    own = F.array_sort(F.collect_list(F.struct("leaf", "n", "digest")))
    return tree.groupBy("node").agg(F.sha2(F.to_json(own), 256).alias("digest"))


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, leaf) of the leaves of two trees that differ, looked for below the nodes that differ."""

    def unlike(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        met = a.select(*on, F.col("digest").alias("__a")).join(b.select(*on, F.col("digest").alias("__b")), on, "full")
        return met.where(~F.col("__a").eqNullSafe(F.col("__b"))).select(*on)

    top = F.broadcast(unlike(nodes(old), nodes(new), ["node"]))
    below = unlike(old.join(top, "node", "left_semi"), new.join(top, "node", "left_semi"), ["node", "leaf"])
    keyless = old.where(F.col("leaf") == KEYLESS).unionByName(new.where(F.col("leaf") == KEYLESS)).select("node", "leaf")
    return below.unionByName(keyless).distinct()


def narrowed(rows: DataFrame, key: str, chosen: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The rows in the ``chosen`` leaves, of which there are at most ``fanout`` squared and one."""
    at = F.broadcast(chosen.select(F.col("leaf").alias("__leaf")))
    return rows.join(at, leaf_of(key, fanout) == F.col("__leaf"), "left_semi")


def sweep(old: DataFrame, new: DataFrame, roles: Roles = Roles(), fanout: int = FANOUT) -> DataFrame:
    """``audit.sweep_snapshots`` of the rows in differing leaves: the same result."""
    shared = [c for c in new.columns if c != roles.key and c in old.columns]
    chosen = differing(leaves(old, roles.key, shared, fanout), leaves(new, roles.key, shared, fanout))
    return sweep_snapshots(*(narrowed(rows.select(roles.key, *shared), roles.key, chosen, fanout) for rows in (old, new)), roles)


def write(rows: DataFrame, path: str, key: str = "code", fanout: int = FANOUT) -> None:
    """Stores a snapshot in a folder for each node, and its tree beside it."""
    columns = [c for c in rows.columns if c != key]
    leaves(rows, key, columns, fanout).coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")
    dealt = rows.withColumn("node", F.floor(leaf_of(key, fanout) / fanout).cast("int"))
    dealt.repartition("node").write.mode("overwrite").partitionBy("node").parquet(f"{path}/rows")


def sweep_stored(spark: SparkSession, old: str, new: str, roles: Roles = Roles(), fanout: int = FANOUT) -> DataFrame:
    """``sweep`` of two snapshots stored by ``write`` with the same columns: only the folders of differing nodes are read."""
    trees = [spark.read.parquet(f"{path}/tree") for path in (old, new)]
    chosen = differing(*trees)
    at = [r.node for r in chosen.select("node").distinct().collect()]  # at most fanout and one
    sides = [spark.read.parquet(f"{path}/rows").where(F.col("node").isin(*at)).drop("node") for path in (old, new)]
    return sweep_snapshots(*(narrowed(rows, roles.key, chosen, fanout) for rows in sides), roles)
