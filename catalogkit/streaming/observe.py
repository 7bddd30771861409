"""Observations that arrive continuously, folded into a catalogue.

A micro-batch writes only the items that it changed, as a partition of its own beside the first snapshot; the
current catalogue is the snapshot under these changes, and ``compact`` writes it out.  The fold is idempotent: a
micro-batch that runs again reads the same changes before it and replaces its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalogkit.operators.merge import Roles, chain_fill
from catalogkit.operators.ordered import keep_last
from catalogkit.sources.io import write_snapshot


def current(spark: SparkSession, snapshots: str, first: str, before: int | None = None, key: str = "code") -> DataFrame:
    """The items of snapshot ``first`` under the changes of all batches, or of those before number ``before``."""
    rows = spark.read.parquet(snapshots)
    number = F.regexp_extract(F.col("snapshot_id").cast("string"), r"^batch-(\d+)$", 1).try_cast("int")
    at = F.when(F.col("snapshot_id") == first, -1).otherwise(number)
    rows = rows.withColumn("__at", at).where("__at IS NOT NULL")
    rows = rows.where(F.col("__at") < before) if before is not None else rows
    return keep_last(rows.drop("snapshot_id"), [key], ["__at"]).drop("__at")


def fold_stream(observations: DataFrame, snapshots: str, first: str, checkpoint: str, fields: Sequence[str], stop_on: Sequence[str] | None = None, roles: Roles = Roles()) -> StreamingQuery:
    """Starts a query that reads the stream ``observations`` and writes the items that batch N changed as ``batch-N``."""

    def fold(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        items = current(batch.sparkSession, snapshots, first, number, roles.key)
        seen = items.join(batch.select(roles.key).distinct(), roles.key, "left_semi")
        merged = chain_fill(seen, batch, fields, stop_on, roles=roles).where(F.size("filled_from") > 0).drop("filled_from")
        write_snapshot(merged, snapshots, f"batch-{number}")

    return observations.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, snapshots: str, first: str, path: str, name: str, roles: Roles = Roles()) -> None:
    """Writes the current catalogue as the snapshot ``name`` of the folder ``path``."""
    write_snapshot(current(spark, snapshots, first, key=roles.key), path, name)
