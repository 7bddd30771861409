"""Shared pieces of the training-data operators: lineage cuts, hash folds and distributed running sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``; a session without one gets a folder of its own on a
    local master (one machine, as in tests) and an error on a cluster.  Spark removes checkpoints that are
    no longer used where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """As ``settle``, by a table written to the same folder, which stays until the folder is cleared.

    For loops of joins: a checkpoint hands on its plan's estimated size, and a table that is joined to itself round by round
    squares the estimate each time, until planning takes minutes; a written table has its true size.
    """
    path = f"{_shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids fall into fold -1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % modulus, F.lit(-1)).cast("int")


def sample_by_hash(df: DataFrame, id_column: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest id hash: the same rows on every run and partitioning."""
    return df.orderBy(F.xxhash64(id_column), id_column).limit(n)


def running_sum(df: DataFrame, amount: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the same ``keys`` before this one in ``order``.  Keys hold
    no nulls, and no two rows are equal in keys and order.

    Two levels, so that a key holding most rows is spread: ranges of (keys, order) of about equal size, a
    window inside each key and range, and a window over the range totals, of which there are few.
    """
    ranged = settle(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__in_range", F.coalesce(F.sum(amount).over(inside), F.lit(0)).cast("long"))
    totals = ranged.groupBy(*keys, "__range").agg(F.sum(amount).alias("__total"))
    across = Window.orderBy("__range") if not keys else Window.partitionBy(*keys).orderBy("__range")
    across = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__range", F.coalesce(F.sum("__total").over(across), F.lit(0)).cast("long").alias("__before"))
    return local.join(offsets, [*keys, "__range"]).withColumn(out, F.col("__before") + F.col("__in_range")).drop("__before", "__in_range", "__range")


def attach(left: DataFrame, right: DataFrame, key: str, total: int, most: int = 1000) -> DataFrame:
    """``left`` joined to ``right`` (a row per ``key``, with ``n``, its number of rows in ``left``), however many rows a
    key holds; n is dropped.

    Keys with more than 1 / ``most`` of all ``total`` rows are fewer than ``most``, so that they are broadcast; the
    others meet in an ordinary join.  ``left`` is read twice.
    """
    hot = F.broadcast(right.where(F.col("n") * most > total))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col("n") * most <= total).drop("n"), key)
    return rest.unionByName(left.join(hot.drop("n"), key))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that is not among ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sample_labelled(docs: DataFrame, known: DataFrame, sample_rows: int, longest: int | None = None, most_long: int = 50) -> DataFrame:
    """The columns of ``docs`` and y, of at most ``sample_rows`` rows for each of the labels 0 and 1, one row per doc_id.

    ``known`` holds (doc_id, y), a row per id.  Chosen are the ids with the smallest hashes; texts over ``longest``
    characters come after all others, at most ``most_long`` of them.  Null texts are left out.
    """
    long = F.length("text") > longest if longest else F.lit(False)
    own = F.min(F.struct("long", "hash")).alias("own")
    # hashed before the join, which then moves no text
    hashed = docs.where("text IS NOT NULL").select("doc_id", long.alias("long"), F.xxhash64("text").alias("hash"))
    ids = settle(hashed.join(known, "doc_id").groupBy("doc_id", "y").agg(own).select("doc_id", "y", "own.*"))
    parts = []
    for label in (0, 1):
        mine = ids.where(F.col("y") == label)
        few = sample_by_hash(mine.where("NOT long"), "doc_id", sample_rows)
        more = sample_by_hash(mine.where("long"), "doc_id", most_long).withColumn("late", F.lit(1))
        both = few.withColumn("late", F.lit(0)).unionByName(more)
        parts.append(both.orderBy("late", F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    chosen = settle(parts[0].unionByName(parts[1]).select("doc_id", "y", "hash"))
    found = docs.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "hash"])
    rest = [c for c in docs.columns if c != "doc_id"]
    return found.groupBy("doc_id", "y").agg(F.min(F.struct(*rest)).alias("own")).select("doc_id", "y", "own.*")
