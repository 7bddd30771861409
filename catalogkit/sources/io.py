"""Reading and writing catalogues: quarantined scans, dictionaries, snapshots and reports.

Every reader goes through Spark, so paths may be on any file system that Spark knows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.operators.ordered import keep_last
from catalogkit.sources.schema import ENTITIES, ITEMS, TAG_SOURCES


def read_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, rejects): one JSON object per file.  Rejects (path, reason) are unreadable files and those without
    a code; of files with one code the last path counts."""
    raw = spark.read.schema(ITEMS).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("path", F.col("_metadata.file_path"))
    reason = F.when(F.col("_corrupt_record").isNotNull(), "unparsable").when(F.coalesce("code", F.lit("")) == "", "no_code")
    raw = raw.withColumn("reason", reason)
    good = keep_last(raw.where("reason IS NULL").drop("reason", "_corrupt_record"), ["code"], ["path"])
    return good, raw.where("reason IS NOT NULL").select("path", "reason")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, on whatever file system, is there."""
    try:
        return not spark.read.format("binaryFile").load(path).select("path").limit(1).isEmpty()
    except AnalysisException:
        return False


def read_entities(spark: SparkSession, path: str, folder_wins: bool = False) -> DataFrame:
    """Profiles keyed by their folder; the name is the profile's own unless ``folder_wins`` or it has none."""
    raw = spark.read.schema(ENTITIES).option("multiLine", True).json(path)
    folder = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    raw = raw.withColumn("folder", folder)
    return raw.withColumn("name", F.col("folder") if folder_wins else F.coalesce(F.nullif("name", F.lit("")), "folder"))


def read_maps(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """name -> (src, dst) from a JSON object of string maps; absent maps, and those of an absent or unreadable file, are
    empty."""
    schema = ", ".join(f"`{n}` map<string,string>" for n in names)
    if exists(spark, path):
        raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    else:
        raw = spark.createDataFrame([], schema)
    return {n: raw.select(F.explode(n).alias("src", "dst")) for n in names}


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, alias) edges of a JSON object of string arrays; every canonical name lists itself too."""
    text = spark.read.option("wholetext", True).text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("canonical", "aliases"))
    own = pairs.select("canonical", F.col("canonical").alias("alias"))
    return own.unionByName(pairs.select("canonical", F.explode("aliases").alias("alias"))).distinct()


def invert_aliases(edges: DataFrame) -> DataFrame:
    return edges.groupBy("alias").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals"))


def read_tag_sources(spark: SparkSession, paths: Sequence[str], legacy: str | None = None) -> DataFrame:
    """Rows of header-driven CSV files with the source's name (the file's), file and row order; missing columns are null.

    Files that are absent or hold no header are skipped, and a file that the folder ``legacy`` holds too is read from
    there."""
    out = None
    for i, path in enumerate(paths):
        older = f"{legacy}/{path.rsplit('/', 1)[-1]}" if legacy else None
        chosen = older if older and exists(spark, older) else path
        if not exists(spark, chosen):
            continue
        part = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(chosen)
        if not set(part.columns) & set(TAG_SOURCES):
            continue
        columns = [(F.col(c) if c in part.columns else F.lit(None).cast("string")).alias(c) for c in TAG_SOURCES]
        source = F.regexp_replace(F.url_decode(F.regexp_extract(F.lit(path), r"([^/]+)/?$", 1)), r"\.[^.]*$", "")
        part = part.select(source.alias("source"), F.lit(i).alias("file_ord"), F.monotonically_increasing_id().alias("row_ord"), *columns)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], ", ".join(["source string", "file_ord int", "row_ord long", *[f"`{c}` string" for c in TAG_SOURCES]]))
    return out


def read_codes(spark: SparkSession, path: str | None, more: Sequence[str] = ()) -> DataFrame:
    """(code): the lines of a text file and those given, trimmed, not empty, distinct."""
    given = spark.createDataFrame([(c,) for c in more], "code string")
    lines = spark.read.text(path).select(F.col("value").alias("code")) if path else given.limit(0)
    return lines.union(given).select(F.trim("code").alias("code")).where("code <> ''").distinct()


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(parent, fid, fn, file_path) of the files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parent"), F.sha2("path", 256).alias("fid"), name.alias("fn"), F.col("path").alias("file_path"))


def storage_index(spark: SparkSession, path: str) -> DataFrame:
    """(code, file_path, folder, file_name) from the stored files' names."""
    files = list_files(spark, path)
    return files.select(F.upper(F.regexp_replace("fn", r"\.[^.]*$", "")).alias("code"), "file_path", F.col("parent").alias("folder"), F.col("fn").alias("file_name"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares, ``spark.checkpoint.dir``; a local session without one gets a
    temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='catalogkit-')).rstrip('/')}/{uuid.uuid4().hex}"


def write_snapshot(items: DataFrame, path: str, snapshot_id: str) -> None:
    """One partition per snapshot; writing a snapshot again replaces it alone."""
    items.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def read_snapshots(spark: SparkSession, path: str, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    every = spark.read.parquet(path)
    return tuple(every.where(F.col("snapshot_id") == s).drop("snapshot_id") for s in (old, new))


def changed_only(merged: DataFrame) -> DataFrame:
    """The rows a merge changed, without its bookkeeping: what a dry run shows and an apply writes."""
    return merged.where("changed").drop("changed", "changed_keys")


def write_changes(merged: DataFrame, path: str, snapshot_id: str, apply: bool = False) -> DataFrame:
    """The rows a merge changed; with ``apply`` they are written as the snapshot ``snapshot_id``, else it is a dry run.

    The folder of a snapshot appears as a whole when the job commits, so readers see all of it or nothing."""
    rows = changed_only(merged)
    if apply:
        write_snapshot(rows, path, snapshot_id)
    return rows


def overlay(base: DataFrame, *changes: DataFrame, key: str = "code") -> DataFrame:
    """``base`` with its rows replaced by those of the latest change that holds their key; new keys are added."""
    columns = base.columns
    every = base.withColumn("__at", F.lit(0))
    for i, part in enumerate(changes):
        every = every.unionByName(part.select(columns).withColumn("__at", F.lit(i + 1)))
    return keep_last(every, [key], ["__at"]).drop("__at")


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_index(index: DataFrame, path: str) -> None:
    """The nested index, a row per entity."""
    index.write.mode("overwrite").parquet(path)
