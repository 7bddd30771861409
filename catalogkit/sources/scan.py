"""Folders of item files, read again only where they changed.

The manifest is a catalogue of committed generations with a row for each file: its path, length and time, and what reading it
gave, an item or the reason why there is none.  A scan lists the folder, which opens no file, and reads the files
that the manifest lacks or holds with another length or time.  Files that are gone leave the manifest.  So items,
rejects and the index from keys to paths are tables, not scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.operators.ordered import keep_last
from catalogkit.sources.generations import Catalogue
from catalogkit.sources.schema import ITEMS

FILES = "path string, length long, modified timestamp"


def _plain(path: Column) -> Column:
    """One spelling of a path: readers write the slashes after the scheme differently."""
    return F.regexp_replace(path, "^([a-z0-9+.-]+):/+", "$1:/")


def listing(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, length, modified) of the files below a folder whose names match; no file is opened."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    except AnalysisException:  # no such folder
        return spark.createDataFrame([], FILES)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, length, modified, reason, item) of listed files: reason is unparsable, no_code or null.

    The list of changed files goes through the driver, as Spark's own list of a folder does."""
    paths = [r.path for r in files.select("path").collect()]
    if not paths:
        return files.select("*", F.lit(None).cast("string").alias("reason"), F.lit(None).cast(_item_type()).alias("item"))
    raw = spark.read.schema(ITEMS).option("multiLine", True).option("mode", "PERMISSIVE").json(paths).withColumn("__path", _plain(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))))
    reason = F.when(F.col("_corrupt_record").isNotNull(), "unparsable").when(F.coalesce("code", F.lit("")) == "", "no_code")
    item = F.struct(*[c for c in raw.columns if c not in ("_corrupt_record", "__path")])
    # a file that holds no object at all gives no row
    read = raw.groupBy("__path").agg(F.first(reason, ignorenulls=True).alias("reason"), F.max_by(item, F.coalesce("code", F.lit(""))).alias("item"), F.lit(True).alias("__read"))
    met = files.join(read, _plain(F.col("path")) == F.col("__path"), "left")
    why = F.when(F.col("__read").isNull(), "unparsable").otherwise(F.col("reason"))
    return met.select("path", "length", "modified", why.alias("reason"), F.when(why.isNull(), F.col("item")).alias("item"))


def _item_type() -> str:
    fields = [f for f in _fields() if f[0] != "_corrupt_record"]
    return "struct<" + ",".join(f"`{n}`:{t}" for n, t in fields) + ">"


def _fields() -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    schema = ITEMS if isinstance(ITEMS, StructType) else StructType.fromDDL(ITEMS)
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


@dataclass(frozen=True)
class Scan:
    manifest: DataFrame
    read: int  # files that were read
    gone: int  # files that left
    generation: int | None


def rescan(spark: SparkSession, path: str, state: str, pattern: str = "*.json", apply: bool = True) -> Scan:
    """Brings the manifest in the folder ``state`` up to the files below ``path``, and tells how many files it read.

    Without ``apply`` the manifest is not written, and files are only counted."""
    own = Catalogue(spark, state, "path")
    held, there = own.read(), listing(spark, path, pattern)
    if held is None:
        changed, kept, gone = there, None, 0
    else:
        before = held.select(F.col("path").alias("__p"), F.col("length").alias("__n"), F.col("modified").alias("__t"))
        same = (F.col("path") == F.col("__p")) & F.col("length").eqNullSafe(F.col("__n")) & F.col("modified").eqNullSafe(F.col("__t"))
        changed = there.join(before, same, "left_anti")
        kept = held.join(there.select("path", "length", "modified"), ["path", "length", "modified"], "left_semi")
        gone = held.join(there.select("path"), "path", "left_anti").count()
    n = changed.count()
    if not apply:
        return Scan(held if held is not None else read_files(spark, there.limit(0)), n, gone, None)
    rows = read_files(spark, changed)
    rows = rows if kept is None else kept.select(rows.columns).unionByName(rows)
    change = own.commit(rows, whole=True, apply=True) if n or gone or held is None else None
    return Scan(own.read(), n, gone, change.generation if change else None)


def items(manifest: DataFrame) -> DataFrame:
    """The items of a manifest with their ``path``; of files with one code the last path counts."""
    good = manifest.where("reason IS NULL").select("item.*", "path")
    return keep_last(good, ["code"], ["path"])


def rejects(manifest: DataFrame) -> DataFrame:
    return manifest.where("reason IS NOT NULL").select("path", "reason")


def paths(manifest: DataFrame) -> DataFrame:
    """(code, file_path): where each key's item stands; the code is the file's name, without its ending, in capitals."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return manifest.select(F.upper(name).alias("code"), F.col("path").alias("file_path"))
