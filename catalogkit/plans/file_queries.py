"""Queries that write tables in the formats of a catalogue and answer from what the readers give back.

Their files lie in a folder of their own for each call, below the shared folder that the session names in
``spark.checkpoint.dir``; only a local session without one uses a temporary folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogkit.operators import postings, tags
from catalogkit.plans.adapters import view
from catalogkit.plans.queries import CLUSTERS, SOUGHT, TAG_MAP, _clusters, register
from catalogkit.sources import io
from catalogkit.sources.generations import Catalogue

FILE_ROWS = 500  # objects of a JSON file


def write_objects(rows: DataFrame, path: str, together: bool = False) -> None:
    """JSON files of about FILE_ROWS objects each, as an array, in a folder each, or ``together`` in the one folder file=0."""
    files = max(1, -(-rows.count() // FILE_ROWS))
    text = F.to_json(F.collect_list(F.struct(*rows.columns)))
    grouped = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(files)).alias("file")).agg(text.alias("value"))
    grouped = grouped.withColumn("file", F.lit(0)) if together else grouped
    grouped.write.option("maxRecordsPerFile", 1).partitionBy("file").text(path)  # a file holds one array


@register("SELECT code, title, owner, array_to_string(tags, '|') AS tags, k % 20 = 0 AS twice FROM items WHERE k % 7 <> 0", ("items",))
def scanned_items(spark: SparkSession, d: str) -> DataFrame:
    """Items written as JSON and scanned: those without a code are rejects, of repeated codes the last path counts."""
    at, items = io.scratch_folder(spark), view(spark, d, "items")
    own = items.select(F.when(F.col("k") % 7 != 0, F.col("code")).alias("code"), "title", "owner", "tags", (F.col("k") % 20 == 0).alias("twice"))
    write_objects(own.select("code", "title", "owner", "tags"), f"{at}/a")
    write_objects(own.where("twice").select("code", "title", "owner", "tags", F.lit("again").alias("series")), f"{at}/b")
    good, _ = io.read_items(spark, f"{at}/*/*")
    return good.select("code", "title", "owner", F.array_join("tags", "|").alias("tags"), F.col("series").isNotNull().alias("twice"))


@register("SELECT coalesce(CASE WHEN length(team) <> 6 THEN name END, 'file=0') AS name, avatar, team AS \"group\" FROM profiles", ("profiles",))
def scanned_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles written as JSON and read: one without a name has its folder's."""
    at = io.scratch_folder(spark)
    rows = view(spark, d, "profiles").select(F.when(F.length("team") != 6, F.col("name")).alias("name"), "avatar", F.col("team").alias("group"))
    write_objects(rows, at, together=True)
    return io.read_entities(spark, f"{at}/*/*").select("name", "avatar", "group")


@register("SELECT source, file_ord, id, coalesce(url, '') AS url, ja, coalesce(zh_cn, '') AS zh_cn, note FROM dictionary", ("dictionary",))
def tag_files(spark: SparkSession, d: str) -> DataFrame:
    """Dictionaries written as CSV, a file each, and read by their headers."""
    at, rows = io.scratch_folder(spark), view(spark, d, "dictionary")
    for name in ("one", "two"):
        io.write_csv(rows.where(F.col("source") == name), f"{at}/{name}.csv", ["note", "ja", "id", "url", "zh_cn"])
    back = io.read_tag_sources(spark, [f"{at}/one.csv", f"{at}/none.csv", f"{at}/two.csv"])
    return back.select("source", (F.col("file_ord") / 2).cast("int").alias("file_ord"), "id", F.coalesce("url", F.lit("")).alias("url"), "ja", F.coalesce("zh_cn", F.lit("")).alias("zh_cn"), "note")


@register("SELECT code, title, k % 3 = 0 AS old, k % 2 = 0 AS new FROM items WHERE k % 3 = 0 OR k % 2 = 0", ("items",))
def snapshots_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of one folder, the second written twice: the last writing alone counts."""
    at, items = io.scratch_folder(spark), view(spark, d, "items").select("k", "code", "title")
    io.write_snapshot(items.where("k % 3 = 0"), at, "old")
    io.write_snapshot(items, at, "new")
    io.write_snapshot(items.where("k % 2 = 0"), at, "new")
    old, new = io.read_snapshots(spark, at, "old", "new")
    marked = [rows.select("code", "title", F.lit(n == 0).alias("old"), F.lit(n == 1).alias("new")) for n, rows in enumerate((old, new))]
    return marked[0].unionByName(marked[1]).groupBy("code", "title").agg(F.bool_or("old").alias("old"), F.bool_or("new").alias("new"))


@register(
    """SELECT code, CASE WHEN k % 4 = 0 THEN 'new' ELSE title END AS title, k % 4 = 0 AND title IS DISTINCT FROM 'new' AS changed FROM items WHERE k % 5 <> 0 OR k % 4 = 0""",
    ("items",),
)
def committed_generations(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue after two commits and a dry run, with the rows that the second commit wrote."""
    own, items = Catalogue(spark, io.scratch_folder(spark)), view(spark, d, "items").select("k", "code", "title")
    own.commit(items.where("k % 5 <> 0").select("code", "title"), apply=True)
    own.commit(items.select("code", F.lit("dry").alias("title")))
    second = items.select("code", F.when(F.col("k") % 4 == 0, "new").otherwise(F.col("title")).alias("title"), (F.col("k") % 4 == 0).alias("fresh"), "k").where("fresh OR k % 5 <> 0")
    change = own.commit(second.select("code", "title"), apply=True)
    return own.read().join(change.rows.select("code", F.lit(True).alias("c")), "code", "left").select("code", "title", F.coalesce("c", F.lit(False)).alias("changed"))


@register("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2")
def report_read_back(spark: SparkSession, d: str) -> DataFrame:
    """A report written as JSON and read again."""
    at = io.scratch_folder(spark)
    rows = view(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first"))
    io.write_report(rows, at)
    return spark.read.schema("flag string, status string, n long, first int").json(at)


@register("SELECT DISTINCT trim(p_name) AS code FROM part WHERE trim(p_name) <> '' UNION SELECT 'X-1'")
def code_list(spark: SparkSession, d: str) -> DataFrame:
    """Codes from a text file with blanks, and more that are given."""
    at = io.scratch_folder(spark)
    view(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise(F.col("p_name")).alias("value")).union(spark.createDataFrame([("",), ("  ",)], "value string")).write.text(at)
    return io.read_codes(spark, at, [" X-1", ""])


@register(
    f"""WITH {CLUSTERS}, {TAG_MAP}, sought AS (SELECT unnest([{", ".join(f"'{q}'" for q in SOUGHT)}]) AS query), vals AS (
            SELECT code, unnest([code, title, owner, maker, label, series]) AS v FROM items UNION ALL SELECT code, unnest(tags) FROM items
            UNION ALL SELECT code, team FROM items i JOIN profiles p ON p.name = i.owner UNION ALL SELECT code, alias FROM items i JOIN cl ON cl.canonical = i.owner
            UNION ALL SELECT code, dst FROM (SELECT code, unnest(tags) AS t FROM items) x JOIN tm ON tm.src = x.t)
        SELECT DISTINCT query, code FROM sought JOIN vals ON contains(lower(v), lower(trim(query)))""",
    ("items", "profiles", "edges", "curated", "dictionary"),
)
def stored_search(spark: SparkSession, d: str) -> DataFrame:
    """The search over all fields, through an index that is stored first."""
    at = io.scratch_folder(spark)
    owners = view(spark, d, "profiles").select(F.col("name").alias("src"), F.col("team").alias("dst"))
    values = postings.searched_values(view(spark, d, "items"), owners, _clusters(spark, d), tags.build_tag_map(view(spark, d, "dictionary")))
    values.write.parquet(f"{at}/values")
    postings.write(postings.build(spark.read.parquet(f"{at}/values")), f"{at}/index", digits=1)
    return postings.search(postings.load(spark, f"{at}/index"), SOUGHT, digits=1)
