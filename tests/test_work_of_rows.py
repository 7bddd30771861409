"""What a row costs: each text is searched once, and a small file's rows are dealt to all cores."""

import pytest

from catalogkit.plans import file_queries, queries, site_queries
from catalogkit.sources import pages
from pyspark.sql import functions as F
from test_queries import SF


@pytest.mark.parametrize(
    "field, searched, times",
    [(pages.page_title, "<h1", 1), (pages.profile_header, "<h[12]", 1), (lambda h: pages.sizes(pages.definition(h, ["Size"])), "<dt", 1), (pages.duration, "regexp_extract(html", 3)],
)
def test_each_text_is_searched_once(spark, field, searched, times):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id long, html string").repartition(2)
    plan = rows.select(field(F.col("html")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(searched) == times


def test_pages_are_dealt_to_all_cores(spark):
    assert site_queries.site(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_filter_on_a_plan_reads_no_name_twice(spark):
    for rows in (site_queries.renamed_files(spark, SF), queries.rename_collisions(spark, SF)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        # the step that cuts the volume stands in the plan once, and in no filter
        assert plan.count(r"(?is)^(.*?)\.part\d+") == 1
        assert queries._plan(spark, SF).rdd.getNumPartitions() > 1


def test_profiles_are_read_from_few_files(spark, monkeypatch):
    read = {}
    monkeypatch.setattr(file_queries.io, "read_entities", lambda s, path, f=file_queries.io.read_entities: read.setdefault("rows", f(s, path)))
    n = file_queries.scanned_profiles(spark, "/root/testdata/sf0.1").count()
    files = len(read["rows"].inputFiles())
    assert n == 900 and 1 <= files <= 2 * -(-n // file_queries.FILE_ROWS)
