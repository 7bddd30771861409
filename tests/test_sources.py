from pyspark.sql import functions as F

from catalogkit.operators.merge import fill_merge
from catalogkit.sources import io, pages
from catalogkit.streaming.observe import fold_stream


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_items_are_quarantined_and_the_last_path_wins(spark, tmp_path):
    put(tmp_path / "w", "a.json", '{"code": "A-1", "title": "old", "duration": 150}')
    put(tmp_path / "w", "b.json", '{"code": "A-1", "title": "new", "duration": "150分"}')
    put(tmp_path / "w", "c.json", '{"title": "none"}')
    put(tmp_path / "w", "d.json", "not json")
    good, bad = io.read_items(spark, str(tmp_path / "w"))
    assert [(r.code, r.title, r.duration) for r in good.collect()] == [("A-1", "new", "150分")]
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in bad.collect()) == [("c.json", "no_code"), ("d.json", "unparsable")]


def test_dictionaries_and_listings(spark, tmp_path):
    put(tmp_path, "maps.json", '{"tag": {"a": "A"}}')
    maps = io.read_maps(spark, str(tmp_path / "maps.json"), ["tag", "title"])
    assert [tuple(r) for r in maps["tag"].collect()] == [("a", "A")] and maps["title"].count() == 0
    put(tmp_path, "alias.json", '{"A": ["B"]}')
    assert {tuple(r) for r in io.read_aliases(spark, str(tmp_path / "alias.json")).collect()} == {("A", "A"), ("A", "B")}
    put(tmp_path, "one.csv", "﻿id,ja,zh_cn\n1,j,c\n")
    put(tmp_path, "two.csv", "en,extra\ne,x\n")
    rows = io.read_tag_sources(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")]).collect()
    assert [(r.source, r.file_ord, r.id, r.ja, r.en) for r in rows] == [("one", 0, "1", "j", None), ("two", 1, None, None, "e")]
    put(tmp_path, "codes.txt", " A-1 \n\nB-2\n")
    assert {r.code for r in io.read_codes(spark, str(tmp_path / "codes.txt"), ["B-2", "C-3"]).collect()} == {"A-1", "B-2", "C-3"}
    put(tmp_path / "p" / "Ann", "profile.json", '{"bio": "x"}')
    assert [(r.name, r.bio) for r in io.read_entities(spark, str(tmp_path / "p" / "*")).collect()] == [("Ann", "x")]
    assert [(r.parent, r.fn) for r in io.list_files(spark, str(tmp_path / "p")).collect()] == [("Ann", "profile.json")]


def test_snapshots_hold_only_their_own_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    old = spark.createDataFrame([("A-1", "")], "code string, title string")
    merged = fill_merge(old, spark.createDataFrame([("A-1", "t")], "code string, title string"), ["title"])
    io.write_snapshot(old, path, "one")
    io.write_snapshot(io.changed_only(merged), path, "two")
    io.write_snapshot(old, path, "one")
    before, after = io.read_snapshots(spark, path, "one", "two")
    assert (before.first().title, after.first().title) == ("", "t")
    io.write_csv(after, str(tmp_path / "csv"), ["title", "code"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["title", "code"]


PAGE = """<html><title>T | Site</title><meta content="https://i/x.jpg" property="og:image"><h1> The <b>head</b> </h1>
<script>{"maker": {"name": "Mk"}, "actor": [{"name": "A"}, {"name": "B"}, {"name": "A"}], "duration": "PT1H30M", "rating": 4.5}</script>
<dl><dt>Label:</dt><dd><a>Lb</a></dd></dl><table><tr><th>Maker：</th><td>Mk</td></tr></table>
<a href="/tag/1">red</a><a href="/tag/2">more</a><a href="/tag/1">red</a><img src="s.jpg" data-src="d.jpg">
<div class="n"><a>Ann</a><span class="male">m</span><a>Bea</a></div></html>"""


def test_page_rules(spark):
    page = spark.createDataFrame([(1, "https://h.example.com/a/b?q", PAGE)], "page_id long, url string, html string")
    h = F.col("html")
    one = page.select(
        pages.page_title(h).alias("title"), pages.page_title(h, "The head").alias("second"), pages.og_image(h).alias("image"), pages.json_names(h, "actor").alias("cast"), pages.json_names(h, "maker").alias("maker"),
        pages.json_field(h, "rating").alias("rating"), pages.duration(h).alias("minutes"), pages.definition(h, ["レーベル", "Label"]).alias("label"), pages.link_texts(h, "/tag/", ["more"]).alias("tags"),
        pages.lazy_image(h).alias("lazy"), pages.absolute_url(F.lit("/x"), F.col("url")).alias("root"), pages.absolute_url(F.lit("x"), F.col("url")).alias("beside"),
        pages.unlinked_names(h, '<div class="n">', "</div>", "male").alias("names"), pages.iso_date(F.lit("on 2001年2月3日")).alias("date"),
    ).first()
    assert (one.title, one.second, one.image, one.cast, one.maker, one.rating, one.minutes, one.label, one.tags) == ("The head", "T", "https://i/x.jpg", ["A", "B"], ["Mk"], "4.5", 90, "Lb", ["red"])
    assert (one.lazy, one.root, one.beside, one.names, one.date) == ("d.jpg", "https://h.example.com/x", "https://h.example.com/a/x", ["Bea"], "2001-02-03")
    synonyms = spark.createDataFrame([("maker", "maker")], "label string, field string")
    assert [tuple(r) for r in pages.labelled_rows(page, synonyms).collect()] == [(1, "maker", "Mk")]
    assert page.select(pages.profile_header(F.lit("<h1>Ann (reading / Roman)</h1>")).alias("p")).first().p.asDict() == {"name": "Ann", "reading": "reading", "roman": "Roman"}
    gated = pages.page_gates(page.withColumn("t", F.lit(None).cast("string")), shortest=10, blocked=["are you human"], needed=["t"])
    assert gated.first().reject_reason == "no_fields" and pages.page_gates(page).first().reject_reason == "short"
    seen = pages.extract_pages(page, {"title": pages.page_title(h), "maker": pages.json_field(h, "maker")}, "site", 2, withheld=["maker"]).first()
    assert (seen.title, seen.maker, seen.source, seen.priority) == ("The head", None, "site", 2)


def test_stream_of_observations_folds_into_snapshots(spark, tmp_path):
    schema = "code string, source string, priority int, title string"
    io.write_snapshot(spark.createDataFrame([("A-1", "", "")], "code string, title string, owner string"), str(tmp_path / "s"), "first")
    spark.createDataFrame([("A-1", "x", 1, "found")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = fold_stream(stream, str(tmp_path / "s"), "first", str(tmp_path / "c"), ["title"])
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s" / "snapshot_id=batch-0")).first().title == "found"
