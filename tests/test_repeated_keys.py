"""A key that repeats on the right of a join multiplies no rows."""

from catalogkit.operators import index, mapping, rename, serving, tags


def test_apply_mapping(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", "y", "own"), ("c", "q", "")], "code string, src string, dst string")
    known = spark.createDataFrame([("x", "z", "accepted"), ("x", "m", "accepted"), ("x", "a", "ambiguous"), ("y", "n", "accepted")], "src string, dst string, status string")
    assert sorted(map(tuple, mapping.apply_mapping(rows, known, "src", "dst").collect())) == [("a", "x", "m", "mapped"), ("b", "y", "own", "kept"), ("c", "q", None, "unmapped")]


def test_url_candidates(spark):
    items = spark.createDataFrame([("ABC-12",), ("ABC-12",)], "code string")
    shapes = [("ABC", "7", 5, "v", "pl", 1), ("ABC", "", 3, "v", "pl", 4)]
    got = mapping.url_candidates(items, spark.createDataFrame(shapes, "prefix string, lead string, pad int, section string, suffix string, votes long"), "code", "h/", [])
    assert [r.url for r in got.orderBy("pos").collect()] == ["h/v/abc012/abc012pl.jpg", "h/v/abc00012/abc00012pl.jpg"]


def test_plan_renames(spark):
    files = spark.createDataFrame([("p", "1", "ABC-012.mp4"), ("p", "2", "ABD-1.mp4")], "parent string, fid string, fn string")
    items = spark.createDataFrame([("ABC-012", "Zed", "2020-01-02"), ("ABC-012", "Alpha", "2020-01-03"), ("ABD-001", "One", "2020-01-01"), ("ABD-001", "One", "2020-01-01"), ("ABD-1", "One", "2020-01-01"), ("ABD-1", "One", "2020-01-01")], "code string, title string, date string")
    got = {r.fid: r for r in rename.plan_renames(files, items).collect()}
    assert len(got) == 2 and rename.plan_renames(files, items).count() == 2
    assert "Alpha" in got["1"].new and "ambiguous" in got["1"].issues and "ambiguous" not in got["2"].issues


def test_cache_split(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    cache = spark.createDataFrame([("a", None), ("a", "hit"), ("b", None), ("b", None)], "code string, payload string")
    assert sorted(map(tuple, index.cache_split(keys, cache).collect())) == [("a", "hit"), ("b", "miss"), ("c", "untried")]


def test_translate_aligned(spark):
    items = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"])], "k long, tags array<string>")
    double = spark.createDataFrame([("a", "2"), ("a", "1"), ("c", "3")], "src string, dst string")
    assert [r.tags_zh for r in tags.translate_aligned(items, "tags", double).collect()] == [["1", "b"]] * 2


def test_attach_profiles(spark):
    owners = spark.createDataFrame([("x",), ("y",)], "owner string")
    profiles = spark.createDataFrame([("x", "u2"), ("x", "u1")], "name string, avatar string")
    assert sorted((r.owner, r.name, r.avatar) for r in index.attach_profiles(owners, profiles).collect()) == [("x", "x", "u1"), ("y", "y", None)]


def test_head_and_rest_uses_no_single_task_window(spark):
    rows = spark.range(50).toDF("n")
    got = serving.head_and_rest(rows, ["n"], 3)
    assert [tuple(r) for r in got.collect()] == [(0, 47), (1, 47), (2, 47)]
    assert "Window" not in got._jdf.queryExecution().toString()
    assert serving.head_and_rest(rows.limit(0), ["n"], 3).collect() == []
