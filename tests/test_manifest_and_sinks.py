import json
import os

import pytest
from pyspark.sql import functions as F

from catalogkit.functions import phrases
from catalogkit.operators import audit, digests, index
from catalogkit.operators.merge import Roles
from catalogkit.sources import pages, scan


def put(path, name, value):
    with open(f"{path}/{name}", "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))


def test_a_second_scan_reads_changed_files_only(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    assert scan.rescan(spark, str(tmp_path / "none"), str(tmp_path / "empty")).read == 0
    for i in range(6):
        put(folder, f"a {i}+.json", {"code": f"A-{i}", "title": f"t{i}"})
    put(folder, "bad.json", "{nope")
    put(folder, "empty.json", {"title": "no code"})
    put(folder, "twice.json", {"code": "A-0", "title": "last"})
    put(folder, "skipped.txt", "x")
    first = scan.rescan(spark, str(folder), state)
    assert (first.read, first.gone, first.generation) == (9, 0, 0)
    assert {(r.code, r.title) for r in scan.items(first.manifest).collect()} == {("A-0", "last"), *((f"A-{i}", f"t{i}") for i in range(1, 6))}
    assert {(os.path.basename(r.path), r.reason) for r in scan.rejects(first.manifest).collect()} == {("bad.json", "unparsable"), ("empty.json", "no_code")}
    again = scan.rescan(spark, str(folder), state)
    assert (again.read, again.gone, again.generation) == (0, 0, None)
    put(folder, "a 3+.json", {"code": "A-3", "title": "newer"})
    os.utime(folder / "a 3+.json", (2_000_000_000, 2_000_000_000))
    (folder / "a 4+.json").unlink()
    dry = scan.rescan(spark, str(folder), state, apply=False)
    assert (dry.read, dry.gone, dry.generation) == (1, 1, None)
    second = scan.rescan(spark, str(folder), state)
    assert (second.read, second.gone, second.generation) == (1, 1, 1)
    got = {r.code: r.title for r in scan.items(second.manifest).collect()}
    assert got == {"A-0": "last", "A-1": "t1", "A-2": "t2", "A-3": "newer", "A-5": "t5"}
    assert "BAD" in {r.code for r in scan.paths(second.manifest).collect()}


def test_saved_index_meets_saved_profiles_without_an_exchange(spark, tmp_path):
    items = spark.createDataFrame([(f"A-{i}", f"o{i % 7}", f"t{i}") for i in range(40)], "code string, owner string, title string")
    profiles = spark.createDataFrame([(f"o{i}", f"u{i}") for i in range(5)] + [("o1", "u0")], "name string, avatar string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for t in ("idx_saved", "profiles_saved"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
        index.save_index(index.group_index(items, nested=True), "idx_saved", 4, f"{tmp_path}/i")
        index.save_profiles(profiles, "profiles_saved", 4, f"{tmp_path}/p")
        out = index.profiled_items(spark, "idx_saved", "profiles_saved")
        rows = {r.code: (r.owner, r.avatar, r.title) for r in out.select("code", "owner", "avatar", "title").collect()}
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 40 and rows["A-1"] == ("o1", "u0", "t1") and rows["A-6"] == ("o6", None, "t6")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("idx_saved", "profiles_saved"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_counters_come_with_the_write(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 3 == 0).alias("moved"), F.when(F.col("id") % 2 == 0, F.array(F.lit("title"))).otherwise(F.array(F.lit("date"), F.lit("title"))).alias("filled"))
    calls = []
    got = audit.counted(rows, lambda df: calls.append(df.write.parquet(f"{tmp_path}/out")), flags=["moved"], events="filled", fields=["title", "date", "tags"])
    back = spark.read.parquet(f"{tmp_path}/out")
    assert len(calls) == 1 and got == {"rows": 100, "moved": back.where("moved").count(), "field:title": 100, "field:date": 50, "field:tags": 0}


def snapshots(spark, n=3000):
    schema = "code string, owner string, source string, cast array<string>, title string"
    old = [(f"k{i}", "o" if i % 5 else None, "s", ["o"], "t") for i in range(n)] + [("lost", "o", "s", [], "t"), (None, "o", "s", [], "t")]
    new = [(f"k{i}", "x" if i in (7, 10) else "o" if i % 5 else None, "s", ["o"], "u" if i == 99 else "t") for i in range(n)] + [("fresh", None, None, None, None), (None, "o", "s", [], "t")]
    return spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)


def test_sweep_by_digests_equals_the_sweep_of_all_rows(spark, tmp_path):
    old, new = snapshots(spark)
    key = lambda df: sorted(map(str, df.collect()))
    want = key(audit.sweep_snapshots(old, new, Roles()))
    assert len(want) == 7 and key(digests.sweep(old, new)) == want
    assert key(digests.sweep(old, new, fanout=4)) == want
    assert digests.sweep(old.where("code IS NOT NULL"), old.where("code IS NOT NULL").repartition(3)).collect() == []
    digests.write(old, f"{tmp_path}/old")
    digests.write(new, f"{tmp_path}/new")
    assert key(digests.sweep_stored(spark, f"{tmp_path}/old", f"{tmp_path}/new")) == want


def test_rows_of_equal_leaves_are_not_shuffled(spark):
    old, new = snapshots(spark)
    columns = ["owner", "source", "cast", "title"]
    chosen = digests.differing(digests.leaves(old, "code", columns), digests.leaves(new, "code", columns))
    assert chosen.count() <= 6
    left = digests.narrowed(old, "code", chosen)
    assert left.count() <= 20
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def brute_convert(text, table):
    out, at = "", 0
    while at < len(text):
        best = max((s for s in table if s and text.startswith(s, at)), key=len, default=None)
        out, at = (out + table[best], at + len(best)) if best else (out + text[at], at + 1)
    return out


def test_phrases_take_the_longest_match(spark):
    table = {"後來": "后来", "後": "后", "來": "来", "皇后": "皇后", "發": "发", "頭髮": "头发", "理髮": "理发", "髮": "发", "理髮師傅": "理发师傅", "a": "", "ab": "x", "abc": "y", "bcd": "z"}
    texts = ["後來皇后理髮師傅理髮頭髮發", "abcd", "abab", "aabcbcd", "", None, "zz", "理髮師"]
    chars = spark.createDataFrame([(k, v) for k, v in table.items() if len(k) == 1] + [("ab", "wrong")], "src string, dst string")
    longer = spark.createDataFrame([(k, v) for k, v in table.items() if len(k) > 1] + [("ab", "z"), ("", "q"), ("no", None)], "src string, dst string")
    convert = phrases.converter(longer, chars)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", convert("t").alias("c")).sort("i").collect()
    assert [r.c for r in got] == [None if t is None else brute_convert(t, table) for t in texts]
    with pytest.raises(ValueError, match="dictionary holds"):
        keep, phrases.MOST = phrases.MOST, 3
        try:
            phrases.converter(longer)
        finally:
            phrases.MOST = keep


def test_labels_that_hold_or_are_part_of_synonyms(spark):
    html = "".join(f"<th>{a}</th><td>{b}</td>" for a, b in (("Release date:", "2001"), ("Maker / studio", "M"), ("Len", "90"), ("", "x"), ("Other", "o"), ("title", "T"), ("the title", "late")))
    names = [("release date", "date"), ("studio", "maker"), ("length", "duration"), ("title", "title"), ("", "nothing"), ("zzz", "none")]
    table = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = {r.field: r.value for r in pages.labelled_rows(table, spark.createDataFrame(names, "label string, field string"), contains=True).collect()}
    assert got == {"date": "2001", "maker": "M", "duration": "90", "title": "T"}
    many = spark.range(100_000).select(F.concat(F.lit("synonym "), "id").alias("label"), F.lit("f").alias("field")).union(spark.createDataFrame(names, "label string, field string"))
    wide = pages.labelled_rows(table, many, contains=True)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert {r.field: r.value for r in wide.collect()} == got
