import pytest
from pyspark.sql import functions as F

from catalogkit.operators import audit, index, mapping, merge, names, rename, serving, tags

ITEMS = "code string, title string, date string, owner string, cast array<string>, tags array<string>, source string"


def items(spark, *rows):
    return spark.createDataFrame(rows, ITEMS)


BASE = ("A-1", "", None, "Ann", None, ["x"], None)


def test_fill_merge_fills_only_gaps_and_is_idempotent(spark):
    old = items(spark, BASE, ("A-2", "kept", "2001", "Bo", ["Bo"], [], "user"))
    new = items(spark, ("A-1", "new", "n/a", "Cy", ["Ann", "Dee"], ["x", "", "y"], "src"), ("A-2", "other", "2002", None, ["Eve"], ["z"], "src"))
    fields = ["title", "date", "owner", "cast", "tags", "source"]
    once = merge.fill_merge(old, new, fields)
    got = {r.code: r for r in once.collect()}
    assert (got["A-1"].title, got["A-1"].date, got["A-1"].owner, got["A-1"].cast, got["A-1"].tags, got["A-1"].source) == ("new", None, "Ann", ["Ann", "Dee"], ["x", "y"], "src")
    assert (got["A-2"].title, got["A-2"].date, got["A-2"].cast, got["A-2"].tags, got["A-2"].source) == ("kept", "2001", ["Bo"], ["z"], "user")
    assert got["A-1"].changed and got["A-2"].changed_keys == ["tags"]
    again = merge.fill_merge(once.drop("changed", "changed_keys"), new, fields)
    assert not again.where("changed").count()


@pytest.mark.parametrize(("guard", "cast"), [("strict", None), ("compat", ["Bo"])])
def test_single_foreign_name_is_guarded(spark, guard, cast):
    out = merge.fill_merge(items(spark, BASE), items(spark, ("A-1", "t", "d", None, ["Bo"], [], "s")), ["title", "cast"], guard=guard).first()
    assert (out.title, out.cast) == ("t", cast)


def test_chain_stops_only_after_a_change(spark):
    old = items(spark, ("A-1", "", None, None, None, None, None), ("A-2", "there", None, None, None, None, "user"))
    rows = [("A-1", "one", 1, None, None), ("A-1", "two", 2, "T", None), ("A-1", "three", 3, "U", "2003"), ("A-2", "one", 1, "x", None), ("A-2", "two", 2, "x", "2002"), ("A-2", "three", 3, "x", "2003")]
    seen = spark.createDataFrame(rows, "code string, source string, priority int, title string, date string")
    got = {r.code: r for r in merge.chain_fill(old, seen.drop("x"), ["title", "date"]).collect()}
    assert (got["A-1"].title, got["A-1"].date, got["A-1"].filled_from) == ("T", None, ["two"])
    assert (got["A-2"].title, got["A-2"].date, got["A-2"].filled_from) == ("there", "2002", ["two"])
    all_of = {r.code: r for r in merge.chain_fill(old, seen, ["title", "date"], ["title", "date"]).collect()}
    assert all_of["A-1"].filled_from == ["two", "three"] and all_of["A-1"].date == "2003"


def test_mapping_shares(spark):
    votes = [("a", "x")] * 3 + [("b", "x")] * 4 + [("b", "y")] + [("c", "x")] * 3 + [("c", "y")]
    learned = {r.src: (r.dst, r.status) for r in mapping.learn_mapping(spark.createDataFrame(votes, "src_value string, dst_value string")).collect()}
    assert learned == {"a": ("x", "accepted"), "b": ("x", "accepted"), "c": ("x", "ambiguous")}
    local = spark.createDataFrame([("ABC-1", "ABC"), ("ABC-2", "Real")], "code string, series string")
    seen = spark.createDataFrame([("ABC-1", "s  t"), ("ABC-2", " s t ")], "code string, series_en string")
    assert [tuple(r) for r in mapping.labelled_pairs(local, seen, "series_en", "series", skip_prefix=True).collect()] == [("ABC-2", "Real", "s t")]


def test_backfill_events(spark):
    rows = spark.createDataFrame([("ABC-1", "ABC", 0, None), ("ABC-2", "Real", 5, "M"), ("ABC-3", None, None, None)], "code string, series string, duration int, maker string")
    seen = spark.createDataFrame([("ABC-1", 90, "en"), ("ABC-2", 80, "en")], "code string, duration int, maker string")
    known = spark.createDataFrame([("en", "local", "accepted")], "src string, dst string, status string")
    got = {r.code: r for r in mapping.backfill(rows, seen, {"maker": ("maker", known)}, ["duration"]).collect()}
    assert (got["ABC-1"].series, got["ABC-1"].duration, got["ABC-1"].maker) == (None, 90, "local")
    assert got["ABC-1"].events == ["clear_series_prefix", "fill_duration", "fill_maker"] and got["ABC-2"].events == [] and got["ABC-3"].events == ["no_hit"]


def test_templates_and_candidates(spark):
    rows = spark.createDataFrame([("ABC-12", "https://h/v/x/7abc00012/7abc00012pl.jpg"), ("ABC-13", "https://h/v/x/7abc00013/zps.jpg?q"), ("ABC-14", "https://h/v/x/7abc00014/7abc00014pl.jpg"), ("ABC-15", ""), ("XY-1", None)], "code string, cover string")
    learned = mapping.learn_template(rows, "cover", "code")
    assert [tuple(r) for r in learned.collect()] == [("ABC", "7", 5, "v/x", "pl", 2)]
    made = mapping.url_candidates(rows.where("code IN ('ABC-15', 'XY-1')"), learned, "code", "https://h/", [("g", "pl", "", 3), ("g", "ps", "1", 3)])
    assert [(r.code, r.pos, r.url) for r in made.orderBy("code", "pos").collect()] == [
        ("ABC-15", 0, "https://h/v/x/7abc00015/7abc00015pl.jpg"), ("ABC-15", 1, "https://h/v/x/7abc015/7abc015pl.jpg"), ("XY-1", 0, "https://h/g/xy001/xy001pl.jpg"), ("XY-1", 1, "https://h/g/1xy001/1xy001ps.jpg"),
    ]
    known = spark.createDataFrame([("https://h/g/1xy001/1xy001ps.jpg",)], "url string")
    assert [tuple(r) for r in mapping.first_available(made, known).collect()] == [("XY-1", "https://h/g/1xy001/1xy001ps.jpg", "guess")]


def test_clusters_reach_one_hop(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "B"), ("D", "E")], "canonical string, alias string")
    clusters = names.alias_clusters(edges, spark.createDataFrame([("B",)], "name string"))
    assert {r.alias for r in clusters.collect()} == {"A", "B", "C", "D", "E"}
    two = names.alias_clusters(edges, spark.createDataFrame([("A",), ("D",)], "name string"))
    assert {(r.alias, tuple(r.owners)) for r in names.alias_collisions(two).collect()} == {("B", ("A", "D"))}
    owned = spark.createDataFrame([(1, "E"), (2, "B"), (3, "A"), (4, "Q")], "k int, owner string")
    assert {r.k: r.owner for r in names.canonicalise_owner(owned, two).collect()} == {1: "D", 2: "B", 3: "A", 4: "Q"}


def test_exact_hits_and_probing(spark):
    hits = spark.createDataFrame([("abc1", "ABC-1", "t"), ("abc1", "ABC-2", "u"), ("x9", "X-9", "a"), ("x9", "X_9", "b")], "code string, found_code string, target string")
    assert [tuple(r) for r in names.pick_exact(hits).collect()] == [("abc1", "t")]
    people = spark.createDataFrame([("n", ["q", "r", "s"])], "name string, c array<string>")
    assert names.probe_candidates(people, "c", spark.createDataFrame([("s",), ("r",)], "name string")).first().hit == "r"


def test_dictionary_values(spark):
    rows = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f")], "name string, plain string")
    words = spark.createDataFrame([("a", "A"), ("d", "D"), ("c", ""), ("b", "B")], "src string, dst string")
    assert [r.o for r in names.attach_value(rows, words, "name", "o").orderBy("name").collect()] == ["A", None, None]
    assert [r.o for r in names.look_up_name(rows, words.where("dst <> ''"), "name", "plain", "o").orderBy("name").collect()] == ["A", "D", None]


def test_tags_with_blanks(spark):
    table = spark.createDataFrame([("a", "A"), ("b", ""), ("c", "A")], "src string, dst string")
    rows = spark.createDataFrame([(1, ["a", "", "b", "q", "c"]), (2, []), (3, None)], "k int, tags array<string>")
    aligned = {r.k: r.tags_zh for r in tags.translate_aligned(rows, "tags", table).collect()}
    assert aligned == {1: ["A", "", "b", "q", "A"], 2: [], 3: []}
    assert {r.k: r.tags_norm for r in tags.normalize_tags(rows, "tags", table).collect()} == {1: ["A", "q"], 2: [], 3: []}


def test_dictionary_ladder(spark):
    schema = "source string, file_ord int, row_ord int, id string, url string, ja string, zh_cn string, zh_tw string, en string, translate string, note string"
    rows = [("two", 1, 0, "9", "u2", "k", "cn2", "", "en2", "", "n2"), ("one", 0, 0, "", "", "k", "", "かな", "", "", "n1"), ("translate", 2, 0, "3", "", "", "", "", "", "漢", "n1"), ("one", 0, 1, "5", "", "", "", "", "e", "", "")]
    got = {r.key: r for r in tags.merge_dictionary(spark.createDataFrame(rows, schema), ["one", "two"]).collect()}
    assert set(got) == {"k", "漢", "e"}
    assert (got["k"].id, got["k"].url, got["k"].zh_cn, got["k"].zh_tw, got["k"].en, got["k"].note, got["k"].source) == ("", "", "cn2", "かな", "en2", "n1 / n2", "one;two")
    assert got["漢"].zh_cn == "漢" and got["e"].zh_cn == "e"


def test_snapshot_classes(spark):
    old = items(spark, ("same", "t", "d", "A", ["A"], [], "s"), ("moved", "t", "d", "A", ["A"], [], "s"), ("cast", "t", "d", "A", None, [], "s"), ("field", "", "d", "A", ["A"], [], "s"), ("gone", "t", "d", "A", [], [], "s"), ("both", "", "d", "A", ["A"], [], "s"))
    new = items(spark, ("same", "t", "d", "A", ["A"], [], "s"), ("moved", "t", "d", "B", ["A"], [], "s"), ("cast", "t", "d", "A", ["Z"], [], "s"), ("field", "new", "d", "A", ["A"], [], "s"), ("born", "t", "d", "A", [], [], "s"), ("both", "n", "d", "B", ["A"], [], "s"))
    got = {r.code: r["class"] for r in audit.sweep_snapshots(old, new).collect()}
    assert got == {"moved": "noise", "cast": "cast_reverted", "field": "kept", "gone": "error", "born": "error", "both": "attrib_restored"}


def test_fix_attribution_outcomes(spark):
    rows = items(spark, ("ok", "", "", "A (x)", ["A"], [], "s"), ("one", "", "", "A", ["B"], [], "pending"), ("safe", "", "", "A", ["B"], [], "hand"), ("many", "", "", "A", ["B", "C"], [], "s"), ("none", "", "", None, ["B"], [], "s"))
    got = {r.code: (r.outcome, r.owner, r.source) for r in audit.fix_attribution(rows, ["hand"]).collect()}
    assert got == {"ok": ("ok", "A (x)", "s"), "one": ("fixed", "B", "attribution_fix"), "safe": ("protected", "A", "hand"), "many": ("flagged", "A", "s"), "none": ("ok", None, "s")}
    forced = {r.code: r.source for r in audit.fix_attribution(rows, ["hand"], force=True).collect()}
    assert forced["safe"] == "user_correction"


def test_audits(spark):
    rows = spark.createDataFrame([("a", "t", "c", "2001", "o"), ("b", "", None, " ", None)], "code string, title string, cover string, date string, owner string")
    flagged = audit.annotate_completeness(rows)
    assert {r.code: r.missing_fields for r in flagged.collect()} == {"a": [], "b": ["title", "cover", "owner"]}
    with pytest.raises(ValueError):
        audit.assert_complete(rows)
    assert [tuple(r) for r in audit.field_coverage(rows.limit(0), ["title"]).collect()] == [("title", 0, 0, 0)]
    assert {r.field: r.pct for r in audit.field_coverage(rows, ["title", "date"]).collect()} == {"title": 50, "date": 100}
    assert [tuple(r) for r in audit.field_report(rows, " A ", ["title", "cover"]).collect()] == [("title", True, "t", "ok"), ("cover", True, "c", "ok")]
    stored = spark.createDataFrame([("a.json",), ("z.json",)], "file_name string")
    assert [r.file_name for r in audit.reconcile(stored, rows).collect()] == ["z.json"]
    assert audit.validate_index(spark.createDataFrame([("",)], "name string"), rows).first().kind == "entity_without_name"


def test_index_counts_and_nesting(spark):
    rows = items(spark, ("b", "t", "2002", "O", None, [], "s"), ("a", "t", "2001", "O", None, [], "s"), ("c", "t", "", None, ["P"], [], "s"), ("d", "t", None, "", None, [], "s"))
    flat = index.group_index(rows)
    assert {r.owner: (r.work_count, r.codes) for r in flat.collect()} == {"O": (2, ["a", "b"]), "P": (1, ["c"]), "other": (1, ["d"])}
    assert flat.agg(F.sum("work_count")).first()[0] == rows.count()
    nested = index.group_index(rows, nested=True, cap=1)
    assert {r.owner: [w.code for w in r.works] for r in nested.collect()} == {"O": ["a"], "P": ["c"], "other": ["d"]}
    assert index.flatten_index(index.group_index(rows, nested=True)).count() == 4
    assert {r.owner: r.work_count for r in index.entity_stats(rows, dated_only=True).collect()} == {"O": 2}


def test_file_names(spark):
    named = ["2020-01-02 ABC-012 Title_4K60fps.part2.mp4", "abc00186hhb.mp4", "ABC-012 Shot in 4K story.mp4", "ABC-012 (1).mp4", "ABC-012_2.jpg", "notes.txt", "ABC-1_4Ks.mkv"]
    files = spark.createDataFrame([("p", str(i), n) for i, n in enumerate(named)], "parent string, fid string, fn string")
    got = {r.fid: r for r in rename.parse_files(files).collect()}
    one = got["0"]
    assert (one.file_date, one.code, one.part, one.tags, one.body, one.ext) == ("2020-01-02", "ABC-012", 2, ["[4K][60fps]"], "Title", ".mp4")
    assert (got["1"].code, got["2"].body, got["2"].tags, got["3"].copy, got["4"].copy) == ("ABC-186HHB", "Shot in 4K story", [], 1, 2)
    assert got["5"].code is None and got["6"].tags == ["[4K]"]
    known = spark.createDataFrame([("ABC-012", "Known: title", "2001-01-01")], "code string, title string, date string")
    plan = rename.plan_renames(files, known, skip_codes=["abc-1"])
    new = {r.fid: r for r in plan.collect()}
    assert new["3"].new == "2001-01-01 ABC-012 Known_ title (1).mp4" and new["3"].src_title == "source"
    assert new["5"].reason == "unparsable" and new["6"].reason == "listed" and new["1"].issues == ["missing_title", "missing_date"]
    twice = plan.unionByName(plan)
    assert rename.collisions(twice).count() == 5


@pytest.mark.parametrize(("given", "wanted"), [("2020-01-02 AB-1·N.x[4K].mp4", "2020-01-02 AB-1[4K].mp4"), ("AB-1 N.x.mp4", "AB-1.mp4"), ("AB-1 title N.x.mp4", "AB-1 title N.x.mp4")])
def test_added_names_are_stripped(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "fn string").select(rename.strip_suffix(F.col("fn"), "N.x")).first()[0] == wanted


def test_serving(spark):
    rows = spark.createDataFrame(
        [("a", "Red One", "Ann", ["x"], "M", "L", "2002-01-01", 0.0), ("b", None, "Bo", ["Y"], "L", None, "", 3.0), ("c", "two", None, None, None, "M", None, None)],
        "code string, title string, owner string, tags array<string>, maker string, label string, date string, rating double",
    )
    found = serving.add_search_blob(rows, ["code", "title", "owner", "maker"], ["tags"])
    assert [r.code for r in serving.search(found, " RED ").collect()] == ["a"] and serving.search(found, " ").count() == 3
    assert {r.code for r in serving.facet_filter(rows, "maker", "M").collect()} == {"a", "c"}
    assert [r.code for r in serving.combined_filter(rows, tag="y", maker=" l ").collect()] == ["b"]
    assert [(r.value, r.n) for r in serving.facet_browse(rows, "maker").collect()] == [("L", 2), ("M", 2)]
    assert [r.key for r in serving.group_by_field(rows, serving.year_of()).collect()] == ["2002", None]
    assert [r.code for r in serving.sort_items(rows, "rating").collect()] == ["b", "a", "c"] and [r.code for r in serving.sort_items(rows, "date_desc").collect()] == ["a", "b", "c"]
    assert serving.stats_overview(rows).first().rated == 1
    assert serving.head_and_rest(rows, ["code"], 2).first().omitted == 1
