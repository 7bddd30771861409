import pytest
from pyspark.sql import functions as F

from catalogkit.operators import audit, merge
from catalogkit.sources.generations import GONE, Catalogue, Conflict

SCHEMA = "code string, title string, tags array<string>"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows(df):
    return sorted((r.code, r.title, r.tags) for r in df.collect())


def test_generations_hold_changed_rows_only(spark, tmp_path):
    own = Catalogue(spark, str(tmp_path))
    assert own.read() is None and own.generations() == []
    first = [("a", "A", ["x"]), ("b", None, None), ("c", "C", [])]
    dry = own.commit(table(spark, *first))
    assert dry.generation is None and dry.rows.count() == 3 and own.read() is None
    assert own.commit(table(spark, *first), apply=True).generation == 0
    assert rows(own.read()) == first
    change = own.commit(table(spark, ("b", "B", None), ("c", "C", []), ("d", "D", ["y"])), apply=True)
    assert {r.code for r in change.rows.collect()} == {"b", "d"} and change.generation == 1
    assert rows(own.read()) == [("a", "A", ["x"]), ("b", "B", None), ("c", "C", []), ("d", "D", ["y"])]
    assert rows(own.read(0)) == first
    gone = own.commit(table(spark, ("a", "A", ["x"])), whole=True, apply=True)
    assert {(r.code, r[GONE]) for r in gone.rows.collect()} == {("b", True), ("c", True), ("d", True)}
    assert rows(own.read()) == [("a", "A", ["x"])]
    assert rows(own.commit(table(spark, ("d", "new", None)), apply=True).rows) == [("d", "new", None)]
    assert rows(own.read()) == [("a", "A", ["x"]), ("d", "new", None)]


def test_a_writer_that_fails_midway_leaves_the_catalogue_as_it_was(spark, tmp_path, monkeypatch):
    own = Catalogue(spark, str(tmp_path))
    own.commit(table(spark, ("a", "A", None)), apply=True)
    broken = table(spark, *[(f"k{i}", "B", None) for i in range(200)]).repartition(4)
    broken = broken.withColumn("title", F.when(F.col("code") == "k150", F.raise_error(F.lit("dead"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="dead"):
        own.commit(broken, apply=True)
    assert rows(own.read()) == [("a", "A", None)] and own.generations() == [0]
    monkeypatch.setattr(Catalogue, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost after the rows, before the log")))
    with pytest.raises(OSError):
        own.commit(table(spark, ("a", "Z", None)), apply=True)
    monkeypatch.undo()
    assert rows(own.read()) == [("a", "A", None)]
    assert len(own.vacuum()) >= 1 and rows(own.read()) == [("a", "A", None)]
    own.commit(table(spark, ("a", "Z", None)), apply=True)
    assert rows(own.read()) == [("a", "Z", None)]


def test_two_writers_and_repeated_keys(spark, tmp_path, monkeypatch):
    own, other = Catalogue(spark, str(tmp_path)), Catalogue(spark, str(tmp_path))
    own.commit(table(spark, ("a", "A", None)), apply=True)
    real = Catalogue.changes

    def slow(self, new, whole=False):
        out = real(self, new, whole)
        if self is own:
            other.commit(table(spark, ("b", "B", None)), apply=True)
        return out

    monkeypatch.setattr(Catalogue, "changes", slow)
    with pytest.raises(Conflict):
        own.commit(table(spark, ("c", "C", None)), apply=True)
    monkeypatch.undo()
    assert rows(own.read()) == [("a", "A", None), ("b", "B", None)]
    for wrong in ([("x", "1", None), ("x", "2", None)], [(None, "1", None)]):
        with pytest.raises(ValueError, match="missing or repeats"):
            own.commit(table(spark, *wrong), apply=True)
    assert rows(own.read()) == [("a", "A", None), ("b", "B", None)]


def test_many_commits_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("catalogkit.sources.generations.KEPT", 2)
    own = Catalogue(spark, str(tmp_path))
    for i in range(5):
        own.commit(table(spark, ("a", str(i), None), (f"k{i}", "x", None)), apply=True)
    assert len(own.writes(4)) <= 2 and rows(own.read())[0] == ("a", "4", None) and own.read().count() == 6


def test_mutators_run_dry_and_apply(spark, tmp_path):
    """Every mutator is a table in, a table out; ``commit`` shows or writes what it changes."""
    items = spark.createDataFrame([("a", None, "o", ["p"], "s"), ("b", "B", "o", ["o"], "s")], "code string, title string, owner string, cast array<string>, source string")
    fill = spark.createDataFrame([("a", "T", "beta")], "code string, title string, source string")
    mutators = {
        "fill_merge": lambda t: merge.fill_merge(t, fill, ["title"], merge.Roles()).select(t.columns),
        "fix_attribution": lambda t: audit.fix_attribution(t, []).select(t.columns),
    }
    for name, mutate in mutators.items():
        own = Catalogue(spark, f"{tmp_path}/{name}")
        own.commit(items, apply=True)
        before = sorted(map(str, own.read().collect()))
        dry = own.commit(mutate(own.read()))
        shown = sorted(map(str, dry.rows.collect()))
        assert [r for r in shown if "'a'" in r] and not [r for r in shown if "code='b'" in r]
        assert sorted(map(str, own.read().collect())) == before
        assert sorted(map(str, own.commit(mutate(own.read()), apply=True).rows.collect())) == shown
        assert own.commit(mutate(own.read())).rows.isEmpty()
