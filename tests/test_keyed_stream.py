import pytest

from catalogkit.streaming import keyed

FIELDS = ["title", "maker"]
SEEN = "code string, priority int, title string, maker string, extra string"


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(spark, path, n, rows):
    spark.createDataFrame(rows, SEEN).coalesce(1).write.mode("append").json(f"{path}/in")


def run(spark, path, catalogue):
    stream = spark.readStream.schema(SEEN).json(f"{path}/in")
    query = keyed.start(keyed.merge_stream(stream, catalogue, FIELDS), f"{path}/out", f"{path}/check")
    query.awaitTermination()
    return query


def test_batches_restart_and_late_observations(spark, tmp_path, store):
    path = str(tmp_path)
    catalogue = spark.createDataFrame([("a", "A", None), ("b", " n/a ", "M"), ("z", None, None), *[(f"k{i}", "K", "K") for i in range(200)]], "code string, title string, maker string")
    feed(spark, path, 0, [("a", 2, "beta", "beta", "x"), ("b", 3, "gamma", "gamma", "x"), ("new", 3, "gamma", None, "x"), (None, 1, "t", "m", "x"), ("z", 1, " ", "NULL", "x")])
    query = run(spark, path, catalogue)
    got = {r.code: tuple(r)[1:] for r in spark.read.parquet(f"{path}/out").select("code", *FIELDS, "changed").collect()}
    assert got == {"a": ("A", "beta", "maker"), "b": ("gamma", "M", "title"), "new": ("gamma", None, "title")}
    # a restart with a better, a worse and an equal observation; the catalogue is not read again
    feed(spark, path, 1, [("b", 1, "alpha", "alpha", "x"), ("a", 5, "late", "late", "x"), ("new", 3, "other", "other", "x"), ("a", 2, None, "again", "x")])
    query = run(spark, path, catalogue.limit(0))
    last = {r.code: tuple(r)[1:] for r in spark.read.parquet(f"{path}/out").where("batch = 1").select("code", *FIELDS, "changed").collect()}
    assert last == {"b": ("alpha", "M", "title"), "new": ("gamma", "other", "maker")}
    progress = query.lastProgress
    assert progress["stateOperators"][0]["numRowsUpdated"] <= 3
    assert all("parquet" not in s["description"].lower() for s in progress["sources"])
    now = {r.code: tuple(r)[1:] for r in keyed.current(catalogue, f"{path}/out", FIELDS).collect()}
    assert len(now) == 204 and now["a"] == ("A", "beta") and now["b"] == ("alpha", "M") and now["z"] == (None, None) and now["new"] == ("gamma", "other")


def test_order_of_arrival_does_not_matter(spark, tmp_path, store):
    rows = [("a", p, f"t{p}" if p != 1 else "", f"m{p}", "x") for p in (3, 1, 2)]
    catalogue = spark.createDataFrame([], "code string, title string, maker string")
    found = []
    for n, order in enumerate(([0, 1, 2], [2, 1, 0], [1, 0, 2])):
        path = f"{tmp_path}/{n}"
        for i in order:
            feed(spark, path, i, [rows[i]])
            run(spark, path, catalogue)
        found.append([tuple(r) for r in keyed.current(catalogue, f"{path}/out", FIELDS).collect()])
    assert found == [[("a", "t2", "m1")]] * 3
