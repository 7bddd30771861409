import pytest
from pyspark.sql import functions as F

from catalogkit.sources.chain import Chain, Source, entity_items


def site(name, priority, withheld=()):
    rule = lambda: F.regexp_extract("html", "<b>(.*?)</b>", 1)
    return Source(name, priority, {"title": rule, "maker": rule}, withheld)


def test_chain_selects_by_priority_or_name():
    chain = Chain(site("b", 2), site("a", 1))
    assert [s.name for s in chain.select()] == ["a", "b"]
    assert [s.name for s in chain.select(["b"])] == ["b"]
    with pytest.raises(LookupError):
        chain.select(["c"])


def test_chain_observes_in_the_selected_order_and_withholds(spark):
    pages = spark.createDataFrame([(1, "https://s/1", "<b>one</b>"), (2, "https://s/2", None)], "page_id long, url string, html string")
    chain = Chain(site("a", 1), site("b", 2, ["maker"]))
    got = {(r.source, r.page_id): r for r in chain.observe({"a": pages, "b": pages}, ["b", "a"]).collect()}
    assert got["b", 1].title == got["a", 1].title == "one"
    assert got["b", 1].maker is None and got["a", 1].maker == "one"
    assert got["b", 1].priority == 0 and got["a", 1].priority == 1
    with pytest.raises(LookupError):
        chain.observe({}, ["a"])


def test_items_of_an_entity_as_owner_or_in_the_cast(spark):
    items = spark.createDataFrame([("1", "n", []), ("2", "m", ["n"]), ("3", "m", None)], "code string, owner string, cast array<string>")
    assert sorted(r.code for r in entity_items(items, "n").collect()) == ["1", "2"]
