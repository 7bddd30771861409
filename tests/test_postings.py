import itertools

import pytest

from catalogkit.operators import postings

ITEMS = [
    ("AB-1", "Red River", "Anna", "Makers", ["night", "Red"], ["夜", "赤"]), ("AB-2", None, "Bert", "", ["day", "night"], None), ("AB-3", "a", None, None, [], []),
    ("AB-4", "Ünder the Bridge", "", "under", None, ["x.y%z_"]), ("XY-9", "banana nana", "Anna", "aaa", ["night", "night"], []),
]
SCHEMA = "code string, title string, owner string, maker string, tags array<string>, tags_zh array<string>"
OWNERS = [("Anna", "アンナ"), ("Anna", "Hanna"), ("Bert", ""), ("Nobody", "River")]
CLUSTERS = [("Anna", "Anna"), ("Anna", "Ann the Great"), ("Bert", "Bertie")]
TAG_MAP = [("night", "Nacht"), ("day", "Tag"), ("Red", None)]
QUERIES = ["", " RED ", "an", "a", "アン", "ann the", "great", "nacht", "TAG", "赤", "x.y%", "%z_", "nana", "aaaa", "under", "ünder", "bertie", "river", "zzz", "ab-", "na n"]


def frames(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    return one(ITEMS, SCHEMA), one(OWNERS, "src string, dst string"), one(CLUSTERS, "canonical string, alias string"), one(TAG_MAP, "src string, dst string")


def expected(query):
    q = query.strip().lower()
    out = set()
    for code, title, owner, maker, tags, zh in ITEMS:
        values = [code, title, owner, maker, *(tags or []), *(zh or []), *(d for s, d in OWNERS if s == owner), *(a for c, a in CLUSTERS if c == owner), *(d for s, d in TAG_MAP if s in (tags or []))]
        if not q or any(q in v.lower() for v in values if v):
            out.add((query, code))
    return out


def test_search_equals_a_scan(spark):
    items, *others = frames(spark)
    got = postings.search_everywhere(items, QUERIES, *others).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == set(itertools.chain(*map(expected, QUERIES)))


def test_a_stored_index_reads_the_query_s_folders_only(spark, tmp_path):
    items, *others = frames(spark)
    postings.write(postings.build(postings.searched_values(items, *others)), str(tmp_path))
    stored = postings.load(spark, str(tmp_path))
    found = postings.search(stored, QUERIES, items)
    assert {tuple(r) for r in found.collect()} == set(itertools.chain(*map(expected, QUERIES)))
    one = postings.search(stored, ["nacht"])
    assert {r.code for r in one.collect()} == {"AB-1", "AB-2", "XY-9"}
    plan = one._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "grams" in line and "PartitionFilters" in line)
    assert "bucket" in scan.split("PartitionFilters:")[1].split("]")[0] and " IN (" in scan
    folders = {r.bucket for r in stored["grams"].where("gram IN ('nac', 'ach', 'cht')").select("bucket").distinct().collect()}
    assert len(folders) <= 3 < stored["grams"].select("bucket").distinct().count()


@pytest.mark.parametrize("empty", [0, 1])
def test_empty_tables(spark, empty):
    items, *others = (f.limit(0) for f in frames(spark)) if empty else frames(spark)
    assert postings.search_everywhere(items, ["night"], *others).count() == (0 if empty else 3)
    assert postings.search_everywhere(items, [], *others).collect() == []
