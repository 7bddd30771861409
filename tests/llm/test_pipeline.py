import re

import corpus_pipeline
from catalogkit.llm import langid, quality
from catalogkit.llm.common import fold

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.split("[ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).strip(" \t\n\v\f\r"))
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_stages_take_effect_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "packing"]
    names, current = docs.columns, docs
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = current
        current = stage(spark, before, SF)
        assert current.columns == names
        kept = {r.doc_id for r in current.select("doc_id").collect()}
        if name == "language_id":
            expected = {r.doc_id for r in langid.predict(before, model).where("NOT rejected").collect()}
        elif name == "quality":
            forest = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            expected = {r.doc_id for r in quality.predict(before, forest).where("predicted = 1").collect()}
        else:
            groups = {}
            sets = {r.doc_id: shingles(r.text) for r in before.collect()}
            for d in sorted(sets):  # the smallest id of each group of five-word shingle sets alike by 0.8 or more stays
                near = {groups[e] for e in groups if alike(sets[d], sets[e])}
                root = min([d, *near])
                groups |= {d: root} | {e: root for e, g in groups.items() if g in near}
            expected = set(groups.values())
        assert kept == expected
        current = spark.createDataFrame(current.collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, current, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in current.collect()}
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces)
