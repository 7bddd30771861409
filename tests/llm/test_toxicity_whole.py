"""The toxicity fit reads every labelled row outside fold 0, whole, in as many tasks as there are parts."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogkit.llm import toxicity
from catalogkit.llm.common import fold

PLAIN = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp"]


def tables(spark, n=5200, long=()):
    """Half the texts are toxic; the toxic ones with the largest id hashes, beyond 2,000, have a word of their own, and so have long ones."""
    hashes = {r.id: r.h for r in spark.range(n).select("id", F.xxhash64("id").alias("h")).collect()}
    toxic = sorted((i for i in range(n) if i % 2 == 0 and zlib.crc32(str(i).encode()) % 5), key=hashes.get)
    late, rng, rows = set(toxic[2000:]) or set(toxic[-40:]), np.random.default_rng(3), []
    for i in range(n):
        words = list(rng.choice(PLAIN, 12))
        if i % 2 == 0:
            words[i % 12] = "qzlate" if i in late or i % 10 == 0 and not zlib.crc32(str(i).encode()) % 5 else "vxearly"
        rows.append((i, " ".join(words) + " ".join(["", *PLAIN]) * (60 if i in long else 0), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(n)], "doc_id long, toxic int"), {r[0]: r[1] for r in rows}


def test_rows_beyond_any_sample_teach(spark):
    docs, labels, texts = tables(spark)
    assert sum("qzlate" in t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5) > 50
    got = [r for r in toxicity.classify(docs, labels, epochs=3).collect() if r.held_out]
    for word in ("qzlate", "vxearly"):
        assert np.mean([r.predicted for r in got if word in texts[r.doc_id]]) > 0.97
    assert np.mean([r.predicted for r in got if r.doc_id % 2]) < 0.02


def test_long_texts_all_teach(spark):
    docs, labels, texts = tables(spark, 600, long=range(0, 600, 3))
    assert sum(len(t) > 20_000 for t in texts.values()) == 200
    rows = toxicity.labelled(docs, labels).collect()
    assert {r.doc_id: (r.text, r.y) for r in rows} == {i: (t, 1 - i % 2) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5}


def test_counts_are_of_all_texts(spark):
    docs, labels, texts = tables(spark, 900)
    rows = docs.join(labels, "doc_id").where(fold("doc_id", 5) != 0).select("text", F.col("toxic").alias("y")).repartition(5)
    wanted = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5:
            wanted.update({(r, 1 - i % 2) for w in toxicity.words_of(t) for r in toxicity.rows_of(w, 997)})
    assert {(r.row, r.y): r.n for r in toxicity.counted(rows, 997).collect()} == dict(wanted)


def test_several_parts_learn_and_do_not_depend_on_the_tables_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 300)
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    docs, labels, texts = tables(spark, 1500)
    one, two = (toxicity.fit(d, labels, epochs=4) for d in (docs, docs.repartition(7)))
    known = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert one.score(known) == pytest.approx(two.score(known), abs=1e-4)
    s = one.score(known)
    assert np.mean([(x >= 0.5) == ("vxearly" in t or "qzlate" in t) for x, t in zip(s, known)]) > 0.98


def test_compact_and_packed_texts_keep_their_scores():
    net = toxicity.Network(buckets=97, dims=5, filters=3)
    net.start(1)
    rng = np.random.default_rng(2)
    rows = np.concatenate([np.zeros((1, 7), int), rng.integers(0, 97, (30, 7)) * (rng.random((30, 7)) < 0.5)]).astype(np.int32)
    products = net.table[rows].sum(axis=1) @ net.kernel
    texts = [np.where(rng.random(n) < 0.3, rng.integers(1, 31, n), 0).astype(np.int32) for n in (0, 1, 2, 3, 4, 5, 9, 40, 400) for _ in range(5)]
    assert sum(map(len, map(toxicity.compact, texts))) < sum(map(len, texts))
    whole = net.scores(texts, products)
    assert net.scores([toxicity.compact(t) for t in texts], products) == pytest.approx(whole, abs=1e-7)
    for t in texts:
        words, own = toxicity.unpacked(toxicity.packed(*toxicity.own_words(t, rows)))
        assert (own[words] == rows[t]).all() and not own[0].any()


def test_no_known_id_is_filtered(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    known = rows.where("doc_id % 7 = 0").select("doc_id")
    for most in (1 << 26, 1 << 10):
        assert known.subtract(toxicity.perhaps(rows, known, most).select("doc_id")).isEmpty()
    assert toxicity.perhaps(rows, known).count() < 1000
