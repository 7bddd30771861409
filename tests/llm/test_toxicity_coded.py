"""Coded texts: what they hold, how many bytes they take, and that words are read as the pattern reads them."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogkit.llm import toxicity


def rows_of_texts(spark, n=1200, words=5000, length=200):
    rng = np.random.default_rng(5)
    names = [f"{a}{b}{i:04d}" for i, (a, b) in enumerate(zip(rng.choice(list("bcdfgklm"), words), rng.choice(list("aeiou"), words)))]
    texts = {i: " ".join(rng.choice(names, rng.integers(0, 2 * length))) for i in range(n)}
    rows = [(i, t, "en" if i % 3 else "de", i % 2, i % 10 == 0) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, y int, held boolean").repartition(5), texts


def test_coded_texts_take_less_than_their_texts(spark):
    """Where all words learn, a text whose words' rows were written with it took several times its own bytes."""
    rows, texts = rows_of_texts(spark)
    found = toxicity.coded(rows, 1 << 17, np.arange(1 << 17, dtype=np.int32), 2)
    assert found.agg(F.sum(F.length("words"))).first()[0] < 0.6 * sum(map(len, texts.values()))


@pytest.mark.parametrize("most", [300_000, 400])
def test_chunks_hold_all_texts_in_order(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "CHUNK", 128)
    monkeypatch.setattr(toxicity, "WORDS", most)
    rows, texts = rows_of_texts(spark, 700, 2000, 30)
    slots = np.where(np.arange(997) % 3 == 1, np.arange(997), 0).astype(np.int32)
    ords = {r.doc_id: (r.part, r.ord) for r in rows.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)).alias("part"), F.xxhash64("doc_id", F.lit(2)).alias("ord")).collect()}
    made, seen = toxicity.coded(rows, 997, slots, 3), defaultdict(list)
    for held in (True, False):
        batches = made.where(F.col("held") == held).select(toxicity.CODED).toArrow().to_batches()
        for part, own, table, labels, langs in toxicity.chunks(batches):
            assert len(own) == len(labels) == len(langs) <= 128 and not table[0].any()
            seen[part, held] += zip((table[t] for t in own), labels, langs)
    assert sum(map(len, seen.values())) == 700
    for (part, held), got in seen.items():
        ids = sorted((i for i in texts if ords[i][0] == part and (i % 10 == 0) == held), key=lambda i: ords[i][1])
        assert [(y, lang) for _, y, lang in got] == [(i % 2, "en" if i % 3 else "de") for i in ids]
        for (mine, _, _), i in zip(got, ids):
            words = texts[i].split()
            wanted = slots[toxicity.rows_of_words(words, 997)] if words else np.zeros((0, 7), int)
            numbers = np.where(wanted.any(axis=1), np.arange(1, len(words) + 1), 0)
            assert (mine == np.concatenate([np.zeros((1, 7), int), wanted])[toxicity.compact(numbers)]).all()


def test_words_are_runs_of_word_characters():
    rng = np.random.default_rng(1)
    signs = [*map(chr, range(0x250)), *"ΑαΣς“”…—  　你好ßİı١²½_\ud800\U0001f600"]
    for text in ["", *("".join(rng.choice(signs, n)) for n in (1, 2, 5, 50, 2000) for _ in range(20)), "".join(map(chr, range(0x11000)))]:
        assert toxicity.words_of(text) == re.findall(r"\w+", text.lower())
    assert toxicity.words_of(None) == []


def test_first_of_equal_maxima_and_pieces(monkeypatch):
    net = toxicity.Network(buckets=97, dims=5, filters=3)
    net.start(1)
    rng = np.random.default_rng(2)
    z = rng.integers(-3, 4, (9, 18)).astype(np.float32)
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 0, 2, 30, 3, 200, 0, 7)]
    flat, starts, inside = toxicity.joined(texts)
    values = net.responses(np.ascontiguousarray(z[flat].T))
    for piece in (1, 2, 3, 7, 64, 1 << 16):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        best, place = net.places(z, flat, starts)
        for i, (at, text) in enumerate(zip(starts, texts)):
            own = values[:, at : at + max(1, len(text))]
            assert (best[i] == own.max(axis=1)).all() and (place[i] == at + own.argmax(axis=1)).all()
