import hashlib
import json
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from catalogkit.llm import bpe, packing, tokens
from catalogkit.llm.tokens import EOS, WordTokenizer, ranks_of

RANKS = ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.text(alphabet=st.sampled_from("abces'tl \n\t.,!é漢ü1２ 的　\x1c\x85²_"), max_size=200)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(2, 40), st.sampled_from([8, 32, 4096]))
def test_tree_equals_the_library(text, leaf, search):
    old, bpe.SEARCH = bpe.SEARCH, search
    try:
        codec = bpe.TreeCodec(RANKS, leaf)
        ids = codec.encode(text)
    finally:
        bpe.SEARCH = old
    assert ids == PLAIN.encode_ordinary(text)
    assert codec.decode(ids, leaf=3) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "ab", "'", "'s", "7", "!", " ", "\n", "é", "的", "x1", "re"]), st.integers(1, 90)), max_size=8))
def test_tree_over_runs_equals_the_library(parts):
    text = "".join(p * n for p, n in parts)
    codec = bpe.TreeCodec(RANKS, leaf=16)
    assert codec.encode(text) == PLAIN.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", "x", "Z", "7", "!", "é", "的", "ab1", "'", "'s", "word", "\n", " "])
@pytest.mark.parametrize("length", [16_385, 30_011, 200_001])
def test_long_runs_end_soon(unit, length):
    text = (unit * length)[:length]
    codec = bpe.TreeCodec.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    began = time.process_time()
    ids = codec.encode(text)
    assert time.process_time() - began < 5
    assert ids == PLAIN.encode_ordinary(text) and codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", [" " * 1_000_000, " " * 1_000_000 + "x", "\n  x" * 50_000])
def test_white_space_takes_linear_time(text):
    codec = bpe.TreeCodec.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    began = time.process_time()
    ids, same = codec.encode(text), codec.encoder.encode(text)
    packed = WordTokenizer.load(FILE).encode(text)
    assert time.process_time() - began < 8
    assert ids == same and codec.decode(ids) == text.encode() and len(packed) > 0
    parts = [text[:7], *(text[i : i + 5] for i in range(7, 60, 5))]  # the library itself overflows on the whole text
    assert all(codec.encode(p) == PLAIN.encode_ordinary(p) for p in parts)


def test_pairs_are_judged_as_the_library_merges():
    codec = bpe.TreeCodec.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rng = np.random.default_rng(3)
    spelled = [t for t in RANKS if t.isalpha() and len(t) < 9]
    for a, b in rng.choice(len(spelled), (400, 2)).tolist():
        x, y = spelled[a], spelled[b]
        assert codec._pair(RANKS[x], RANKS[y]) == (PLAIN.encode_ordinary((x + y).decode()) == [RANKS[x], RANKS[y]])


def test_encoding_of_nothing(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    none = spark.createDataFrame([], "doc_id long, text string, ids int")
    assert bpe.digests(none, path).collect() == bpe.encode(none, path).collect() == bpe.decode(bpe.encode(none, path), path).collect() == []


def test_only_an_equal_file_takes_the_fast_path():
    with open(FILE) as f:
        own = json.load(f)
    ranks = ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert tokens.same_as_ranks(own, ranks)
    assert not tokens.same_as_ranks(own, RANKS)  # as many entries
    assert not tokens.same_as_ranks(own | {"normalizer": {"type": "Lowercase"}}, ranks)
    assert not tokens.same_as_ranks(own | {"pre_tokenizer": own["pre_tokenizer"] | {"add_prefix_space": True}}, ranks)
    assert not tokens.same_as_ranks(own | {"model": own["model"] | {"merges": own["model"]["merges"][::-1]}}, ranks)


def test_digests_with_nulls(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (3, ""), (None, "<|endoftext|>")]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()
    assert len(got) == 5
    for r, (d, t) in zip(got, rows):
        ids = PLAIN.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens) == (d, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    raw = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path), path).collect()
    assert [bytes(r.raw).decode() for r in raw] == [t or "" for _, t in rows]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_fast_path_equals_the_tokenizer_file(text):
    t = WordTokenizer.load(FILE)
    assert t.ranks is not None
    assert t.encode(text) == t.library.encode(text, add_special_tokens=False).ids


def pieces_are_whole(pieces, rows, length=2048):
    t = WordTokenizer.load(FILE)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for d, text in rows:
        ids = t.library.encode(text or "", add_special_tokens=False).ids + [EOS]
        at = 0
        for p in sorted(by_doc.pop(d), key=lambda p: p.start):
            own = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(own))
            at += p.length
        assert at == len(ids)
    assert not by_doc
    sizes = {}
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == length or n & (n - 1) == 0 for n in sizes.values())
    assert sum(n < length for n in sizes.values()) <= length.bit_length()


def test_packing_is_whole(spark):
    rows = [(i, f"src{i % 3}" if i % 5 else None, "word " * (i * 7 % 900) if i % 11 else None) for i in range(120)] + [(999, "rare", "x " * 20_000), (1000, "", "<|endoftext|> is text here")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS row", "2 AS n", "3 AS block")
    pieces = packing.pack(docs, FILE, window_tokens=4096).collect()
    pieces_are_whole(pieces, [(d, t) for d, _, t in rows])


def test_packing_of_nothing_and_of_repeats(spark):
    schema = "doc_id long, source string, text string"
    assert packing.pack(spark.createDataFrame([], schema), FILE).collect() == []
    twice = packing.pack(spark.createDataFrame([(1, "a", "same text"), (1, "a", "same text")], schema), FILE).collect()
    assert sum(p.length for p in twice) == 2 * twice[0].doc_tokens


def test_windows_hold_the_target_mixture(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.col("id").alias("row"), F.xxhash64("id").alias("place"), F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("source"), F.lit(100).cast("long").alias("n"))
    placed = packing.schedule(docs, window_tokens=8192).join(docs.select("row", "source"), "row").collect()
    assert sorted(p.start for p in placed) == [100 * i for i in range(4000)]
    for lo in range(0, 360_000, 40_000):
        own = [p.source for p in placed if lo <= p.start < lo + 40_000]
        assert abs(own.count("small") / len(own) - 0.25) < 0.03
    forced = packing.schedule(docs, window_tokens=8192, shares={"small": 0.5, "large": 0.5}).join(docs.select("row", "source"), "row").collect()
    own = [p.source for p in forced if p.start < 160_000]
    assert abs(own.count("small") / len(own) - 0.5) < 0.05


def test_a_source_that_runs_dry_leaves_full_sequences(spark):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.col("id").alias("row"), F.xxhash64("id").alias("place"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"), F.lit(100).cast("long").alias("n"))
    placed = packing.schedule(docs, window_tokens=8192, shares={"small": 0.5, "large": 0.5}).join(docs.select("row", "source"), "row").collect()
    assert sorted(p.start for p in placed) == [100 * i for i in range(3000)]
    small = sorted(p.start for p in placed if p.source == "small")
    assert small[-1] < 100_000  # spent by twice its tokens and some windows


def test_the_stream_does_not_depend_on_partitions(spark):
    rows = [(i, f"s{i % 3}", "word " * (1 + i * 7 % 90)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    key = lambda found: sorted((p.doc_id, p.start, p.sequence_id, p.offset) for p in found.collect())
    assert key(packing.pack(docs.repartition(2), FILE)) == key(packing.pack(docs.repartition(7), FILE))


def test_very_long_texts_are_packed(spark):
    rows = [(1, "a", " " * 300_000), (2, None, "a" * 100_001), (3, "b", "x\n\n y " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    pieces_are_whole(packing.pack(docs, FILE).collect(), [(d, t) for d, _, t in rows])
