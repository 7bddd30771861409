import random
import re

import numpy as np
import pytest
import xxhash

from catalogkit.llm import simhash


def naive_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "a b c", "A B c d", "a b c d e a b c d e", "É é\x0bx\x0cy z w", "x" * 10_000, "w " * 5_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(4)
    rng = random.Random(3)
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(int(m) & difference == 0 for m in masks)


@pytest.mark.parametrize("bucket_rows", [3, 4096])
def test_links_have_the_components_of_all_pairs(spark, bucket_rows):
    rng = random.Random(5)
    fps = {0}
    for _ in range(12):  # chains of steps of up to four bits, and strangers
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(classes, 4, bucket_rows)).collect()}
    expected = naive_components(fps, signed)
    assert {f: roots.get(f, f) for f in signed} == expected


def test_groups_with_nulls_repeats_and_extra_columns(spark):
    words = [f"w{i}" for i in range(120)]
    near = [*words[:60], "changed", *words[61:]]
    rows = [
        (5, " ".join(words), 1), (3, " ".join(words), 2), (9, " ".join(near), 3), (1, None, 4), (7, "", 5), (7, "", 5), (8, "quite another text of its own", 6), (None, "a lone text without id", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert len(got) == len(rows)
    fps = {d: naive_fingerprint(t) for d, t, _ in rows if d is not None}
    expected = naive_components(list(fps.values()), list(fps))
    for d, fp, component in got:
        if d >= 0:
            assert fp == f"{fps[d]:016x}" and component == expected[d]
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == [-1, *sorted(set(expected.values()))]


def test_one_row_of_each_component_stays(spark):
    long, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [
        (4, long, "b", None), (4, long, "a", None), (4, other, "a", 1), (4, other, "a", 1), (6, other, "z", 1), (None, long, "a", 1),
        (None, "only here", None, 1), (None, "only here", None, 1), (None, "only here", "q", 1), (2, "clean one", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark int")
    kept = sorted(((r.doc_id or -1), r.text) for r in simhash.keep_representatives(docs).collect())
    assert kept == sorted([(4, long), (4, other), (-1, "only here"), (2, "clean one")])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_representatives(docs).collect() == []
