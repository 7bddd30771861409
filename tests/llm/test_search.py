import numpy as np
import pytest

from catalogkit.llm import mtree, permutation, search

SCHEMA = "vec_id long, embedding array<float>, score int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            rest = sorted((-float(v @ q), j) for j, v in zip(ids, x) if j != i)
            out[i] = [(j, -s) for s, j in rest[:k]]
    return out


def test_mtree_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 12)).astype(np.float32) / 4
    x[100:160] = x[50]  # a group of equal vectors, larger than k
    x[3] *= 20
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5050, [], 0), (5100, [float("nan")] * 12, 0), (5150, [float("inf")] * 12, 0), (5200, [None, *x[0].tolist()[1:]], 0)]
    got = mtree.top_k(table(spark, rows), page_rows=200).collect()
    exact = brute(list(range(700)), np.floor(256 * x.astype(float)), 50, 5)
    for q, best in exact.items():
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == best
    assert len(got) == 5 * len(exact)


def test_tree_leaves_and_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    z = mtree.quantise(x)
    tree = mtree.grow([[i] for i in range(900)], z, leaf=16, fanout=4)
    assert sorted(i for own in tree.ids for i in own) == list(range(900))
    for n, (a, b) in enumerate(tree.span):
        assert np.sqrt(((tree.rows[a:b] - tree.pivot[n]) ** 2).sum(axis=1)).max() <= tree.radius[n] + 1e-9
    got, scored = mtree.best(tree, np.arange(0, 900, 50), z[::50], 5)
    exact = brute(range(900), z, 50, 5)
    assert (scored <= 900).all() and (scored > 0).all()
    assert {q: [(v, s) for i, v, s in got if i == q] for q in exact} == exact


def test_few_candidates_repeats_and_empty(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [1.0, 2.0, 3.0], 0)]
    assert [(r.query_id, r.vec_id) for r in mtree.top_k(table(spark, rows)).collect()] == [(0, 1)]
    assert [(r.query_id, r.vec_id, r.score) for r in permutation.neighbours(table(spark, rows)).collect()] == [(0, 1, 0.5)]
    assert mtree.top_k(table(spark, [])).collect() == [] == permutation.neighbours(table(spark, [])).collect()


def recall(got, exact):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == set(exact)
    return np.mean([len({v for v, _ in best} & found[q]) / len(best) for q, best in exact.items()])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_permutation_recall(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    pdf = docs.toPandas()
    x, ids = np.stack(pdf.embedding.tolist()).astype(float), pdf.vec_id.tolist()
    got, exact = permutation.neighbours(docs).collect(), brute(ids, x, 20, 20)
    assert recall(got, exact) >= 0.9
    where = {i: n for n, i in enumerate(ids)}
    assert [r.score for r in got] == pytest.approx([float(x[where[r.query_id]] @ x[where[r.vec_id]]) for r in got], abs=1e-12)
    for q in exact:
        own = sorted((r["rank"], -r.score, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, *_ in own] == list(range(1, 21)) and own == sorted(own, key=lambda r: r[1:])


def test_permutation_recall_with_one_long_vector(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    x[7] *= 1e8
    got = permutation.neighbours(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), page_rows=800).collect()
    assert recall(got, brute(range(2000), x, 20, 20)) >= 0.9


def clustered(rows, rng):
    centers = rng.normal(size=(24, 32))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    x = centers[rng.integers(0, 24, rows)] + rng.normal(size=(rows, 32)) * 0.03
    return x.astype(np.float32).astype(float)


def test_pages_and_rows_of_clustered_vectors_are_left_out(spark):
    x = clustered(4800, np.random.default_rng(8))
    data = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = mtree.top_k(data, page_rows=200).collect()
    exact = brute(range(4800), np.floor(256 * x), 50, 5)
    for q, best in exact.items():
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == best
    pages = np.mean([r.pages_visited for r in got]), np.mean([r.entries_scored for r in got])
    assert pages[0] <= 9 and pages[1] <= 0.25 * 4800  # of 24 pages or more
    near = permutation.neighbours(data, page_rows=200).collect()
    assert recall(near, brute(range(4800), x, 20, 20)) >= 0.9
    assert np.mean([r.pages_visited for r in near]) <= 9 and np.mean([r.entries_scored for r in near]) <= 0.1 * 4800


def test_bounds_hold_and_slices_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = clustered(900, rng) * rng.uniform(0.2, 3, (900, 1))
    for at in np.split(np.arange(900), 9):
        center = x[at].mean(axis=0)
        radius, top = np.sqrt(((x[at] - center) ** 2).sum(axis=1).max()), np.sqrt((x[at] ** 2).sum(axis=1).max())
        bound = search.bounds(x[::7], center[None], np.array([radius]), np.array([top]))
        assert (bound >= (x[::7] @ x[at].T).max(axis=1)[:, None]).all()
    data = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    key = lambda found: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    whole = key(mtree.top_k(data, page_rows=100))
    monkeypatch.setattr(search, "SLICE", 4)
    assert key(mtree.top_k(data, page_rows=100)) == whole


def test_large_vectors_are_scored_exactly(spark):
    rng = np.random.default_rng(10)
    big = [[3e30, 1.0, -2.0], [1e12, 1e12, 1.0], [2.0**40 + 1, 3.0, 0.25], [-(2.0**45), 0.5, 1.0]]
    rows = [(50 * i, v) for i, v in enumerate(big)] + [(2 * i + 1, (rng.normal(size=3) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(300)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in mtree.top_k(data, page_rows=60).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    for q in (i for i, _ in rows if i % 50 == 0):
        exact = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[i]))), i) for i, _ in rows if i != q)[:5]
        assert [(v, -s) for s, v in exact] == [(v, s) for _, v, s in sorted(got[q])]


def test_vectors_of_many_lengths(spark):
    rows = [(i, [1.0 + i % 3] * (1 + i // 4), 0) for i in range(600)]
    for found in (mtree.top_k(table(spark, rows), every=1, k=3, page_rows=50), permutation.neighbours(table(spark, rows), every=1, k=3, page_rows=50)):
        got = found.collect()
        assert len(got) == 600 * 3 and all(r.query_id // 4 == r.vec_id // 4 for r in got)


def test_permutation_recall_with_a_third_of_the_rows_equal(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    x[rng.permutation(6000)[:2000]] = x[0]
    found = permutation.neighbours(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), every=40, page_rows=2048)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    exact = {q: [v for v, _ in best] for q, best in brute(range(6000), x, 40, 20).items()}
    assert set(got) == set(exact)
    same = {q for q in exact if (x[q] == x[0]).all()}
    assert all([v for _, v in sorted(got[q])] == exact[q] for q in same)  # the smallest ids of the group
    others = [len(set(exact[q]) & {v for _, v in got[q]}) / 20 for q in exact if q not in same]
    assert np.mean(others) >= 0.9


def test_permutation_leaves_out_a_repeated_id_of_equal_vectors(spark):
    rows = [(0, [1.0, 0.0], 0)] * 30 + [(i, [1.0, 0.0], 0) for i in range(1, 8)] + [(8, [0.5, 0.0], 0)] * 3
    got = permutation.neighbours(table(spark, rows), k=6).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, i) for i in range(1, 7)]
    got = permutation.neighbours(table(spark, rows), k=9).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5, 6, 7, 8, 8]


def test_registered_defaults_page_and_prune_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(20, 32)) * 4
    vectors = np.concatenate([m + rng.normal(size=(100, 32)) * 0.3 for m in middles])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = np.floor(256 * vectors).astype(np.int64)
    got: dict = {}
    for r in mtree.top_k(df).collect():
        got.setdefault(r.query_id, []).append(r)
    assert len(got) == 40
    for q, rows in got.items():
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(2000), -scores)).tolist() if i != q][:5]
        assert [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(i, int(scores[i])) for i in order]
    pages = [rows[0].pages_visited for rows in got.values()]
    assert min(pages) < max(pages) and np.mean(pages) < 0.75 * max(pages)
    assert np.mean([rows[0].entries_scored for rows in got.values()]) < 0.5 * 2000
    near: dict = {}
    for r in permutation.neighbours(df).collect():
        near.setdefault(r.query_id, []).append(r)
    found = [len(set(np.argsort(-np.where(np.arange(2000) == q, -np.inf, vectors @ vectors[q]))[:20].tolist()) & {r.vec_id for r in rows}) / 20 for q, rows in near.items()]
    assert len(near) == 100 and np.mean(found) >= 0.95
    assert np.mean([rows[0].pages_visited for rows in near.values()]) < 0.9 * max(pages)


@pytest.mark.parametrize("sf, floor, worst", [("sf0.01", 0.95, 0.8), ("sf0.1", 0.97, 0.85)])
def test_recall_of_the_registered_defaults(spark, sf, floor, worst):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got: dict = {}
    for r in permutation.neighbours(df).collect():
        got.setdefault(r.query_id, []).append(r)
    found = []
    for at in np.flatnonzero(ids % 20 == 0):
        scores = np.where(ids == ids[at], -np.inf, v @ v[at])
        found.append(len(set(ids[np.lexsort((ids, -scores))[:20]].tolist()) & {r.vec_id for r in got[ids[at]]}) / 20)
    assert all(r.pages_visited > 1 for rows in got.values() for r in rows)
    assert np.mean(found) >= floor and min(found) >= worst
