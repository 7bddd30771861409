import hashlib

import numpy as np
from pyspark.sql import functions as F

from catalogkit.llm import clustering

SF = "/root/testdata/sf0.01"


def brute(rows, clusters, rounds, steps=1024, seed=3):
    q = [[int(np.floor(steps * float(x))) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest())[:clusters]
    centroids = [q[i] for i in order]

    def assign():
        away = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids] for x in q]
        return [(d.index(min(d)), min(d)) for d in away]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [x for x, (k, _) in zip(q, found) if k == j]
            centroids[j] = [sum(col) // len(own) for col in zip(*own)] if own else centroids[j]
    found = assign()
    cost = [sum(d for k, d in found if k == j) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    top = 2**63 - 1
    return sorted((r[0], k, min(d, top), min(cost[k], top), min(sum(cost), top), names[k]) for r, (k, d) in zip(rows, found))


def answer(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("CLUSTER", F.lit(1)).repartition(3)
    return sorted(tuple(r) for r in clustering.cluster(df, **options).collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) + 3 * (i % 3)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third are copies
    for leading in (1, 3, 6):
        assert answer(spark, rows, dims=6, leading=leading, clusters=5, rounds=4) == brute(rows, 5, 4)


def test_ties_wide_and_far_components(spark):
    grid = [(i, [float(i % 4) / 1024, float(i // 4 % 4) / 1024, 0.0]) for i in range(64)]
    assert answer(spark, grid, dims=3, leading=2, clusters=4, rounds=3) == brute(grid, 4, 3)
    wide = [(i, [1e12 * (i % 3) + i, -1e10, 2.0**40]) for i in range(40)]
    assert answer(spark, wide, dims=3, leading=2, clusters=4, rounds=3) == brute(wide, 4, 3)
    mixed = grid + [(100 + i, x) for i, (_, x) in enumerate(wide)]
    assert answer(spark, mixed, dims=3, leading=1, clusters=6, rounds=3) == brute(mixed, 6, 3)
    far = [(1, [1e300, 0.0, 0.0]), (2, [-1e300, 0.0, 0.0]), (3, [0.0, 0.0, 0.0])]
    got = answer(spark, far, dims=3, leading=2, clusters=2, rounds=1)
    assert len(got) == 3 and got[0][4] == 2**63 - 1


def test_rows_that_take_no_part(spark):
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 0.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [5.0, 5.0])]
    got = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = clustering.cluster(got, dims=2, clusters=2, rounds=2).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 7, 7]
    assert answer(spark, [], dims=2) == []
    assert answer(spark, odd[:3], dims=64) == []


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(2)
    for scale in (1, 1e3, 1e7):
        x = (rng.normal(size=(500, 16)) * scale + 5 * scale).astype(np.int64)
        turn = clustering.rotation(x[:50], 4)
        lead, rest = turn.apply(x)
        low = clustering.bounds(lead.astype(np.float32).astype(float), rest, *turn.apply(x[:9]), float(turn.middle @ turn.middle))
        real = ((x[:, None].astype(object) - x[None, :9].astype(object)) ** 2).sum(axis=2).astype(float)
        assert (low <= real).all()


def test_filter_leaves_centroids_out():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(8, 64)) * 3000
    q = np.concatenate([middles[i % 8] + rng.normal(size=(50, 64)) * 300 for i in range(8)]).astype(np.int64)
    turn = clustering.rotation(q, 16)
    best, value, taken = clustering.nearest(q, *turn.apply(q), middles.astype(np.int64), turn)
    real = ((q[:, None] - middles.astype(np.int64)[None]) ** 2).sum(axis=2)
    assert (best == real.argmin(axis=1)).all() and (value == real.min(axis=1)).all()
    assert taken < 1.2 * len(q)


def test_registered_query_on_the_smallest_table(spark):
    from catalogkit.llm import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_pca_clustering(spark, "/root/testdata/sf0.001").collect()) == brute(rows, 8, 10)
