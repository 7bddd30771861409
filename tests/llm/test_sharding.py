import zlib

import numpy as np
from pyspark.sql import functions as F

from catalogkit.llm import sharding

SCHEMA = "doc_id long, text string, key int, size int"


def check(rows, got, shards):
    assert len(got) == len(rows)
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for s in range(shards):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert 0 <= r.shard < shards


def test_hot_group_is_split_and_sizes_are_near(spark):
    rows = [(i, "hot text" * 10 if i % 3 == 0 else f"text {i} " * (1 + i % 9), 1, 2) for i in range(9000)] + [(9001, None, 1, 2), (9002, "", 1, 2)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 40).collect()
    check(rows, got, 40)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(40)]
    mean = sum(sizes) / 40
    assert max(abs(s - mean) for s in sizes) <= 0.005 * mean + 100  # and the largest row at a cut


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i % 3000} " * 5, 1, 2) for i in range(9000)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 10, tolerance=0.02).collect()
    shards_of = {}
    for r in got:
        shards_of.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards_of.values()) <= 2


def test_repeats_few_rows_and_none(spark, tmp_path):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "same", 1, 2)] * 7
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 7 and len({r.shard for r in got}) == 7
    docs = spark.createDataFrame([(i, f"t{i}", 1, 2) for i in range(50)], SCHEMA)
    sharding.write(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.agg(F.count_distinct("shard")).first()[0] == 4


def test_the_shards_do_not_depend_on_partitions(spark):
    rows = [(i % 700 if i % 5 else None, f"text {i % 200} " * (1 + i % 4), 1, 2) for i in range(2000)] + [(7, "twin", 1, 2)] * 400
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda n: sorted((r.doc_id or -1, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs.repartition(n)).collect())
    assert key(3) == key(7)


def test_splitters_equal_brute_force(spark):
    """Bytes below each boundary, as the sorted keys give them, are within the tolerance of their target."""
    rng = np.random.default_rng(1)
    keys, sizes = rng.integers(0, 1 << 62, 5000), rng.integers(16, 400, 5000)
    rows = spark.createDataFrame(list(zip(keys.tolist(), sizes.tolist())), "key long, size long")
    cut = sharding.splitters(rows, 40, 0.02)
    total = int(sizes.sum())
    assert len(cut) == 39 and cut == sorted(cut)
    for j, c in enumerate(cut):
        assert abs(int(sizes[keys < c].sum()) - total * (j + 1) / 40) <= 0.02 * total / 40 + 400


def test_written_shards_hold_the_same_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 90} " * (i % 7), 1, 2) for i in range(600)], SCHEMA).withColumn("shard", F.lit("own"))
    sharding.write(docs, str(tmp_path / "out"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*docs.columns, "shard_"]
    expected = {(r.doc_id, r.shard) for r in sharding.shard(docs, 4).collect()}
    assert {(r.doc_id, r["shard_"]) for r in back.collect()} == expected and back.count() == 600
    assert all(len(list(f.glob("*.parquet"))) <= 2 for f in (tmp_path / "out").glob("shard_=*"))


def test_pieces_do_not_change_the_result_and_rows_are_exchanged_once(spark):
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i} " * (1 + i % 9), 1, 2) for i in range(3000)] + [(9999, "twin", 1, 2)] * 300
    docs = spark.createDataFrame(rows, SCHEMA)
    small = sharding.shard(docs, 10, piece_rows=100)
    assert set(map(tuple, small.collect())) == set(map(tuple, sharding.shard(docs, 10).collect()))
    assert small._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
    assert small._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") == 1
    check(rows, small.collect(), 10)


def test_pieces_hold_few_rows(spark):
    keys = [5] * 40 + list(range(1000, 1100)) + [n << 40 for n in range(1, 3000)]
    rows = spark.createDataFrame([(k,) for k in keys], "key long")
    ends, starts = sharding.pieces(rows, np.array([1050, 9 << 45], np.int64), 50)
    assert {1050, 9 << 45} <= set(ends.tolist())
    assert starts.tolist() == [0, *(sum(k < e for k in keys) for e in ends.tolist())]
    assert np.diff([*starts.tolist(), len(keys)]).max() <= 50
