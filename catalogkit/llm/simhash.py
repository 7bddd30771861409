"""Near-duplicate grouping: 64-bit SimHash fingerprints joined by covering locality-sensitive hashing.

Fingerprints.  Each text is lower-cased (A-Z only), cut into words and into shingles of consecutive
words; every shingle, repeats included, votes with its XXH64 bits and a fingerprint bit is set when
more than half of the shingles set it.

Covering.  Bit i of a fingerprint gets a vector phi(i) of F_2^(r+1).  Table v (every nonzero vector)
keeps the bits with <phi(i), v> = 1.  Any r differing bits span at most r dimensions, so some nonzero v
is orthogonal to all of their vectors: in that table none of them is kept and the two fingerprints
have the same key.  2^(r+1) - 1 tables thus find *every* pair within radius r.

Scale.  Equal fingerprints form one class before any table is built.  A bucket is streamed in sorted
order; its links are reduced to a spanning forest at once, so nothing quadratic leaves a task.  Buckets
of more than ``bucket_rows`` classes are compared in blocks of that size by many tasks.  Joins on
fingerprints, components and hubs broadcast the few keys that hold more than a thousandth of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructField

from catalogkit.llm.common import attach, fresh, settle

SEED = 42
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """SimHash of one text as an unsigned integer; null texts and texts without words give 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[shingle_words - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(sum(1 << i for i, n in enumerate(bits.tolist()) if 2 * n > len(hashes)))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 4, mark: Column | None = None) -> DataFrame:
    """(doc_id, fp long, mark long): one row per row of ``docs``; fp holds the 64 bits as a signed long,
    and ``mark`` is carried along (null by default)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "mark"])

    tag = F.lit(None).cast("long") if mark is None else mark
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), tag.alias("mark"))
    return chosen.mapInArrow(run, "doc_id long, fp long, mark long")


def covering_masks(radius: int, bits: int = 64) -> np.ndarray:
    """2^(radius+1) - 1 masks of which, for any ``radius`` bits, one keeps none of them."""
    width = radius + 1
    phi = np.random.default_rng(7).permutation(np.arange(bits) % ((1 << width) - 1) + 1)
    return np.array(
        [sum(1 << i for i in range(bits) if bin(int(phi[i]) & v).count("1") % 2) for v in range(1, 1 << width)], np.uint64
    )


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the pairs of a x b (unsigned fingerprints) within ``radius``."""
    values = np.unique(np.concatenate([a, b]))
    label = np.arange(len(values))
    left, right = [], []
    place = np.searchsorted(values, b)
    for i, x in zip(np.searchsorted(values, a).tolist(), a):
        near = place[np.bitwise_count(b ^ x) <= radius]
        other, first = np.unique(label[near], return_index=True)
        new = other != label[i]
        if new.any():
            ends = near[first[new]]
            left += [int(values[i].view(np.int64))] * len(ends)
            right += values[ends].view(np.int64).tolist()
            label[np.isin(label, other[new])] = label[i]
    return left, right


def links(classes: DataFrame, radius: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """Distinct edges (a, b) over the distinct ``fp`` of ``classes`` with the same connected components
    as the graph of all pairs within ``radius``."""
    masks = covering_masks(radius)
    table = F.array(*[
        F.struct(F.lit(k).alias("m"), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("key"))
        for k, m in enumerate(masks)
    ])
    buckets = classes.select("fp", F.explode(table).alias("t")).select("t.m", "t.key", "fp")
    large = settle(buckets.groupBy("m", "key").count().where(F.col("count") > bucket_rows))
    some = not large.isEmpty()
    few = buckets.join(large, ["m", "key"], "left_anti") if some else buckets

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges (a, b) of each bucket, from rows in the order of their buckets."""
        m0, key0, run = None, None, []

        def close() -> tuple[list[int], list[int]]:
            fps = np.unique(np.concatenate(run)).view(np.uint64)
            return _forest(fps, fps, radius) if len(fps) > 1 else ([], [])

        for batch in batches:
            m, k, f = (np.asarray(batch.column(i)) for i in range(3))
            if not len(m):
                continue
            cut = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(m)]])
            sizes = ends - starts
            sizes[[0, -1]] = 0  # the outer runs may go on in the batches beside this one
            two = starts[sizes == 2]
            two = two[np.bitwise_count((f[two] ^ f[two + 1]).view(np.uint64)) <= radius]
            left, right = f[two].tolist(), f[two + 1].tolist()
            busy = (sizes == 0) | (sizes > 2)
            for s, e in zip(starts[busy].tolist(), ends[busy].tolist()):
                if (m[s], k[s]) != (m0, key0):
                    if sum(map(len, run)) > 1:
                        x, y = close()
                        left += x
                        right += y
                    m0, key0, run = m[s], k[s], []
                run.append(f[s:e])
            run = [x.copy() for x in run]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        if sum(map(len, run)) > 1:
            left, right = close()
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    near = settle(few.repartition("m", "key").sortWithinPartitions("m", "key").mapInArrow(stream, "a long, b long"))
    if not some:
        return near.distinct()
    blocks = buckets.join(large, ["m", "key"]).withColumn("n", F.ceil(F.col("count") / bucket_rows).cast("int"))
    blocks = blocks.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = blocks.select(
        "m", "key", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j")
    ).select("m", "key", "fp", "i", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        fps = frame.fp.to_numpy().view(np.uint64)
        lo, hi = fps[(frame.i == frame.lo).to_numpy()], fps[(frame.i == frame.hi).to_numpy()]
        left, right = _forest(lo, hi, radius)
        return pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})

    return near.union(pairs.groupBy("m", "key", "lo", "hi").applyInPandas(compare, "a long, b long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds on plain joins and minimum aggregations; each round is
    checkpointed, and the edges shrink to stars in a number of rounds logarithmic in the longest path.
    """

    def large_star(current: DataFrame, edges: int) -> DataFrame:
        both = current.select(F.col("x").alias("u"), F.col("m").alias("v")).union(current.select(F.col("m").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        return attach(both, least, "u", 2 * edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small_star(pairs: DataFrame) -> DataFrame:
        # after a large star every edge leads to a smaller node, and few edges leave a node
        joined = pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("x"), "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e"))
        return out.select("e.x", "e.m").where("x <> m").distinct()

    current = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("m")).distinct())
    checks = [F.count("*"), F.sum(F.xxhash64("x", "m").cast("decimal(38,0)"))]
    seen = current.agg(*checks).first()
    while True:
        current = settle(small_star(large_star(current, seen[0])))
        now = current.agg(*checks).first()
        if now == seen:
            return current.select(F.col("x").alias("node"), F.col("m").alias("root"))
        seen = now


def memberships(prints: DataFrame, radius: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """(fp, root, component_id, n) for every distinct ``fp`` of (doc_id, fp): root names the component,
    component_id is its smallest known doc_id (null if there is none), and n the number of rows with this fp."""
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(classes, radius, bucket_rows))
    linked = settle(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.col("n").alias("copies"), F.coalesce("root", "fp").alias("root")))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return settle(attach(linked, smallest, "root", linked.count()).select("fp", "root", "component_id", F.col("copies").alias("n")))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle_words: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits.
    Null texts count as empty; texts without words have fingerprint zero and link like any other.
    Repeated rows keep a row each.  Rows with a null doc_id keep their fingerprint, and their component_id
    is the smallest known id among their component (null if there is none).  Extra columns are ignored.
    """
    prints = settle(fingerprints(docs, shingle_words=shingle_words).drop("mark"))
    members = memberships(prints, radius, bucket_rows)
    return attach(prints, members, "fp", prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(docs: DataFrame, radius: int = 4, shingle_words: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """One row of ``docs`` for each component, with the columns of ``docs``.

    The row with the smallest doc_id stays, one without an id only where no row of its component has
    one; rows that share the id are told apart by a hash of all their columns, and of rows that are
    equal in all columns one stays.  Texts that share an id by mistake are thus judged each on its own.
    """
    mark = row_mark(docs)
    prints = settle(fingerprints(docs, shingle_words=shingle_words, mark=mark))
    return first_of_each(docs, mark, prints, memberships(prints, radius, bucket_rows))


def row_mark(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which have no hash, count by their JSON text, with a map column's keys in order."""

    def hashable(f: StructField) -> Column:
        if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString():
            return F.col(f"`{f.name}`")
        entries = F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, MapType) and "map<" not in f.dataType.valueType.simpleString() else F.col(f"`{f.name}`")
        return F.to_json(F.struct(entries.alias("v")))

    return F.xxhash64(*[hashable(f) for f in docs.schema.fields], *[F.col(f"`{c}`").isNull() for c in docs.columns])


def first_of_each(docs: DataFrame, mark: Column, prints: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per root: ``prints`` holds (doc_id, mark, fp) of every row and
    ``members`` (fp, root, n) every fp with its number of rows."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")).alias("r")
    found = attach(prints, members.select("fp", "root", "n"), "fp", prints.count()).groupBy("root").agg(first).select("r.doc_id", "r.mark")
    own, chosen_id, chosen_mark = (fresh(c, docs.columns) for c in ("own_mark", "chosen_id", "chosen_mark"))
    chosen = settle(found.select(F.col("doc_id").alias(chosen_id), F.col("mark").alias(chosen_mark)))
    same = (F.col(own) == F.col(chosen_mark)) & F.col("doc_id").cast("long").eqNullSafe(F.col(chosen_id))
    kept = docs.withColumn(own, mark).join(chosen, same, "left_semi")
    copied = prints.groupBy("doc_id", "mark").count().where("count > 1").select(F.col("mark").alias(own)).distinct()
    if copied.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(copied, own, "left_anti").select(docs.columns)
    return once.unionByName(kept.join(copied, own, "left_semi").dropDuplicates([own]).select(docs.columns))
