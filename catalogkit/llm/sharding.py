"""Sharding by histogram sort: near-equal bytes per shard, contiguous in a hashed key.

A row's key is the hash of its text with a hash of its id below it, so that equal texts stay together
unless a splitter has to cut through a group that is too large.  Rows that repeat both are numbered, so that the
shards depend on the rows alone, however they are split.  The splitters are found without sorting:
in each round the exact bytes below a set of candidate boundaries are counted in all partitions, and each
splitter's interval shrinks around its target until a boundary meets the tolerance.  Boundaries between
groups are tried before those inside one.  Rows are then exchanged once, by the splitters: a shard of many rows is cut
into pieces by further boundaries, from exact counts of rows, and each piece is sorted where it arrives.  The rows below a
piece's boundary number it within its shard.

Only counts at the probes, a bounded number, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogkit.llm.common import fresh, running_sum, settle

LOW_BITS = 22  # of the key come from the row, the 41 bits above from its text
TOP = 1 << 63


def sort_key(text: Column, *told_apart: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 23), LOW_BITS)
    return high.bitwiseOR(F.xxhash64(*told_apart, F.lit(5)).bitwiseAND(F.lit((1 << LOW_BITS) - 1)))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, twin): twin counts the rows of equal doc_id and text before this one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("nameless"), F.xxhash64(text).alias("hash"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), sort_key(F.col("text"), F.col("doc_id").cast("long")).alias("key"),
        F.monotonically_increasing_id().alias("row"), F.lit(1).alias("one"), F.lit(0).cast("long").alias("twin"),
    ))
    same = ["id", "nameless", "hash", "size", "text_crc32"]
    if not rows.groupBy(*same).count().where("count > 1").isEmpty():
        told = running_sum(rows.drop("twin"), "one", "twin", same, ["row"])
        own = sort_key(F.lit(None).cast("string"), F.col("id"), F.col("nameless"), F.col("twin")).bitwiseAND(F.lit((1 << LOW_BITS) - 1))
        repeat = F.shiftleft(F.shiftright("key", LOW_BITS), LOW_BITS).bitwiseOR(own)
        rows = settle(told.withColumn("key", F.when(F.col("twin") > 0, repeat).otherwise(F.col("key"))))
    return rows.select(F.when(~F.col("nameless"), F.col("id")).alias("doc_id"), "size", "text_crc32", "key", "twin")


def bytes_below(rows: DataFrame, probes: np.ndarray) -> np.ndarray:
    """The exact sum of ``size`` over the rows of (key, size) whose key is below each probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, np.asarray(batch.column(0)), side="right")
            np.add.at(total, at, np.asarray(batch.column(1)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bin", "bytes"])

    counts = np.zeros(len(probes) + 1, np.int64)
    for r in rows.select("key", "size").mapInArrow(run, "bin long, bytes long").groupBy("bin").agg(F.sum("bytes").alias("n")).collect():
        counts[r.bin] = r.n
    return counts.cumsum()[:-1]


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.005, fan: int = 64) -> list[int]:
    """shards - 1 ascending boundaries; a row goes to the number of boundaries at or below its key."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * j // shards for j in range(1, shards)]
    allowed = tolerance * total / shards
    low, high = [0] * len(targets), [TOP - 1] * len(targets)
    best: list[tuple[float, int]] = [(float("inf"), 0)] * len(targets)
    group = 1 << LOW_BITS
    while todo := [i for i in range(len(targets)) if best[i][0] > allowed and high[i] - low[i] > 1]:
        probes: set[int] = set()
        for i in todo:
            gap = high[i] - low[i]
            step = max(1, gap // (fan if len(set(low)) > 1 else fan * shards))
            cand = range(low[i] + step, high[i], step)
            # whole groups first: boundaries between texts as long as the interval holds some
            probes.update(c - c % group if gap > 2 * group and c - c % group > low[i] else c for c in cand)
        at = np.array(sorted(probes), np.int64)
        below = bytes_below(rows, at)
        for i in todo:
            inside = (at >= low[i]) & (at <= high[i])
            for p, n in zip(at[inside].tolist(), below[inside].tolist()):
                best[i] = min(best[i], (abs(n - targets[i]), p))
            under = at[inside][below[inside] <= targets[i]]
            over = at[inside][below[inside] > targets[i]]
            low[i] = max(low[i], int(under[-1])) if len(under) else low[i]
            high[i] = min(high[i], int(over[0])) if len(over) else high[i]
    return sorted(b for _, b in best)


def pieces(rows: DataFrame, cut: np.ndarray, piece_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending boundaries, ``cut`` among them, between which at most ``piece_rows`` rows lie (more only where they share a
    key), and the rows before each piece.  Pieces that are too large are cut evenly by key, which is a hash, and counted
    again; boundaries are about twice as many as rows / piece_rows."""
    counted = rows.select("key", F.lit(1).cast("long").alias("size"))
    total, ends = rows.count(), np.unique(cut)
    while True:
        starts = np.concatenate([[0], bytes_below(counted, ends)])
        low, high, n = np.concatenate([[0], ends]), np.concatenate([ends, [TOP - 1]]), np.diff(np.concatenate([starts, [total]]))
        large = np.flatnonzero((n > piece_rows) & (high - low > 1))
        if not len(large):
            return ends, starts
        parts = -(-2 * n[large] // piece_rows)
        steps = np.maximum(1, (high - low)[large] // parts)
        inner = [a + step * np.arange(1, k, dtype=np.int64) for a, step, k in zip(low[large], steps, parts)]
        ends = np.union1d(ends, np.concatenate([x[x < b] for x, b in zip(inner, high[large])]))


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.005, piece_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, key): a row per row of ``docs``.

    size is the text's UTF-8 bytes (none for a null text) plus 16; null ids are ids like others.  slot numbers a
    shard's rows from 0 without gaps, in the order of the keys.  The result is the same however the input is
    split and whatever ``piece_rows``, the most rows of a piece.  A shard's bytes are within ``tolerance`` of the mean unless
    a text larger than that lies at its edge.  An empty table gives no rows; with fewer rows than shards some shards
    stay empty.  Extra columns are ignored.
    """
    rows = keyed(docs)
    cut = np.array(splitters(rows, shards, tolerance), np.int64)
    ends, starts = pieces(rows, cut, piece_rows)
    shard_of = np.concatenate([[0], np.searchsorted(cut, ends, side="right")])
    before = starts - starts[np.searchsorted(shard_of, shard_of, side="left")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece = np.searchsorted(ends, np.asarray(batch.column("key")), side="right")
            yield batch.append_column("piece", pa.array(piece.astype(np.int32))).append_column("shard", pa.array(shard_of[piece].astype(np.int32))).append_column("before", pa.array(before[piece]))

    # two texts may share a key: id and checksum settle their order
    placed = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, key long, twin long, piece int, shard int, before long")
    place_in_piece = F.row_number().over(Window.partitionBy("piece").orderBy("key", "doc_id", "twin", "text_crc32", "size"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + place_in_piece - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "key"
    )


def write(docs: DataFrame, path: str, shards: int = 40, tolerance: float = 0.005, files: int = 1) -> None:
    """Writes the rows of ``docs`` as one Parquet folder per shard, by the same law, in one exchange.

    Each shard gets ``files`` files.  Rows that repeat id and text are equal to the law and share a key here.
    """
    key, shard_of, file_of = sort_key(F.col("text"), F.col("doc_id").cast("long")), fresh("shard", docs.columns), fresh("file", docs.columns)
    sized = (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 16).cast("long").alias("size")
    cut = splitters(settle(docs.select(key.alias("key"), sized)), shards, tolerance)
    to = F.size(F.filter(F.array(*[F.lit(c) for c in cut]).cast("array<bigint>"), lambda c: c <= key))
    numbered = docs.withColumn(shard_of, to).withColumn(file_of, F.pmod(F.xxhash64(key), F.lit(files)))
    numbered.repartition(shards * files, shard_of, file_of).drop(file_of).write.mode("overwrite").partitionBy(shard_of).parquet(path)
