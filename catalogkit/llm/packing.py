"""Mixture-controlled packing: deficit round-robin over source queues into fixed-length sequences.

Each source has a queue of documents.  In every round (window) a source earns a quantum of
``window_tokens`` x its share of the mixture; a document is served in the round in which the credit its
source has earned reaches it, and what is left over is carried to the next round as the source's
deficit.  As credit is a running total, the round of a document follows from its position in its own
queue alone - round = position / quantum - so that rounds need no sequential loop: deficits cross
windows and partitions inside the division.  Every source starts at a phase of its own, so that small
sources do not all come due in the same round.

The documents, in order of round, source and queue position, form one stream that is cut every
``length`` tokens.  Every sequence but the last is full, and the last is cut into powers of two, which
are not padded.

Scale.  Positions in the queues and in the stream are two-level running sums over ranges of equal size,
whatever a source's.  Token ids are computed once, checkpointed as 16- or 32-bit integers, and
meet their cuts in one join on a row number.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.llm.common import running_sum, settle
from catalogkit.llm.tokens import EOS, WordTokenizer

FIXED = 65_536  # quanta are kept in this fraction of a token


def compact(ids: list[int]) -> bytes:
    """Little-endian 16-bit ids where all fit, else 32-bit ones."""
    try:
        raw = array("H", ids)
    except OverflowError:
        raw = array("I", ids)
    if sys.byteorder == "big":
        raw.byteswap()
    return raw.tobytes()


def tokenise(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, source, n, ids binary): ids are little-endian uint16, or uint32 where one needs it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer.load(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                packed, counts = [], []
                for text in piece.column(2).to_pylist():
                    ids = encoder.encode(text or "")
                    ids.append(EOS)
                    counts.append(len(ids))
                    packed.append(compact(ids))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "source", "n", "ids"],
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return chosen.mapInArrow(run, "doc_id long, source string, n long, ids binary")


def schedule(docs: DataFrame, window_tokens: int = 16_384, shares: dict[str, float] | None = None) -> DataFrame:
    """(row, n, start): the place of each document in the stream, from (row, place, source, n).

    A queue is in order of ``place``, a hash of the document's id, so that the result does not depend on how
    the input is split; only rows that repeat an id are told apart by ``row``.

    ``shares`` maps sources to target proportions of a window's tokens; a source without one (and every
    source by default) gets its natural share, so that all queues last until the end.  A source that runs dry earns
    no more: later rounds hold the others in their proportions, and the sequences stay full.
    """
    total = docs.agg(F.sum("n").alias("t"), F.count("*").alias("rows")).first()
    if not total.rows:
        return docs.select("row", "n", F.lit(0).cast("long").alias("start"))
    docs = docs.withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # a null source is a queue too
    queues = running_sum(docs, "n", "position", ["queue"], ["place", "row"])
    share = F.col("tokens") / F.lit(float(total.t))
    if shares:
        # a dictionary given by the caller, of the size of its own literal
        target = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        share = F.coalesce(F.try_element_at(target, F.col("source")), share)
    quanta = docs.groupBy("queue", "source").agg(F.sum("n").alias("tokens")).select(
        "queue",
        F.greatest(F.lit(1), F.floor(share * window_tokens * FIXED)).cast("long").alias("quantum"),
        (F.pmod(F.xxhash64("queue", F.lit(1)), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("phase"),
    )
    rounds = queues.join(quanta, "queue").select(
        "row", "n", "queue", "position",
        F.expr(f"(position + cast(floor(phase * n) as bigint)) * {FIXED} div quantum").alias("round"),
    )
    starts = running_sum(rounds.groupBy("round").agg(F.sum("n").alias("tokens")), "tokens", "base", [], ["round"]).select("round", "base")
    inside = "sum(n) over (partition by round order by queue, position, row rows between unbounded preceding and 1 preceding)"
    local = rounds.withColumn("inside", F.coalesce(F.expr(inside), F.lit(0)))
    return local.join(starts, "round").select("row", "n", (F.col("base") + F.col("inside")).alias("start"))


def cuts(placed: DataFrame, length: int) -> DataFrame:
    """(row, pieces): for each document the pieces (start, length, sequence_id, offset) that it is cut into."""
    total = placed.agg(F.sum("n")).first()[0] or 0
    full, rest = divmod(total, length)
    # the tail as powers of two: starts and lengths of at most log2(length) sequences
    tail, at = [], full * length
    for bit in range(length.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            tail.append((at, 1 << bit))
            at += 1 << bit
    first, last = F.col("start"), F.col("start") + F.col("n")
    whole = F.when(first < full * length, F.expr(
        f"transform(sequence(start div {length}, (least(start + n, {full * length}) - 1) div {length}), "
        f"k -> struct(k as id, k * {length} as lo, (k + 1) * {length} as hi))"
    )).otherwise(F.expr("array()").cast("array<struct<id:bigint,lo:bigint,hi:bigint>>"))
    ends = F.array(*[F.struct(F.lit(full + i).cast("long").alias("id"), F.lit(a).cast("long").alias("lo"), F.lit(a + size).cast("long").alias("hi")) for i, (a, size) in enumerate(tail)])
    sequences = F.concat(whole, F.filter(ends, lambda e: (e.lo < last) & (e.hi > first))) if tail else whole
    piece = lambda e: F.struct(
        (F.greatest(e.lo, first) - first).alias("start"), (F.least(e.hi, last) - F.greatest(e.lo, first)).alias("length"),
        e.id.alias("sequence_id"), (F.greatest(e.lo, first) - e.lo).alias("offset"),
    )
    return placed.select("row", F.transform(sequences, piece).alias("pieces"))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, **options) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row per piece.

    Null texts count as empty (the end id alone), a null source is a queue of its own, repeated rows are
    packed each, and an empty table gives no piece.  ids are the piece's ids as little-endian uint32.
    """
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    ids = settle(tokenise(docs, tokenizer_path).select(F.monotonically_increasing_id().alias("row"), "*"))
    placed = settle(schedule(ids.select("row", F.xxhash64("doc_id").alias("place"), "source", "n"), **options))
    cut = ids.select("row", "doc_id", "n", "ids").join(cuts(placed, length), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, n, raw, pieces in zip(*(batch.column(i).to_pylist() for i in range(4))):
                array = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for p in pieces:
                    own = array[p["start"] : p["start"] + p["length"]].tobytes()
                    for store, v in zip(out, (doc_id, p["start"], p["length"], zlib.crc32(own), n, p["sequence_id"], p["offset"], own)):
                        store.append(v)
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return cut.select("doc_id", "n", "ids", "pieces").mapInArrow(run, schema)
