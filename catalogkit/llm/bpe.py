"""Byte-level BPE by tree reduction.

Encoding.  A text is halved until its pieces are leaves of at most ``leaf`` characters; leaves are
encoded by ranks, and two neighbours are joined by re-encoding a window around their boundary.  The
window grows until the tokens outside it are proven to stay:

* Matches of the public pattern hold letters, digits, white space or other characters, with at most one space
  before and, in a contraction, an apostrophe before letters.  Between two characters that no match holds one after
  the other there is a boundary in any context, and a window between two such places covers all that the join
  can change.
* Inside a run of one kind that is longer than the search for such places, the window grows token by token.  A
  sequence of tokens is the encoding of its bytes if every two neighbours are (each pair, encoded alone, gives
  itself), so the join is done once the pairs at both window edges are.
* A run that does not settle before its ends is encoded anew as a whole.

Concatenation with this join is associative, with the empty text as its unit: any tree gives the same
ids.  Decoding concatenates the tokens' bytes up a tree in the same way.

The work is per row, spread by Spark over the input's partitions; there is no shuffle.  Time grows with a text's length
times the depth of its tree.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.llm.tokens import SPACE, RankEncoder, ranks_of

#: places between two characters that no match holds one after the other
_CUT = regex.compile(
    rf"(?<=\p{{L}})(?!\p{{L}})|(?<=\p{{N}})(?!\p{{N}})|(?<=[^{SPACE}\p{{L}}\p{{N}}'])(?=[{SPACE}\p{{L}}\p{{N}}])|(?<=')(?=[{SPACE}\p{{N}}])"
)
#: text of one kind; an apostrophe could begin a contraction
_RUN = regex.compile(rf"\p{{L}}+|\p{{N}}+|[{SPACE}]+|[^{SPACE}\p{{L}}\p{{N}}']+")
REACH = 32  # characters on each side that the search for boundaries starts with
SEARCH = 64  # and from which on a run is joined token by token


class TreeCodec:
    def __init__(self, ranks: dict[bytes, int], leaf: int = 512):
        self.leaf = max(2, leaf)
        self.ranks = ranks
        self.encoder = RankEncoder(ranks)
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self._stays = functools.lru_cache(maxsize=100_000)(self._pair)

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def load(path: str, leaf: int = 512) -> TreeCodec:
        return TreeCodec(ranks_of(path), leaf)

    def _pair(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens, merged by ranks, are these two tokens."""
        raw, last = self.bytes_of[a] + self.bytes_of[b], len(self.ranks)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(x + y, last), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == last:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts == [self.bytes_of[a], self.bytes_of[b]]

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.encoder.encode(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(self._encode(text, lo, mid), self._encode(text, mid, hi), text, lo, mid, hi)

    def _join(self, left: list[int], right: list[int], text: str, lo: int, mid: int, hi: int) -> list[int]:
        reach, sizes = REACH, [4, 4]
        while True:
            a, b = max(lo, mid - reach), min(hi, mid + reach)
            start, end = lo if a == lo else None, hi if b == hi else None
            window = text[a:b]
            run = reach >= SEARCH and _RUN.fullmatch(window)  # has no boundary inside
            for m in () if run else _CUT.finditer(window):
                at = a + m.start()
                if lo < at <= mid and at < b:
                    start = at
                if mid <= at < b:
                    end = at
                    break
            if start == mid == end:
                return left + right
            if run and (joined := self._join_run(left, right, window, mid - a, b == hi, sizes)):
                return joined
            if start is not None and end is not None:
                drop_l, drop_r = self._count(left, text[start:mid], True), self._count(right, text[mid:end], False)
                return left[: len(left) - drop_l] + self.encoder.encode(text[start:end]) + right[drop_r:]
            reach *= 2 if reach < SEARCH else 4

    def _count(self, ids: list[int], part: str, back: bool, inside: bool = False) -> int:
        """How many tokens at the end (or start) of ``ids`` make up ``part``, or at most lie ``inside`` it."""
        size, n = len(part.encode("utf-8", "replace")), 0
        for i in reversed(ids) if back else ids:
            size -= len(self.bytes_of[i])
            if size < 0 and inside:
                break
            n += 1
            if size <= 0:
                break
        return n if part else 0

    def _join_run(self, left: list[int], right: list[int], window: str, mid: int, at_end: bool, sizes: list[int]) -> list[int] | None:
        """The join, if the tokens inside ``window``, all of one kind, settle; ``sizes`` keeps how many tokens were
        tried on each side."""
        # the first two letters may belong to a contraction, the last white space to the match after it
        most_l = self._count(left, window[2:mid], True, inside=True)
        most_r = self._count(right, window[mid:] if at_end else window[mid:-1], False, inside=True)
        while True:
            l, r = sizes
            while l < len(left) and self._continues(left[-l]):
                l += 1
            while r < len(right) and self._continues(right[r]):
                r += 1
            if l >= most_l or r >= most_r:
                return None
            joined = self.whole.encode_ordinary(b"".join(self.bytes_of[i] for i in left[-l:] + right[:r]).decode())
            ok_l, ok_r = self._stays(left[-l - 1], joined[0]), self._stays(joined[-1], right[r])
            if ok_l and ok_r:
                return left[:-l] + joined + right[r:]
            sizes[:] = [l if ok_l else 2 * l, r if ok_r else 2 * r]

    def _continues(self, token: int) -> bool:
        """Whether a token starts inside a character."""
        return self.bytes_of[token][0] & 0xC0 == 0x80

    def decode(self, ids: list[int], leaf: int = 512) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid], leaf) + self.decode(ids[mid:], leaf)


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null texts count as empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec.load(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                ids = pa.array([codec.encode(t.as_py() or "") for t in piece.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, raw binary) from (doc_id, ids); null ids give an empty value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec.load(ranks_path)
        for batch in batches:
            raw = pa.array([codec.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding, then decoding of the ids, in one pass,
    so that the ids need not leave the worker.

    A row per row: null texts count as empty (no tokens), repeated rows and null ids stay, an empty table gives no
    rows, and extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec.load(ranks_path)
        for batch in batches:
            count, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                count.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
