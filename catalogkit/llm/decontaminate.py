"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, one scan of every text.

A text's words are runs of digits, letters and characters beyond ASCII, A-Z lowered; this depends on single bytes
only, so a text is normalised by one byte table.  A window is ``window`` consecutive words of a benchmark text, or all
its words if they are fewer.  The automaton's alphabet is the benchmark's words, by number; a document's words that no
benchmark text has are number 0, which no window holds.  Long texts are fed in pieces, between which the automaton
keeps its state.  Matches are runs of words, mapped back to characters of the original text.

The benchmark, not the corpus, is broadcast: in parts of at most about PART_BYTES of text, each read, sent and built into
an automaton on its own; a task holds one automaton at a time, and with one part it is built once for each worker.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.llm.common import settle

PART_BYTES = 32 << 20
PIECE = 1 << 20  # bytes of a text whose words are held at a time
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

Runs = list[tuple[int, int]]  # first word and the word after the last


class Numbers(dict):
    """word -> its number; words that no benchmark text has are 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Windows:
    """The automaton of some benchmark texts: ``size`` and ``items`` of each window by its number."""

    def __init__(self, texts: Sequence[tuple[str | None, bytes]], window: int):
        self.numbers, self.size, self.items = Numbers(), [], []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for item, text in texts:
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.translate(FOLDED).split())
            for at in range(max(1, len(words) - window + 1) if words else 0):
                key = words[at : at + window]
                n = self.automaton.get(key, len(self.size))
                if n == len(self.size):
                    self.automaton.add_word(key, n)
                    self.size.append(len(key))
                    self.items.append(set())
                if item is not None:
                    self.items[n].add(item)
        if self.size:
            self.automaton.make_automaton()

    def scan(self, folded: bytes) -> tuple[int, Runs, set[str]]:
        """How many words a normalised text has, the runs of them that windows cover, and the items of these windows."""
        runs, met, number, n = [], set(), self.numbers.__getitem__, 0
        search = self.automaton.iter(()) if self.size else None
        for piece in pieces(folded):
            words = piece.split()
            n += len(words)
            if search is None:
                continue
            search.set(tuple(map(number, words)), False)
            for last, own in search:
                start, end = last + 1 - self.size[own], last + 1
                while runs and start <= runs[-1][1]:
                    start = min(start, runs.pop()[0])
                runs.append((start, end))
                met.add(own)
        return n, runs, set().union(*(self.items[w] for w in met))


def pieces(folded: bytes) -> Iterator[bytes]:
    """A normalised text cut after about PIECE bytes each, between words."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end]
        at = end


def joined(runs: Runs) -> Runs:
    out: Runs = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def spans(text: bytes, folded: bytes, runs: Runs) -> list[dict[str, int]]:
    """The runs' places in the text, in characters: each from its first word's start to its last word's end."""
    inside = np.frombuffer(folded, np.uint8) != 32
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))  # starts and ends of the words in turn
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    out, at, chars = [], 0, 0
    for run in runs:
        places = []
        for byte in (int(edge[2 * run[0]]), int(edge[2 * run[1] - 1])):
            chars += int(np.count_nonzero(lead[at:byte]))
            at = byte
            places.append(chars)
        out.append({"start": places[0], "end": places[1]})
    return out


def parts(benchmark: DataFrame, text_columns: Sequence[str], id_column: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark's texts with their ids as text, in lists of about PART_BYTES."""
    own = benchmark.select(F.col(id_column).cast("string").alias("item"), F.explode(F.array(*[F.col(c).cast("string") for c in text_columns])).alias("text")).where("text IS NOT NULL").distinct()
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // PART_BYTES)
    own = settle(own) if n > 1 else own
    for part in range(n):
        rows = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == part) if n > 1 else own
        yield [(r.item, bytes(r.text)) for r in rows.select("item", F.col("text").cast("binary").alias("text")).sort("item", "text").collect()]


_held: dict[str, object] = {"key": None}  # the automaton that this worker built last


def held(part: Broadcast, key: tuple, window: int) -> Windows:
    if _held["key"] != key:
        _held.update(key=None, windows=None)
        _held.update(key=key, windows=Windows(part.value, window))
    return _held["windows"]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_columns: Sequence[str] = ("text",), id_column: str = "item_id", doc_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>, spans array<struct<start, end>>), a row per row of ``docs``.

    A word is hit if it lies in an occurrence of any window; items are the ids, as text and sorted, of the benchmark rows
    with occurring windows; spans are the hit passages in characters of the original text, end exclusive.
    ``text_columns`` are the benchmark's texts, such as a question and its answer, each with windows of its own.

    Null texts and texts without words have no words and are never hit; a benchmark text without words has no window.
    Rows that repeat an id are answered each; a benchmark row without an id hits words but is no item, and rows that
    share an id are one item.  With an empty benchmark nothing is hit; an empty table gives no rows.  Extra columns are
    ignored, whatever their names.
    """
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(own) for own in parts(benchmark, text_columns, id_column)]
    mark = f"{context.applicationId}:{window}"
    keys = [(mark, b._jbroadcast.id()) for b in sent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                texts = [t or b"" for t in piece.column(1).to_pylist()]
                folded = [t.translate(FOLDED) for t in texts]
                n_words = [0] * len(texts)
                runs: list[Runs] = [[] for _ in texts]
                items: list[set] = [set() for _ in texts]
                for key, part in zip(keys, sent):
                    windows = held(part, key, window)
                    for i, f in enumerate(folded):
                        n_words[i], found, own = windows.scan(f)
                        runs[i] += found
                        items[i] |= own
                if not sent:
                    n_words = [sum(len(p.split()) for p in pieces(f)) for f in folded]
                runs = [joined(r) if len(sent) > 1 else r for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0), pa.array(n_words, pa.int64()), pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        pa.array([spans(t, f, r) if r else [] for t, f, r in zip(texts, folded, runs)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    chosen = docs.select(F.col(doc_column).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>")


def digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of ``scan``'s rows."""
    return scan(docs, benchmark, **options).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
