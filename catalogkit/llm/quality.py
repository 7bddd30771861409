"""Quality classification: histogram gradient-boosted trees over document statistics.

Every text is reduced to a row of numbers; trees are grown in numpy on binned values (logistic loss,
Newton leaves) and flattened into arrays, so that scoring a batch is a few gathers per tree level.

The fit reads at most ``sample_rows`` labelled rows of each class, those with the smallest id hashes, and shifts its
base to the classes' shares of all labels; only statistics, not texts, reach the driver.  Scoring reads every
whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.llm.common import fold, sample_labelled

FEATURES = (
    "bytes", "words", "mean_word", "long_words", "upper", "lower", "digit", "space", "newline", "sentence", "comma",
    "pipe", "bang", "hash_like", "other_punct", "non_ascii", "distinct_words", "top_word", "word_ends_symbol",
    "lines", "distinct_lines", "line_copy_bytes", "mean_line", "distinct_pairs", "top_pair", "capital_words", "byte_entropy",
)
_SYMBOLS = b"#$%&*@^~_=+<>\\{}[]"
_WORD_SYMBOL = re.compile(rb"[#$%&*@!^~_=+<>|]$")


def statistics(text: str | None) -> list[float]:
    """The features of one text; a null text counts as empty, and an empty one gives zeros."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w = len(words) or 1
    counts, pairs = Counter(words), Counter(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    p = c[c > 0] / n
    at = lambda chars: float(c[list(chars)].sum()) / n
    punct = [x for x in range(33, 127) if not chr(x).isalnum() and x not in b".,!?|" + _SYMBOLS]
    upper, ends = 0, 0
    for x, k in counts.items():
        upper += k * x[:1].isupper()
        ends += k * (_WORD_SYMBOL.search(x) is not None)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(map(len, words)) / w, sum(k for x, k in counts.items() if len(x) > 14) / w,
        float(c[65:91].sum()) / n, float(c[97:123].sum()) / n, float(c[48:58].sum()) / n, at(b" \t"), at(b"\n"), at(b".?"), at(b","),
        at(b"|"), at(b"!"), at(_SYMBOLS), at(punct), float(c[128:].sum()) / n, len(counts) / w, max(counts.values(), default=0) / w, ends / w,
        float(np.log1p(len(lines))), len(line_counts) / (len(lines) or 1), sum((k - 1) * len(x) for x, k in line_counts.items()) / n, float(np.log1p(n / (len(lines) or 1))),
        len(pairs) / max(1, len(words) - 1), max(pairs.values(), default=0) / max(1, len(words) - 1), upper / w, float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Forest:
    """Flattened trees: node i of a tree goes left if the feature is <= cut; a leaf points to itself."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 2.0, least: int = 8) -> Forest:
    """Boosts ``trees`` trees on rows ``x`` with 0/1 targets ``y`` from histograms of at most ``bins`` bins."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    if not len(y):
        x, trees = np.zeros((0, len(FEATURES))), 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1) if len(x) else None
    raw = np.full(len(y), base)

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
        at = len(feature)
        for store, v in ((feature, 0), (cut, 0.0), (left, at), (right, at), (value, float(rate * -g[rows].sum() / (h[rows].sum() + l2)))):
            store.append(v)
        if level == depth or len(rows) < 2 * least:
            return at
        flat = binned[rows] + np.arange(binned.shape[1]) * bins
        size = binned.shape[1] * bins
        sums = [np.bincount(flat.ravel(), np.repeat(v, binned.shape[1]), size).reshape(-1, bins).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows)))]
        gl, hl, nl = (s[:, :-1] for s in sums)
        gt, ht, nt = (s[:, -1:] for s in sums)
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain[(nl < least) | (nt - nl < least)] = -1
        j, b = np.unravel_index(gain.argmax(), gain.shape)
        if gain[j, b] <= 1e-6:
            return at
        go = binned[rows, j] <= b
        feature[at], cut[at] = int(j), float(edges[j][b])
        left[at] = node(rows[go], g, h, level + 1)
        right[at] = node(rows[~go], g, h, level + 1)
        return at

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        roots.append(node(np.arange(len(y)), prob - y, prob * (1 - prob), 0))
        place, at = np.full(len(y), roots[-1]), np.arange(len(y))
        f, c, lo, hi, v = (np.array(s) for s in (feature, cut, left, right, value))
        for _ in range(depth):
            place = np.where(x[at, f[place]] <= c[place], lo[place], hi[place])
        raw += v[place]
    return Forest(base, *(np.array(s, t) for s, t in ((feature, int), (cut, float), (left, int), (right, int), (value, float), (roots, int))), depth)


def measure(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, *others, stats array<double>) of every row; the others are whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], stats], names=["doc_id", *others, "stats"])

    chosen = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in others])
    return chosen.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *others)) + ", stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = 4000, **options) -> Forest:
    """Learns from the rows of ``docs`` with a label outside fold 0 of 5.

    A doc_id with several labels takes the largest, one with several texts teaches the one with the smallest hash.
    Labels without a document, null ids, labels and texts are left out, and without any label the score is one half
    everywhere.
    """
    known = labels.where(F.col(target).isNotNull() & (fold("doc_id", 5) != 0) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    chosen = sample_labelled(docs.select("doc_id", "text"), known, sample_rows)
    rows = sorted((r.doc_id, r.y, list(r.stats)) for r in measure(chosen, "y").collect())
    x, y = np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float)
    forest = grow(x, y, **options)
    if len(y) and y.min() < y.max():
        n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
        forest.base += float(np.log(n[1] / n[0]) - np.log(y.sum() / (1 - y).sum()))
    return forest


def predict(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts are scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)], float).reshape(-1, len(FEATURES))
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns as they are, whatever their names and types.

    Null texts are judged as empty ones, repeated rows each, long texts whole; of an empty table nothing stays.  Where
    nothing could be learned every row scores one half and stays."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(place)], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``; extra columns are ignored.

    Null and empty texts are scored alike; repeated rows each; an empty table gives no rows."""
    forest = fit(docs, labels, **options)
    return predict(docs, forest).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
