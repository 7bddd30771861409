"""Toxicity: a convolutional text classifier over hashed word embeddings, trained by tasks that share one network.

A word's embedding is the sum of rows of a hashed table of ``buckets`` rows: one for the word and one for each of its
beginnings of STEMS letters, so that words of a common stem share what is learned.  Every word has its rows; words that
share one of them differ in the others, as a rule.  Filters of widths one, two and three run over the whole text; their
maxima, rectified, feed a logistic output.  Training starts from random values and takes mini-batches with
Adagrad.  Only rows that tell the classes apart learn: those whose shares of toxic and of clean training texts differ with a
log likelihood ratio of ``evidence`` or more (3.84 is what chance exceeds once in twenty); the others stay zero, or a small sample's chance words would drown the rest.
A tenth of the labelled rows is held out: on it the offset is moved so that a score of 0.5 parts the classes, as far as its
number of rows allows, and then the thresholds for each language are calibrated.

The fit reads every labelled row outside the fold, whole.  Spark counts in how many texts of each class a row of the table is.
A text is then kept as the numbers of its words that learn, and runs of other words, whose embeddings are zero, are cut to
the length of the widest filter: no filter's maximum changes.  The texts are dealt by their ids' hashes to parts of about
PART texts, PARTS at most, and numbered there, in chunks that write each word's rows once; in each epoch a task takes a part's mini-batches from the common network on, and the
changes, which travel in half precision, are averaged, a table row's over the parts that met it, in proportion to how often.  Neither a task nor the driver holds more than the
network and CHUNK texts; the held-out rows' scores reach the driver as counts.
The thresholds decide ``flagged``, never the score.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.llm.common import fold, settle, stored

_ODD = re.compile(r"[^\w\x00-\x7f]")  # of no word, beyond ASCII
_SPACED = bytes(c if c >= 128 or re.match(r"\w", chr(c)) else 32 for c in range(256))
STEMS = (3, 4, 5, 6, 7, 8)
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1  # words without meaning after each text
PIECE = 1 << 16  # words that are scored at a time
PART, PARTS = 8000, 32  # texts of a part that one task learns from in an epoch, while there are fewer than so many parts
CHUNK = 4096  # texts of a part that are shuffled together
WORDS = 300_000  # words of a chunk's texts that are numbered together
SLOT = 2048  # rows of the table that travel together
STEP = 64  # held-out scores are counted by their log odds, in so many steps to one
DENSE = ("kernel", "bias", "weight", "offset")


def words_of(text: str | None) -> list[str]:
    """The lower-case runs of \\w."""
    text = (text or "").lower()
    return (text if text.isascii() else _ODD.sub(" ", text)).encode().translate(_SPACED).decode().split()


def rows_of_words(words: list[str], buckets: int) -> np.ndarray:
    """A row for each word: its rows of the table; row 0 is kept for what follows a text."""
    whole = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))
    letters = np.array(words, f"U{max(STEMS)}").view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    found, mixed = [whole], np.zeros(len(words), np.uint64)
    for k in range(max(STEMS)):  # a beginning's hash goes on from that of the beginning before; a shorter word has zeros
        mixed = (mixed ^ (letters[:, k] + np.uint64(k + 1))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if k + 1 in STEMS:
            found.append(mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20))
    return (1 + np.array(found).T % np.uint64(buckets - 1)).astype(np.int32)


def rows_of(word: str, buckets: int) -> list[int]:
    return rows_of_words([word], buckets)[0].tolist()


class Lexicon(defaultdict):
    """word -> how many words were met before it.  A text's words have their numbers, whose rows of the table are ``rows``; number 0 follows a text.

    With ``slots``, a row's place among those that learn (0: it does not), rows are those places, and a word without any has number 0.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        super().__init__(count().__next__)
        self.buckets, self.slots, self.rows, self.products = buckets, slots, np.zeros((1, 1 + len(STEMS)), np.int32), None
        self.number = np.zeros(0, np.int32)  # by how many words were met before

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's words."""
        known = len(self)
        met = [np.fromiter(map(self.__getitem__, w), np.int32, len(w)) for w in map(words_of, texts)]
        if len(self) > known:
            new = list(islice(reversed(self), len(self) - known))[::-1]
            rows = rows_of_words(new, self.buckets)
            rows = rows if self.slots is None else self.slots[rows].astype(np.int32)
            active = rows.any(axis=1)
            self.number = np.concatenate([self.number, np.where(active, active.cumsum() + len(self.rows) - 1, 0).astype(np.int32)])
            self.rows = np.concatenate([self.rows, rows[active]])
        return [self.number[m] for m in met]

    def numbers(self, text: str | None) -> np.ndarray:
        return self.texts([text])[0]


def compact(numbers: np.ndarray) -> np.ndarray:
    """The text with runs of words 0 cut to the widest filter's width: the same windows but for repeated ones of zeros."""
    at = np.arange(len(numbers))
    return numbers[at - np.maximum.accumulate(np.where(numbers != 0, at, -1)) <= max(WIDTHS)]


def distinct(numbers: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ``numbers``, all below ``most``, and where among them each is."""
    at = np.arange(len(numbers), dtype=np.int32)
    mark = np.empty(most, np.int32)
    mark[numbers] = at
    used = numbers[mark[numbers] == at]
    mark[used] = at[: len(used)]
    return used, mark[numbers]


def joined(texts: list[np.ndarray], tails: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts after one another, each followed by PAD zeros, or its tail, PAD words of which no window starts (an empty
    text is one zero); where each starts; and which places are windows."""
    gap = np.zeros(PAD, np.int32)
    parts = [p for t, tail in zip(texts, tails or [gap] * len(texts)) for p in (t if len(t) else gap[:1], tail)]
    flat = np.concatenate([*parts, gap])
    sizes = np.array([max(1, len(t)) + PAD for t in texts])
    starts = np.concatenate([[0], sizes.cumsum()[:-1]])
    inside = np.ones(len(flat) - PAD, bool)
    for k in range(PAD):
        inside[starts + sizes - 1 - k] = False
    return flat, starts, inside


@dataclass
class Network:
    buckets: int = 1 << 17
    dims: int = 16
    filters: int = 8
    table: np.ndarray = None
    kernel: np.ndarray = None  # dims x (filters of each width and place)
    bias: np.ndarray = None
    weight: np.ndarray = None
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = 0.5  # the threshold of other languages

    def start(self, seed: int) -> None:
        rng, columns = np.random.default_rng(seed), self.filters * sum(WIDTHS)
        self.table = rng.normal(0, 0.002, (self.buckets, self.dims)).astype(np.float32)
        self.table[0] = 0
        self.kernel = rng.normal(0, 0.3, (self.dims, columns)).astype(np.float32)
        self.bias = np.zeros(self.filters * len(WIDTHS), np.float32)
        self.weight = rng.normal(0, 0.3, self.filters * len(WIDTHS)).astype(np.float32)

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        """Each word's embedding, from its rows."""
        out = self.table[rows[:, 0]]
        for column in rows.T[1:]:
            out += self.table[column]
        return out

    def responses(self, z: np.ndarray) -> np.ndarray:
        """All filters' values, a line for each, at every place but the last PAD, from the places' products with the kernel, a line for each of its columns."""
        n, f, column = z.shape[1] - PAD, self.filters, 0
        out = np.empty((f * len(WIDTHS), n), z.dtype)
        for own, w in zip(out.reshape(len(WIDTHS), f, n), WIDTHS):
            own[:] = z[column : column + f, :n]
            for k in range(1, w):
                own += z[column + k * f : column + (k + 1) * f, k : n + k]
            column += w * f
        return out

    def pooled(self, z: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Each text's maxima of all filters."""
        values = self.responses(np.ascontiguousarray(z.T))
        values[:, ~inside] = -np.inf
        return np.maximum.reduceat(values, starts, axis=1).T

    def output(self, best: np.ndarray) -> np.ndarray:
        raw = np.maximum(best + self.bias, 0) @ self.weight + self.offset
        return 1 / (1 + np.exp(-np.clip(raw.astype(float), -40, 40)))

    def scores(self, texts: list[np.ndarray], products: np.ndarray) -> np.ndarray:
        """The score of each text, from its words' numbers and their products with the kernel.

        Long texts are met in pieces, each with the PAD words after it, so that memory does not grow with a text.
        """
        best = np.full((len(texts), self.filters * len(WIDTHS)), -np.inf, np.float32)
        longer = [np.concatenate([t, np.zeros(PAD, np.int32)]) for t in texts]
        pieces = [(i, t[at : at + PIECE], longer[i][at + PIECE :][:PAD] if at + PIECE < len(t) else longer[i][len(t) :]) for i, t in enumerate(texts) for at in range(0, max(1, len(t)), PIECE)]
        at = 0
        while at < len(pieces):
            end, size = at + 1, len(pieces[at][1])
            while end < len(pieces) and size + len(pieces[end][1]) <= PIECE:
                size += len(pieces[end][1])
                end += 1
            owner, own, tails = zip(*pieces[at:end])
            flat, starts, inside = joined(own, tails)
            np.maximum.at(best, np.array(owner), self.pooled(products[flat], starts, inside))
            at = end
        return self.output(best)

    def score(self, texts: list[str | None], lexicon: Lexicon | None = None) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(texts))
        lexicon = Lexicon(self.buckets) if lexicon is None else lexicon
        numbers = [compact(t) for t in lexicon.texts(texts)]
        done = 0 if lexicon.products is None else len(lexicon.products)
        if done < len(lexicon.rows):
            new = self.embedded(lexicon.rows[done:]) @ self.kernel
            lexicon.products = np.concatenate([lexicon.products, new]) if done else new
        return self.scores(numbers, lexicon.products)

    def places(self, z: np.ndarray, word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's maxima of all filters and their first places, from the words' products with the kernel, PIECE places at a time."""
        units, n = np.arange(self.filters * len(WIDTHS)), len(word) - PAD
        best, place = np.full((len(starts), len(units)), -np.inf, z.dtype), np.zeros((len(starts), len(units)), np.int64)
        z, ends = np.ascontiguousarray(z.T), np.append(starts[1:], n) - PAD
        for a in range(0, n, PIECE):
            values = self.responses(np.take(z, word[a : a + PIECE + PAD], axis=1))
            for i in range(np.searchsorted(ends, a, "right"), np.searchsorted(starts, a + values.shape[1])):
                lead = max(starts[i] - a, 0)
                at = lead + values[:, lead : ends[i] - a].argmax(axis=1)  # the first of equal maxima
                top = values[units, at]
                more = top > best[i]
                place[i, more], best[i, more] = at[more] + a, top[more]
        return best, place

    def gradients(self, texts: list[np.ndarray], rows_of_word: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, dict]:
        """The weighted log loss of a batch, and its gradients; the table's as (rows, values)."""
        flat, starts, _ = joined(texts)
        used, word = distinct(flat, len(rows_of_word))
        at = rows_of_word[used]
        x = self.embedded(at)
        best, place = self.places(x @ self.kernel, word, starts)
        p = self.output(best)
        g = ((p - y) * weights).astype(np.float32)
        active = best + self.bias > 0
        own = g[:, None] * self.weight * active
        out = {"weight": (g[:, None] * np.maximum(best + self.bias, 0)).sum(axis=0), "bias": own.sum(axis=0), "offset": float(g.sum()), "kernel": np.zeros_like(self.kernel)}
        rows, parts, column, f = [], [], 0, self.filters
        for j, w in enumerate(WIDTHS):
            mine = own[:, j * f : (j + 1) * f]
            for k in range(w):
                c = slice(column + k * f, column + (k + 1) * f)
                spot = place[:, j * f : (j + 1) * f] + k
                out["kernel"][:, c] = np.einsum("tf,tfd->df", mine, x[word[spot]])
                grad = (mine[:, :, None] * self.kernel[:, c].T[None]).reshape(-1, self.dims)
                own_rows = at[word[spot]].reshape(-1, at.shape[1])
                pair, side = np.nonzero(own_rows)  # row 0 stays as it is
                rows.append(own_rows[pair, side])
                parts.append(grad[pair])
            column += w * f
        rows, parts = np.concatenate(rows), np.concatenate(parts)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.diff(rows, prepend=0))
        out["table"] = (rows[first], np.add.reduceat(parts[order], first, axis=0) if len(first) else parts)
        loss = -(weights * (y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12)))).sum()
        return float(loss), out


def parting(s: np.ndarray, t: np.ndarray, n: np.ndarray | None = None) -> float:
    """The middle of the cuts of scores ``s``, met ``n`` times, with the largest sum of the classes' shares on their own sides."""
    n = np.ones(len(s)) if n is None else n
    cuts, at = np.unique(s, return_inverse=True)
    met = np.array([np.bincount(at, n * (t == label), len(cuts)) for label in (0, 1)])
    below = np.concatenate([np.zeros((2, 1)), met.cumsum(axis=1)], axis=1)
    value = 1 - below[1] / met[1].sum() + below[0] / met[0].sum()
    edges = np.concatenate([[0.0], cuts, [1.0]])
    tries, top = (edges[1:] + edges[:-1]) / 2, np.flatnonzero(value >= value.max() - 1e-12)
    return float((tries[top[0]] + tries[top[-1]]) / 2)


def thresholds(scores: np.ndarray, y: np.ndarray, langs: list[str], like: float = 20.0, counts: np.ndarray | None = None) -> dict[str, float]:
    """For each language the score in the middle of those that part its held-out rows best, drawn towards the common
    one as if ``like`` rows spoke for that."""

    if not len(y) or y.min() == y.max():
        return {}
    counts = np.ones(len(y)) if counts is None else counts
    common, out, langs = parting(scores, y, counts), {}, np.array(langs, object)
    for lang in sorted(set(langs)):
        own = langs == lang
        n = min(counts[own & (y == 1)].sum(), counts[own & (y == 0)].sum())
        out[lang] = float((n * parting(scores[own], y[own], counts[own]) + like * common) / (n + like)) if n else common
    return out


def telling(met: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Twice the log likelihood ratio of each row's shares of the classes' texts being two rates instead of one."""
    n, total = texts[:, None].astype(float), texts.sum()

    def fit(k: np.ndarray, n: np.ndarray | float) -> np.ndarray:
        p = k / n
        return k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))

    return 2 * (fit(met, n).sum(axis=0) - fit(met.sum(axis=0), total))


def met_by(texts: list[str], y: np.ndarray, lexicon: Lexicon, out: np.ndarray) -> None:
    """Adds to ``out`` (class, row of the table) in how many texts of each class the row is."""
    for numbers, label in zip(lexicon.texts(texts), y):
        out[int(label), distinct(lexicon.rows[numbers].ravel(), lexicon.buckets)[0]] += 1


def class_weights(n: np.ndarray) -> np.ndarray:
    """What a row of each class counts, from the classes' numbers of rows."""
    return n.sum() / (2 * np.maximum(n, 1))


@dataclass
class Course:
    """A network of the rows that learn, with its Adagrad sums, on its way through the training texts."""

    net: Network
    memory: dict
    weights: np.ndarray
    rate: float = 0.1
    batch: int = 16
    drop: float = 0.2

    @classmethod
    def begin(cls, net: Network, learns: np.ndarray, weights: np.ndarray, **options) -> Course:
        small = replace(net, buckets=1 + int(learns.sum()), table=np.concatenate([net.table[:1], net.table[learns]]))
        return cls(small, {k: np.full_like(getattr(small, k), 1e-2) for k in ("table", *DENSE)}, weights, **options)

    def copy(self) -> Course:
        net = replace(self.net, **{k: np.array(getattr(self.net, k)) for k in ("table", *DENSE)})
        return replace(self, net=net, memory={k: np.array(v) for k, v in self.memory.items()})

    def learn(self, texts: list[np.ndarray], rows_of_word: np.ndarray, labels: np.ndarray, rng: np.random.Generator, touched: np.ndarray) -> None:
        """Takes the texts, by their words' numbers, in shuffled mini-batches."""
        order = rng.permutation(len(texts))
        for at in range(0, len(order), self.batch):
            some = order[at : at + self.batch]
            own = [texts[i] for i in some.tolist()]
            flat = np.concatenate(own)
            seen = np.split(np.where(rng.random(len(flat)) < self.drop, 0, flat), np.cumsum([len(t) for t in own])[:-1])
            y = labels[some].astype(float)
            _, grads = self.net.gradients(seen, rows_of_word, y, self.weights[y.astype(int)])
            rows, values = grads.pop("table")
            rows, values = rows[rows > 0], values[rows > 0]
            self.memory["table"][rows] += values * values
            self.net.table[rows] -= self.rate * values / np.sqrt(self.memory["table"][rows])
            touched[rows] += 1
            for name, grad in grads.items():
                self.memory[name] = self.memory[name] + grad * grad
                setattr(self.net, name, getattr(self.net, name) - self.rate * grad / np.sqrt(self.memory[name]))

    def dense(self) -> np.ndarray:
        """All values but the table's, and their sums."""
        return np.concatenate([np.ravel(v) for k in DENSE for v in (getattr(self.net, k), self.memory[k])]).astype(float)

    def set_dense(self, values: np.ndarray) -> None:
        at = 0
        for k in DENSE:
            old = getattr(self.net, k)
            size, kind = np.size(old), np.asarray(self.memory[k]).dtype
            setattr(self.net, k, values[at : at + size].reshape(np.shape(old)).astype(kind))
            self.memory[k] = values[at + size : at + 2 * size].reshape(np.shape(old)).astype(kind)
            at += 2 * size
        self.net.offset = float(self.net.offset)

    def held_bins(self, texts: list[np.ndarray], rows_of_word: np.ndarray) -> np.ndarray:
        """The texts' log odds, in steps."""
        words, own = own_words(np.concatenate(texts), rows_of_word)
        s = self.net.scores(np.split(words, np.cumsum([len(t) for t in texts])[:-1]), self.net.embedded(own) @ self.net.kernel)
        s = np.clip(s, 1e-15, 1 - 1e-15)
        return np.rint(STEP * (np.log(s) - np.log1p(-s))).astype(int)

    def finish(self, net: Network, learns: np.ndarray, held: list[tuple[str, int, int, int]], like: float = 20.0) -> Network:
        """The whole network, calibrated by the held-out rows: (language, label, step of the log odds, number of rows);
        null stands for all languages without both classes."""
        table = np.zeros_like(net.table)
        table[learns] = self.net.table[1:]
        net = replace(self.net, buckets=net.buckets, table=table)
        langs, y, bins, counts = (list(c) for c in zip(*held)) if held else ([], [], [], [])
        langs = ["\0" if x is None else x for x in langs]
        y, odds, counts = np.array(y, float), np.array(bins, float) / STEP, np.array(counts, float)
        n = min(counts[y == 1].sum(), counts[y == 0].sum())
        if n:
            cut = min(max(parting(1 / (1 + np.exp(-odds)), y, counts), 1e-6), 1 - 1e-6)
            shift = np.log(cut / (1 - cut)) * n / (n + like)
            net.offset = float(net.offset - shift)
            scores = 1 / (1 + np.exp(-(odds - shift)))
            net.common = parting(scores, y, counts)
            net.thresholds = thresholds(scores, y, langs, like, counts)
            net.thresholds.pop("\0", None)
        return net


def own_words(numbers: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text by numbers among its own words, and their rows, after those of number 0."""
    used, own = np.unique(np.append(numbers, 0), return_inverse=True)
    return own[:-1].astype(np.int32), rows[used]


def halves(x: np.ndarray) -> list[bytes]:
    """Whole numbers as their lower and their upper 16 bits, which compress better apart."""
    x = x.astype(np.uint32)
    return [x.astype(np.uint16).tobytes(), (x >> 16).astype(np.uint16).tobytes()]


def whole(data: bytes, n: int, at: int) -> np.ndarray:
    low, high = np.frombuffer(data, np.uint16, 2 * n, at).reshape(2, n).astype(np.int32)
    return low | high << 16


def packed(words: np.ndarray, own: np.ndarray) -> bytes:
    """Words by their numbers, and rows of words, in few bytes: which of these learn, those rows, and the numbers."""
    learn = own > 0
    sizes = np.array([len(own), learn.sum()], np.uint32)
    return zlib.compress(b"".join([sizes.tobytes(), np.packbits(learn, axis=1).tobytes(), *halves(own[learn]), *halves(words)]), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    k, n = np.frombuffer(data, np.uint32, 2).tolist()
    own = np.zeros((k, 1 + len(STEMS)), np.int32)
    learn = np.unpackbits(np.frombuffer(data, np.uint8, k, 8).reshape(k, 1), axis=1)[:, : own.shape[1]].astype(bool)
    own[learn] = whole(data, n, 8 + k)
    return whole(data, (len(data) - 8 - k - 4 * n) // 4, 8 + k + 4 * n), own


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list[int], list[str]]]:
    """(part, texts, rows of their words, labels, languages) of each chunk of ``coded`` rows, in their order."""
    its, texts, rows, labels, langs, base = None, [], [], [], [], 0
    for batch in batches:
        for part, first, anew, words, sizes, y, lang in zip(*(c.to_pylist() for c in batch.columns)):
            if first:
                if texts:
                    yield its, texts, np.concatenate(rows), labels, langs
                its, texts, rows, labels, langs = part, [], [np.zeros((1, 1 + len(STEMS)), np.int32)], [], []
            if anew:
                base = sum(map(len, rows)) - 1
            flat, own = unpacked(words)
            texts += np.split(np.where(flat == 0, 0, flat + base).astype(np.int32), np.cumsum(sizes)[:-1])
            rows.append(own)
            labels += y
            langs += lang
    if texts:
        yield its, texts, np.concatenate(rows), labels, langs


def train(texts: list[str], y: np.ndarray, langs: list[str], epochs: int = 8, held: float = 0.1, evidence: float = 3.84, like: float = 20.0, seed: int = 11, rate: float = 0.1, batch: int = 16, drop: float = 0.2, **shape) -> Network:
    """The fit of texts at hand, as one part."""
    net, rng = Network(**shape), np.random.default_rng(seed)
    net.start(seed)
    order, inner = rng.permutation(len(y)), np.zeros(len(y), bool)
    for label in (0, 1):  # of each class its part is held out
        own = order[y[order] == label]
        inner[own[: int(held * len(own))]] = True
    kept, met = np.flatnonzero(~inner), np.zeros((2, net.buckets))
    met_by([texts[i] for i in kept], y[kept], Lexicon(net.buckets), met)
    n = np.bincount(y[kept].astype(int), minlength=2)
    learns = telling(met, n) >= evidence
    learns[0] = False
    course = Course.begin(net, learns, class_weights(n), rate=rate, batch=batch, drop=drop)
    lexicon = Lexicon(net.buckets, np.cumsum(learns) * learns)
    texts = [compact(t) for t in lexicon.texts(texts)]
    touched = np.zeros(course.net.buckets)
    for _ in range(epochs):
        course.learn([texts[i] for i in kept.tolist()], lexicon.rows, y[kept], rng, touched)
    inner = np.flatnonzero(inner)
    bins = course.held_bins([texts[i] for i in inner], lexicon.rows) if len(inner) else []
    return course.finish(net, learns, [(langs[i], int(y[i]), int(b), 1) for i, b in zip(inner, bins)], like)


def counted(rows: DataFrame, buckets: int) -> DataFrame:
    """(row, y, n): in how many texts of each class each row of the table is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, lexicon = np.zeros((2, buckets), np.int64), Lexicon(buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                if len(lexicon) > 100_000:
                    lexicon = Lexicon(buckets)
                met_by(piece.column(0).to_pylist(), piece.column(1).to_numpy(), lexicon, met)
        label, row = np.nonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(label, pa.int32()), pa.array(met[label, row], pa.int64())], names=["row", "y", "n"])

    return rows.select("text", "y").mapInArrow(run, "row int, y int, n long").groupBy("row", "y").agg(F.sum("n").alias("n"))


def coded(rows: DataFrame, buckets: int, slots: np.ndarray, parts: int) -> DataFrame:
    """``rows`` dealt to their parts, held-out ones apart, in chunks of CHUNK texts: a row for each 500 of them or fewer.

    first and anew tell whether a chunk and a numbering of words begin; words are the texts' numbers and the rows of the words
    that are new in the numbering, ``packed``; sizes are the texts' lengths, y and lang theirs, one each.  The texts are
    exchanged as they are and numbered afterwards, through a chunk, so that a word which many of them share is written once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n, lexicon = None, 0, None
        for batch in batches:
            part, held = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            at, borders = 0, [*(np.flatnonzero((part[1:] != part[:-1]) | (held[1:] != held[:-1])) + 1).tolist(), batch.num_rows]
            for border in borders:
                while at < border:
                    first = (part[at], held[at]) != chunk or n == CHUNK
                    if first:
                        chunk, n = (part[at], held[at]), 0
                    anew = first or len(lexicon) > WORDS
                    if anew:
                        lexicon, known = Lexicon(buckets, shared.value), 1
                    piece = batch.slice(at, min(500, border - at, CHUNK - n))
                    texts = [compact(t) for t in lexicon.texts(piece.column(0).to_pylist())]
                    words = packed(np.concatenate(texts), lexicon.rows[known:])
                    y, lang = (piece.column(k).to_pylist() for k in (3, 4))
                    row = {"part": int(part[at]), "held": bool(held[at]), "first": first, "anew": anew, "words": words, "sizes": [len(t) for t in texts], "y": y, "lang": lang}
                    yield pa.RecordBatch.from_pylist([row], pa.schema(kinds))
                    known, n, at = len(lexicon.rows), n + len(texts), at + len(texts)

    ints = pa.list_(pa.int32())
    kinds = [("part", pa.int32()), ("held", pa.bool_()), ("first", pa.bool_()), ("anew", pa.bool_()), ("words", pa.binary()), ("sizes", ints), ("y", ints), ("lang", pa.list_(pa.string()))]
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    placed = rows.select("text", part, "held", "y", "lang", F.xxhash64("doc_id", F.lit(2)).alias("ord"), "doc_id").repartition(4 * parts, "part")
    made = placed.sortWithinPartitions("part", "held", "ord", "doc_id").select("text", "part", "held", "y", "lang")
    return made.mapInArrow(run, "part int, held boolean, first boolean, anew boolean, words binary, sizes array<int>, y array<int>, lang array<string>")


CODED = ["part", "first", "anew", "words", "sizes", "y", "lang"]  # what ``chunks`` reads


def epoch(rows: DataFrame, course: Course, seed: int) -> Course:
    """The course after every part's texts, taken by a task each from ``course`` on."""
    shared, dims = rows.sparkSession.sparkContext.broadcast(course), course.net.dims

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, part, mine, n = shared.value, None, None, 0

        def results() -> Iterator[tuple]:
            yield -1, part, (np.concatenate([[n], n * (mine.dense() - begun.dense())])).tobytes()
            for at in range(0, len(touched), SLOT):
                own = slice(at, at + SLOT)
                met = np.flatnonzero(touched[own])
                k = touched[own][met].astype(np.float32)
                change, sums = mine.net.table[own] - begun.net.table[own], mine.memory["table"][own] - begun.memory["table"][own]
                row = np.concatenate([met[:, None].astype(np.float32), k[:, None], change[met], sums[met]], axis=1)
                yield at // SLOT, part, np.clip(row, -6e4, 6e4).astype(np.float16).tobytes()  # exact for the places, up to SLOT

        def sent(found: Iterator[tuple]) -> pa.RecordBatch:
            columns = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["slot", "part", "change"])

        for its, texts, rows_of_word, labels, _ in chunks(batches):
            if its != part:
                if part is not None:
                    yield sent(results())
                part, mine, n, touched = its, begun.copy(), 0, np.zeros(begun.net.buckets)
            mine.learn(texts, rows_of_word, np.array(labels), np.random.default_rng([seed, part, n]), touched)
            n += len(texts)
        if part is not None:
            yield sent(results())

    def mean(table: pa.Table) -> pa.Table:
        slot, total = table.column("slot")[0].as_py(), 0
        for change in table.sort_by("part").column("change").to_pylist():  # summed in one order
            if slot < 0:
                total = total + np.frombuffer(change)
            else:
                some = np.frombuffer(change, np.float16).reshape(-1, 2 + 2 * dims).astype(float)
                total = np.zeros((SLOT, 1 + 2 * dims)) if np.isscalar(total) else total
                total[some[:, 0].astype(int)] += np.concatenate([some[:, 1:2], some[:, 1:2] * some[:, 2:]], axis=1)
        means = total[1:] / total[0] if slot < 0 else total[:, 1:] / np.maximum(total[:, :1], 1)
        return pa.table({"slot": pa.array([slot], pa.int32()), "part": pa.array([0], pa.int32()), "change": pa.array([means.tobytes()], pa.binary())})

    schema = "slot int, part int, change binary"
    found = rows.where("NOT held").select(CODED).mapInArrow(walk, schema).groupBy("slot").applyInArrow(mean, schema).collect()
    shared.unpersist()
    after = course.copy()
    for r in found:
        means = np.frombuffer(r.change)
        if r.slot < 0:
            after.set_dense(course.dense() + means)
        else:
            own = slice(r.slot * SLOT, (r.slot + 1) * SLOT)
            means = means.reshape(SLOT, -1)[: len(after.net.table[own])]
            after.net.table[own] += means[:, :dims].astype(np.float32)
            after.memory["table"][own] += means[:, dims:].astype(np.float32)
    return after


def held_counts(rows: DataFrame, course: Course) -> list[tuple[str, int, int, int]]:
    """(language, label, step of the log odds, number) of the held-out rows; languages without both classes are one, null."""
    shared = rows.sparkSession.sparkContext.broadcast(course)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, rows_of_word, labels, langs in chunks(batches):
            for at in range(0, len(texts), 500):
                own = slice(at, at + 500)
                bins = shared.value.held_bins(texts[own], rows_of_word)
                yield pa.RecordBatch.from_arrays([pa.array(langs[own], pa.string()), pa.array(labels[own], pa.int32()), pa.array(bins, pa.int32())], names=["lang", "y", "bin"])

    bins = rows.where("held").select(CODED).mapInArrow(run, "lang string, y int, bin int").groupBy("lang", "y", "bin").count()
    bins = settle(bins)
    both = bins.groupBy("lang").agg(F.countDistinct("y").alias("classes")).where("classes = 2").select("lang", F.lit(True).alias("both"))
    lang = F.when(F.col("both"), F.col("lang")).alias("lang")
    return [tuple(r) for r in bins.join(both, "lang", "left").groupBy(lang, "y", "bin").agg(F.sum("count")).orderBy("lang", "y", "bin").collect()]


def perhaps(rows: DataFrame, known: DataFrame, most: int = 1 << 26) -> DataFrame:
    """The ``rows`` whose doc_id is in ``known``, and a few others: a Bloom filter, so that the exchange of a join moves
    little else.  It has 16 bits an id, ``most`` in all, which only makes it let through more."""
    size = min(most, 1 << (16 * max(known.count(), 64) - 1).bit_length())
    places = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(size)) for k in range(3)]
    place = F.explode(F.array(*places)).alias("at")
    bits = known.select(place).groupBy((F.col("at") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits"))
    words = np.zeros(size // 32, np.uint32)
    for r in bits.collect():
        words[r.word] = r.bits
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(batch.num_columns - 1 - k).to_numpy() for k in range(3)]
            inside = np.logical_and.reduce([shared.value[x >> 5] >> (x & 31).astype(np.uint32) & 1 for x in at])
            found = pa.RecordBatch.from_arrays(batch.columns[:-3], names=batch.schema.names[:-3])
            yield found.filter(pa.array(inside.astype(bool)))

    return rows.select("*", *(p.alias(f"__{k}") for k, p in enumerate(places))).mapInArrow(run, rows.schema)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, y) of the labelled rows outside fold 0 of 5, one row per id."""
    known = labels.where(F.col("toxic").isNotNull() & (fold("doc_id", 5) != 0) & F.col("doc_id").isNotNull())
    known = settle(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y")))
    texts = docs.where(F.col("text").isNotNull() & (fold("doc_id", 5) != 0) & F.col("doc_id").isNotNull())
    texts = perhaps(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang")), known)
    own = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "lang")).alias("own")
    texts = texts.groupBy("doc_id").agg(own)  # of an id's texts one is left before the exchange
    return texts.join(known, "doc_id").select("doc_id", "own.text", "own.lang", "y")


def fit(docs: DataFrame, labels: DataFrame, epochs: int = 8, held: float = 0.1, evidence: float = 3.84, like: float = 20.0, seed: int = 11, rate: float = 0.1, batch: int = 16, drop: float = 0.2, **shape) -> Network:
    """Learns from all labelled rows outside fold 0 of 5.

    A doc_id with several labels counts as toxic if one says so, and one with several texts teaches the one with the
    smallest hash.  Null ids and labels and null texts are left out.  Without rows of both classes nothing is learned
    and every score is zero.  A class of fewer than ten rows holds none out.
    """
    rows, net = stored(labelled(docs, labels), compression="zstd"), Network(**shape)
    n = dict(rows.groupBy("y").count().collect())
    if not (n.get(0) and n.get(1)):
        return Network()
    large = [label for label in (0, 1) if n[label] >= 10]
    inner = F.col("y").isin(large) & (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1000)) < round(1000 * held))
    rows = rows.withColumn("held", inner)
    kept = dict(rows.where("NOT held").groupBy("y").count().collect())
    if len(kept) < 2:
        rows, kept = rows.withColumn("held", F.lit(False)), n
    kept = np.array([kept[0], kept[1]])
    met = np.zeros((2, net.buckets))
    for r in counted(rows.where("NOT held"), net.buckets).collect():
        met[r.y, r.row] = r.n
    learns = telling(met, kept) >= evidence
    learns[0] = False
    net.start(seed)
    course = Course.begin(net, learns, class_weights(kept), rate=rate, batch=batch, drop=drop)
    texts = settle(coded(rows, net.buckets, (np.cumsum(learns) * learns).astype(np.int32), min(PARTS, -(-int(kept.sum()) // PART))))
    for number in range(epochs):
        course = epoch(texts, course, seed + 1000 * number)
    return course.finish(net, learns, held_counts(texts, course), like)


def score(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, threshold, flagged) of every row; null texts are scored as empty.

    threshold is the calibrated one of the row's language, the common one for others; predicted is by ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        learned = np.where(model.table.any(axis=1), np.arange(model.buckets), 0) if model.table is not None else None
        lexicon = Lexicon(model.buckets, learned)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                if len(lexicon) > 100_000:
                    lexicon = Lexicon(model.buckets, learned)
                s = np.asarray(model.score(piece.column(1).to_pylist(), lexicon), float)
                own = np.array([model.thresholds.get(x or "", model.common) for x in piece.column(2).to_pylist()], float)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array(own, pa.float64()), pa.array(s >= own)],
                    names=["doc_id", "score", "predicted", "threshold", "flagged"],
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return chosen.mapInArrow(run, "doc_id long, score double, predicted int, threshold double, flagged boolean")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged), a row per row of ``docs``; extra columns are ignored.

    Null texts are scored as empty ones, repeated rows each, long texts whole; an empty table gives no rows."""
    return score(docs, fit(docs, labels, **options)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "threshold", "flagged")
