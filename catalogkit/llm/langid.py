"""Language identification by the nearest of several clustered centroids per language.

A text becomes the TF-IDF vector of its hashed byte n-grams (sublinear counts, unit length).  For each
language the vectors of a bounded sample of labelled rows are clustered by spherical k-means; a text
takes the language of the centroid with the greatest cosine.  It is rejected when that cosine is below
the floor for its variety, the number of its distinct n-grams: longer texts of a language lie closer to its
centroids, and random letters of the same length do not.  Floors are low quantiles of the cosines of
training texts to centroids fitted without them.

The fit reads a bounded sample of the labelled rows of each language, so that a language is learned however
rare it is; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogkit.llm.common import fold, settle

UNKNOWN = "und"
_LETTERS_ONLY = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngram_counts(text: str, buckets: int, block: int = 1 << 20) -> np.ndarray:
    """Counts of the 1- to 4-byte grams of the text's lower-cased letters, hashed to ``buckets``.

    A long text is counted in blocks of ``block`` grams, so that memory grows with the text's bytes alone.
    """
    raw = text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY)
    raw = np.frombuffer(b" " + b" ".join(raw.split()) + b" ", np.uint8)
    total = np.zeros(buckets, np.int64)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    for at in range(0, len(raw), block):
        codes = raw[at : at + block + 3].astype(np.uint64)
        gram = codes
        for n in range(1, 5):
            if n > 1:
                if len(codes) < n:
                    break
                gram = (gram[:-1] << np.uint64(8)) | codes[n - 1 :]
            own = gram[:block]  # a gram belongs to the block it starts in
            total += np.bincount(((own + np.uint64(n << 40)) * _PRIME >> shift).astype(np.int64), minlength=buckets)
    return total


def variety_bin(variety: np.ndarray) -> np.ndarray:
    """Half octaves of the number of distinct n-grams."""
    return np.floor(2 * np.log2(np.maximum(variety, 1))).astype(int)


@dataclass
class Centroids:
    buckets: int
    idf: np.ndarray
    matrix: np.ndarray  # one unit row per centroid
    langs: list[str]  # of each row
    floors: dict[str, np.ndarray]  # of each language, by variety_bin

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, and the number of distinct n-grams."""
        out, variety = np.zeros((len(texts), self.buckets), np.float32), np.zeros(len(texts), int)
        for at in range(0, len(texts), 256):
            counts = np.stack([ngram_counts(t, self.buckets) for t in texts[at : at + 256]])
            rows = np.log1p(counts) * self.idf
            out[at : at + 256] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            variety[at : at + 256] = (counts > 0).sum(axis=1)
        return out, variety

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """The language, score and rejection of each text."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        vectors, variety = self.measure(texts)
        cosine = vectors @ self.matrix.T
        langs = [self.langs[i] for i in cosine.argmax(axis=1).tolist()]
        scores = np.clip(cosine.max(axis=1), 0, 1).astype(float)
        floors = np.array([self.floors[x][b] for x, b in zip(langs, variety_bin(variety).tolist())])
        return langs, scores.tolist(), (scores < floors).tolist()


def _cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start."""
    centers = [rows.mean(axis=0)]
    for _ in range(min(k, len(rows)) - 1):
        centers.append(rows[np.argmin(np.max(rows @ np.stack(centers).T, axis=1))])
    centers = np.stack(centers)
    for _ in range(rounds):
        nearest = np.argmax(rows @ centers.T, axis=1)
        centers = np.stack([rows[nearest == i].mean(axis=0) if (nearest == i).any() else centers[i] for i in range(len(centers))])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def _held_out(rows: np.ndarray, clusters: int, folds: int = 3) -> np.ndarray:
    """Each row's greatest cosine to centroids of the other folds; needs two rows."""
    part, out = np.arange(len(rows)) % min(folds, len(rows)), np.zeros(len(rows))
    for i in np.unique(part):
        out[part == i] = np.max(rows[part == i] @ _cluster(rows[part != i], clusters).T, axis=1)
    return out


def _floors(cosines: dict[str, np.ndarray], varieties: dict[str, np.ndarray], counts: dict[str, int], buckets: int, low: float = 0.003, margin: float = 0.95, enough: int = 50) -> dict[str, np.ndarray]:
    """Each language's floor by bin: the common one of all held-out rows, lower for a language of few rows and
    where the language's own rows lie lower."""
    top = int(variety_bin(np.array([buckets]))[0]) + 1
    known = [x for x in cosines if len(cosines[x]) >= enough] or list(cosines)
    if not known:
        return {x: np.full(top, 0.02) for x in counts}
    cosine, bins = np.concatenate([cosines[x] for x in known]), variety_bin(np.concatenate([varieties[x] for x in known]))
    common = np.zeros(top)
    for i in range(top):
        near = bins == i
        for lower in range(i - 1, -1, -1):  # shorter texts lie lower, so that they only loosen the floor
            if near.sum() >= enough:
                break
            near |= bins == lower
        common[i] = margin * np.quantile(cosine[near], low) if near.any() else 0.0
    out = {}
    for x, n in counts.items():
        own = cosines.get(x, np.empty(0))
        lower = min(1.0, float(np.quantile(own / np.maximum(common[variety_bin(varieties[x])], 0.02), low))) if len(own) else 1.0
        out[x] = np.maximum(0.02, common * min(lower, 0.5 + 0.5 * n / (n + 50)))
    return out


def sample(labelled: DataFrame, sample_rows: int, longest: int, least: int = 200, most_long: int = 50, most_langs: int = 500) -> DataFrame:
    """(doc_id, lang, text): for each language its rows with the smallest id hashes, one per id.

    Up to ``sample_rows`` rows of a language; with more than four languages they share 4 ``sample_rows``, but
    have ``least`` each.  Texts over ``longest`` characters come after all others, at most ``most_long``.  A column of more than
    ``most_langs`` languages teaches those with the most ids, ties to the smaller name.

    Hashes are cut to a little over the wanted number before they are ranked, so that no task ranks all ids of a language,
    and what comes to the driver has a bound that the parameters set.
    """
    usable = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike("\\p{L}"))
    own = F.struct((F.length("text") > longest).alias("long"), F.xxhash64("text").alias("hash"))
    ids = settle(usable.groupBy("lang", "doc_id").agg(F.min(own).alias("own")).select("lang", "doc_id", "own.*"))
    sizes = ids.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("over"))
    known = sizes.orderBy(F.desc(F.col("short") + F.col("over")), "lang").limit(most_langs).collect()
    share = min(sample_rows, max(least, 4 * sample_rows // max(1, len(known))))
    limits = [(r.lang, long, _cut(n, most)) for r in known for long, n, most in ((False, r.short, share), (True, r.over, most_long))]
    types = dict(labelled.select("lang", "doc_id").dtypes)
    spark = labelled.sparkSession
    near = ids.join(F.broadcast(spark.createDataFrame(limits, f"lang {types['lang']}, long boolean, most long")), ["lang", "long"]).where(F.xxhash64("doc_id") <= F.col("most"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id"))
    first = near.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("long"), min(share, most_long)).otherwise(share))
    chosen = [(r.lang, r.doc_id, r.hash) for r in first.collect()]
    wanted = spark.createDataFrame(chosen, f"lang {types['lang']}, doc_id {types['doc_id']}, hash long")
    found = usable.select("doc_id", "lang", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(wanted), ["lang", "doc_id", "hash"])
    return found.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def _cut(n: int, most: int) -> int:
    """A hash below which about 4 ``most`` and 400 of ``n`` even hashes lie: ``most`` of them for certain, but for a chance
    of less than 1e-80."""
    return 2**63 - 1 if n <= 4 * most + 400 else -(2**63) + 2**64 * (4 * most + 400) // n


def fit(labelled: DataFrame, sample_rows: int = 3000, longest: int = 20_000, clusters: int = 4, buckets: int = 4096) -> Centroids:
    """Learns centroids from rows (doc_id, text, lang); null ids and languages, null and letterless texts are left out."""
    rows = sorted((r for r in sample(labelled, sample_rows, longest).collect() if has_letter(r.text)), key=lambda r: (r.doc_id, r.lang, r.text))
    model = Centroids(buckets, np.ones(buckets), np.zeros((0, buckets), np.float32), [], {})
    if not rows:
        return model
    seen = np.zeros(buckets)
    for r in rows:
        seen += ngram_counts(r.text, buckets) > 0
    model.idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    parts, cosines, varieties, counts = [], {}, {}, {}
    for lang in sorted({r.lang for r in rows}):
        own, variety = model.measure([r.text for r in rows if r.lang == lang])
        centers = _cluster(own, clusters).astype(np.float32)
        parts.append(centers)
        model.langs += [lang] * len(centers)
        counts[lang] = len(own)
        if len(own) > 1:
            cosines[lang], varieties[lang] = _held_out(own, clusters), variety
    model.floors = _floors(cosines, varieties, counts, buckets)
    model.matrix = np.concatenate(parts)
    return model


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """Adds lang_pred, score and rejected to (doc_id, text).

    Null texts and texts without a letter get ``und``, score 0 and are rejected; without any learned
    language so does every text.  Extra columns are ignored; repeated rows keep a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts = piece.column(1).to_pylist()
                spoken = [i for i, t in enumerate(texts) if has_letter(t)]
                langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if spoken:
                    for i, *found in zip(spoken, *m.predict([texts[i] for i in spoken])):
                        langs[i], scores[i], rejected[i] = found
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_spoken(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns as they are, whatever their names and types.

    Null, empty and letterless texts go, repeated rows stay or go each, long texts are read whole; of an empty table
    nothing stays, nor of any where nothing could be learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(place).slice(at, 256).to_pylist()
                spoken = [t for t in texts if has_letter(t)]
                rejected = iter(m.predict(spoken)[2]) if spoken else iter(())
                keep += [has_letter(t) and not next(rejected) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learned from the folds crc32(doc_id) mod 4 <> 2.

    A row per row of ``docs``; what of nulls and empty tables is as in ``predict``."""
    held_out = fold("doc_id", 4) == 2
    model = fit(docs.where(~held_out), **options)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
