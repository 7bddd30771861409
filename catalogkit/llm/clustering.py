"""Centroid clustering in whole numbers, with centroids left out by a PCA-rotated bound.

Vectors become whole numbers.  A rotation, the principal axes of a bounded sample, turns them so that a few leading
coordinates hold most of their spread; each row keeps these coordinates and the norm of the rest.  For a row x and a
centroid c, |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2 is at most |x - c|^2, because rotations keep distances and the
rests differ by no less than their norms do.  The centroid with the smallest bound is verified first, in whole numbers;
then those whose bound does not exceed that distance.  So the rotation decides how much is verified, never a result.

The prepared rows are one table, written once.  A round reads it, and only the sums of each task and cluster leave the
tasks; the driver holds the centroids, ``clusters`` rows of ``dims`` numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.llm.common import sample_by_hash, settle

SLACK = 1e-5  # relative room for the rounding of the stored coordinates, which are no exact values
FAR = 2**62  # components end here
NEAR = 2**27  # between vectors of smaller components, squared distances of up to 128 dimensions fit a long
LONG = 2**63 - 1
COUNT, COST, TAKEN = -1, -2, -3


@dataclass
class Rotation:
    """Leading principal axes around a middle."""

    middle: np.ndarray
    axes: np.ndarray  # dims x leading

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leading coordinates and the norm of the rest."""
        y = x.astype(float) - self.middle
        lead = y @ self.axes
        return lead, np.sqrt(np.maximum((y * y).sum(axis=1) - (lead * lead).sum(axis=1), 0))


def rotation(x: np.ndarray, leading: int) -> Rotation:
    """The axes along which the sample ``x`` spreads most."""
    x = x.astype(float)
    middle = x.mean(axis=0)
    scale = max(1.0, float(np.abs(x - middle).max(initial=0)))  # no overflow of squares
    _, axes = np.linalg.eigh(np.cov((x - middle) / scale, rowvar=False) if len(x) > 1 else np.eye(x.shape[1]))
    return Rotation(middle, axes[:, ::-1][:, :leading])


def packed(rows: np.ndarray) -> pa.Array:
    """One binary value for each row."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def quantised(x: np.ndarray, steps: int) -> np.ndarray:
    """floor(steps * x) as longs; what lies beyond FAR stays there."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(steps * x), -float(FAR), float(FAR)).astype(np.int64)


def usable(vectors: DataFrame, dims: int, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows with exactly ``dims`` components, none null or non-finite."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == dims)
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def prepare(rows: DataFrame, turn: Rotation, steps: int) -> DataFrame:
    """(vec_id, q, lead, rest): whole components (32 bits each, or 64 where one needs it), leading coordinates, rest's norm."""
    shared = rows.sparkSession.sparkContext.broadcast(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            q = quantised(x, steps)
            near = (np.abs(q) < NEAR).all(axis=1)
            lead, rest = shared.value.apply(q)
            for at, kind in ((np.flatnonzero(near), np.int32), (np.flatnonzero(~near), np.int64)):
                if len(at):
                    chosen = [batch.column(0).take(pa.array(at)), packed(q[at].astype(kind)), packed(lead[at].astype(np.float32)), pa.array(rest[at])]
                    yield pa.RecordBatch.from_arrays(chosen, names=["vec_id", "q", "lead", "rest"])

    return rows.mapInArrow(run, "vec_id long, q binary, lead binary, rest double")


def bounds(lead: np.ndarray, rest: np.ndarray, own_lead: np.ndarray, own_rest: np.ndarray, away: float = 0.0) -> np.ndarray:
    """(row, centroid): no squared distance is smaller.  ``away`` is the squared norm of the rotation's middle, whose
    subtraction rounds too."""
    l2, c2 = (lead * lead).sum(axis=1)[:, None], (own_lead * own_lead).sum(axis=1)
    gap = l2 + c2 - 2 * lead @ own_lead.T + (rest[:, None] - own_rest) ** 2
    return gap - SLACK * (l2 + c2 + rest[:, None] ** 2 + own_rest**2) - 1e-22 * away - 1


def squared(q: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = q - centroid
    return (gap * gap).sum(axis=1)


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid, ties to the smaller number, its squared distance, and how many distances were taken.

    ``q`` holds longs, or whole numbers of any size as objects; these are also taken where a centroid needs them.
    """
    if np.abs(centroids).max() >= NEAR:
        q = q.astype(object)
    centroids = centroids.astype(q.dtype)
    low = bounds(lead.astype(float), rest, *turn.apply(centroids), float(turn.middle @ turn.middle))
    best = low.argmin(axis=1)
    first, value, taken = best.copy(), np.zeros(len(q), q.dtype), len(q)
    for j in np.unique(first).tolist():
        own = first == j
        value[own] = squared(q[own], centroids[j])
    for j, c in enumerate(centroids):
        rows = np.flatnonzero((low[:, j] <= value.astype(float)) & (first != j))
        if len(rows):
            d = squared(q[rows], c)
            taken += len(rows)
            nearer = (d < value[rows]) | ((d == value[rows]) & (j < best[rows]))
            best[rows[nearer]], value[rows[nearer]] = j, d[nearer]
    return best, value, taken


def chunks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, q, lead, rest) of a prepared batch: the rows of ordinary size, then those of wide components."""
    sizes = pc.binary_length(batch.column("q")).to_numpy()
    for kind, own in ((np.int32, np.int64), (np.int64, object)):
        at = np.flatnonzero(sizes == np.dtype(kind).itemsize * dims)
        if len(at):
            rows = batch.take(pa.array(at))
            lead = rows.column("lead")
            yield rows, unpacked(rows.column("q"), kind, dims).astype(own), unpacked(lead, np.float32, len(lead[0].as_py()) // 4), rows.column("rest").to_numpy()


def totals(prepared: DataFrame, centroids: np.ndarray, turn: Rotation) -> dict[int, dict[int, int]]:
    """cluster -> {place: sum of the component there, COUNT: rows, COST: sum of squared distances, TAKEN: distances taken}."""
    shared = prepared.sparkSession.sparkContext.broadcast((centroids, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middles, own_turn = shared.value
        k, dims = middles.shape
        sums = np.zeros((k, dims + 3), object)
        for batch in batches:
            for _, q, lead, rest in chunks(batch, dims):
                best, value, taken = nearest(q, lead, rest, middles, own_turn)
                sums[best[0], dims + 2] += taken
                for j in np.unique(best).tolist():
                    own = best == j
                    sums[j, :dims] += q[own].sum(axis=0).astype(object)
                    sums[j, dims] += int(own.sum())
                    sums[j, dims + 1] += sum(value[own].tolist())
        cluster, place = np.nonzero(sums)
        names = np.concatenate([np.arange(dims), [COUNT, COST, TAKEN]])
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(names[place], pa.int32()), pa.array([str(x) for x in sums[cluster, place]], pa.string())], names=["cluster", "place", "total"])

    parts = prepared.mapInArrow(run, "cluster int, place int, total string")
    out: dict[int, dict[int, int]] = {j: {} for j in range(len(centroids))}
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.cluster][r.place] = int(r.total)
    return out


def moved(centroids: np.ndarray, found: dict[int, dict[int, int]]) -> np.ndarray:
    """The floors of the clusters' means; a cluster without rows keeps its centroid."""
    return np.array([[found[j].get(i, 0) // found[j][COUNT] for i in range(len(c))] if found[j].get(COUNT) else c.tolist() for j, c in enumerate(centroids)], np.int64)


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, steps: int = 1024, dims: int = 64, seed: int = 3, leading: int = 16, sample_rows: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with exactly ``dims``
    components, none null or non-finite; each component x counts as floor(steps * x).

    Centroids start as the ``clusters`` vectors with the smallest sha256 of ``seed:vec_id``; each of ``rounds`` rounds
    assigns every vector to the nearest, ties to the smaller number, and moves centroids to the floors of their means.
    Equal hashes start in the order of their vectors.  Rows that repeat an id or a vector take part each; rows without
    an id take part but start no centroid while others can.  With fewer vectors than ``clusters`` there are fewer
    centroids, and an empty table gives no rows.  Components beyond 2^62 count as 2^62, and distances and inertias
    beyond the range of a long stay at its end; assignments are exact.  Extra columns are ignored, whatever their names.

    The rotation comes from at most ``sample_rows`` rows, those with the smallest id hashes; it has no part in the result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, dims, id_column, vector_column)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = rows.select("v", mark.alias("mark")).orderBy(F.asc_nulls_last("mark"), "v").limit(clusters).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = quantised(np.array([r.v for r in starts]), steps)
    thin = max(1, rows.count() // (4 * sample_rows))  # hashes are thinned before they are sorted, so that no task sends a sample of its own
    few = sample_by_hash(rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(thin)) == 0), "vec_id", sample_rows).collect()
    turn = rotation(quantised(np.array([r.v for r in few or starts]), steps), leading)
    prepared = settle(prepare(rows, turn, steps))
    for _ in range(rounds):
        centroids = moved(centroids, totals(prepared, centroids, turn))
    last = totals(prepared, centroids, turn)
    cost = [last[j].get(COST, 0) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    shared = spark.sparkContext.broadcast((centroids, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middles, own_turn = shared.value
        for batch in batches:
            for own, q, lead, rest in chunks(batch, middles.shape[1]):
                best, value, _ = nearest(q, lead, rest, middles, own_turn)
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), pa.array(best, pa.int32()), pa.array([min(d, LONG) for d in value.tolist()], pa.int64())], names=["vec_id", "cluster", "distance"])

    facts = spark.createDataFrame([(j, min(c, LONG), min(sum(cost), LONG), n) for j, (c, n) in enumerate(zip(cost, names))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = prepared.mapInArrow(run, "vec_id long, cluster int, distance long")
    # a row for each centroid
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
