"""Search of a stated query set against all vectors of a paged index, best pages first.

Equal vectors are one entry.  The entries are dealt to the nearest of a bounded sample of global pivots; a cell
that holds more than a page is split by a hash.  Each page holds an index of its own, built once and kept as one
binary value, beside the page's centre, covering radius and largest norm, so that the index is a table of pages.

With c the centre, r the radius and m the largest norm of a page, no inner product of a query q with its vectors is
above q.c + |q| r, nor above (|q|^2 + m^2 - max(0, |q - c| - r)^2) / 2.  A query visits its pages in the order of
these bounds, in a few rounds that carry its k-th best score: pages whose bound lies below it are never
visited.  The queries of a page are dealt into blocks of bounded size, and every visit is a task's work; only the best
``k`` per query and visit leave it.

The pages' bounds are read in slices of at most about SLICE pages, so that what a task holds of them is bounded.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogkit.llm.common import sample_by_hash, settle

MOST_TASKS = 20_000  # of one round; beyond it a task takes several visits in turn
MOST_PIVOTS = 1024
MOST_PAGE = 4096
SLICE = 4096
ROUNDS = (1, 8)  # pages that a query has met after the first rounds; another round takes all that are left
SLACK = 1e-9  # relative room for rounding in the bounds, which are not exact
APART = -1, -2  # cells of vectors without a pivot of their length, and of those set apart by ``wild``

#: what a visit gives: query_id, vec_id and score of rows that hold the k best of the page, and how many entries were scored for each query
Visit = Callable[[object, np.ndarray, np.ndarray, int, np.ndarray], tuple[list, np.ndarray]]


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", drop_zero: bool = False) -> DataFrame:
    """(vec_id long, v array<double>) of the rows whose vector is not null or empty and has only finite components."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull())
    rows = rows.where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.where(F.exists("v", lambda x: x != 0)) if drop_zero else rows


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(v, vec_id array<long>): each distinct vector of (vec_id, v) with the smallest of its ids, in order.

    A query leaves out its own id, however often it repeats, so ``k`` rows of an id and 2 ``k`` rows of
    a vector are all that can be among any query's ``k`` best.
    """
    own, alike = Window.partitionBy("v", "vec_id").orderBy("vec_id"), Window.partitionBy("v").orderBy("vec_id")
    rows = rows.withColumn("n", F.row_number().over(own)).where(F.col("n") <= k)
    rows = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= 2 * k)
    return rows.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_id"))


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of the vectors in a batch."""
    sizes = np.diff(np.asarray(column.offsets))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.asarray(column.take(pa.array(at)).flatten()).reshape(len(at), n)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


def page_size(n: int) -> int:
    """Entries of a page for ``n`` entries in all: pages and their sizes grow together, up to MOST_PAGE."""
    return max(1, min(MOST_PAGE, math.ceil(8 * math.sqrt(n))))


def build(rows: DataFrame, index_of: Callable[[list, np.ndarray, bool], object], page_rows: int | None, k: int, prepare: Callable[[np.ndarray], np.ndarray] | None = None, wild: float = np.inf) -> DataFrame:
    """(dims, page, n, center, radius, top, blob): an index for each page of at most about ``page_rows`` entries
    (``page_size`` of their number, if not given).

    ``prepare`` changes the vectors (to integers, say) before anything is measured; those with a norm of ``wild`` or more
    get pages of their own, without bounds.  ``index_of`` gets each entry's ids, the vectors, and whether they are wild.
    """
    distinct = settle(entries(rows, k))
    n = distinct.count()
    page_rows = page_rows or page_size(n)
    pivots = min(MOST_PIVOTS, -(-n // page_rows))
    chosen: dict[int, list] = {}
    for r in sample_by_hash(distinct.select("v"), "v", pivots).collect():
        chosen.setdefault(len(r.v), []).append(r.v)
    ready = prepare or (lambda x: x)
    known = distinct.sparkSession.sparkContext.broadcast({n: ready(np.array(v)) for n, v in chosen.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column(0)):
                x = ready(x)
                own, norm = known.value.get(x.shape[1]), np.sqrt((x * x).sum(axis=1))
                cell = np.full(len(x), APART[0])
                if own is not None:
                    cell = ((own * own).sum(axis=1) / 2 - x @ own.T).argmin(axis=1)
                cell[~(norm < wild)] = APART[1]
                size = pa.array(np.full(len(x), x.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([lists(x, pa.float64()), batch.column(1).take(pa.array(at)), size, pa.array(cell, pa.int32())], names=["v", "vec_id", "dims", "cell"])

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        x, apart = np.array(frame.v.tolist(), float), frame.cell.iloc[0] == APART[1]
        order = np.lexsort(x.T[::-1])
        x, ids = x[order], [frame.vec_id.iloc[i] for i in order.tolist()]
        center = np.zeros(x.shape[1]) if apart else x.mean(axis=0)
        radius, top = (np.inf, np.inf) if apart else (np.sqrt(((x - center) ** 2).sum(axis=1).max()), np.sqrt((x * x).sum(axis=1).max()))
        page = "{}:{}:{}".format(*frame[["dims", "cell", "part"]].iloc[0])
        return pd.DataFrame({"dims": [frame.dims.iloc[0]], "page": page, "n": len(x), "center": [center], "radius": radius, "top": top, "blob": pickle.dumps(index_of(ids, x, bool(apart)))})

    placed = settle(distinct.mapInArrow(place, "v array<double>, vec_id array<long>, dims int, cell int"))
    parts = placed.groupBy("dims", "cell").agg(F.ceil(F.count("*") / page_rows).cast("int").alias("parts"))
    paged = placed.join(parts, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    return settle(paged.groupBy("dims", "cell", "part").applyInPandas(pack, "dims int, page string, n long, center array<double>, radius double, top double, blob binary"))


def bounds(queries: np.ndarray, center: np.ndarray, radius: np.ndarray, top: np.ndarray, wild: float = np.inf) -> np.ndarray:
    """(query, page): no inner product of the query with a vector of the page is larger."""
    with np.errstate(all="ignore"):
        q2, c2 = (queries * queries).sum(axis=1)[:, None], (center * center).sum(axis=1)
        dot, norm = queries @ center.T, np.sqrt(q2)
        away = np.sqrt(np.maximum(q2 + c2 - 2 * dot, 0))
        bound = np.minimum(dot + norm * radius, (q2 + top * top - np.maximum(away - radius, 0) ** 2) / 2)
        bound += SLACK * (q2 + top * top) + 1e-9
    bound[(norm[:, 0] >= wild) | ~np.isfinite(norm[:, 0])] = np.inf
    bound[:, ~np.isfinite(top)] = np.inf
    return np.where(np.isnan(bound), np.inf, bound)


def search(index: DataFrame, queries: DataFrame, visit: Visit, k: int, score_type: str, prepare: Callable[[np.ndarray], np.ndarray] | None = None, wild: float = np.inf, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score, pages_visited, entries_scored): each query's ``k`` best rows by (score desc, vec_id).

    A query id that repeats is searched once, with the smallest of its vectors.  Queries meet pages of their own
    vector length only.
    """
    ready = prepare or (lambda x: x)
    asked = settle(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-asked.count() // block_rows))
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")
    state = asked.select(F.col("vec_id").alias("query_id"), block.alias("block"), "v", F.lit(float("-inf")).alias("kth"))
    slices = max(1, -(-index.count() // SLICE))
    context = index.sparkSession.sparkContext
    best = None

    def met(pages: DataFrame, state: DataFrame, first: int, end: int | None) -> DataFrame:
        """(page, block, query_id, v, kth): the pages from place ``first`` to ``end`` of each query's order."""
        own: dict[int, list] = {}
        for r in pages.select("dims", "page", "center", "radius", "top").collect():
            own.setdefault(r.dims, []).append(r)
        known = {n: ([r.page for r in rows], *(np.array([r[c] for r in rows], float) for c in ("center", "radius", "top"))) for n, rows in own.items()}
        directory = context.broadcast(known)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, group, kth = (np.asarray(batch.column(c)) for c in ("query_id", "block", "kth"))
                for at, q in by_length(batch.column("v")):
                    if q.shape[1] not in directory.value:
                        continue
                    names, *shape = directory.value[q.shape[1]]
                    for lo in range(0, len(at), 256):
                        here, q_here = at[lo : lo + 256], ready(q[lo : lo + 256])
                        bound = bounds(q_here, *shape, wild)
                        order = np.argsort(-bound, axis=1, kind="stable")[:, first:end]
                        row, place = np.nonzero(np.take_along_axis(bound, order, axis=1) >= kth[here][:, None])
                        chosen = here[row]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([names[i] for i in order[row, place].tolist()], pa.string()), pa.array(group[chosen]), pa.array(ids[chosen]), lists(q_here[row], pa.float64()), pa.array(kth[chosen])],
                            names=["page", "block", "query_id", "v", "kth"],
                        )

        return state.mapInArrow(pick, "page string, block int, query_id long, v array<double>, kth double")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        here = frame.blob.notna()
        own = pickle.loads(frame.blob[here].iloc[0])
        ask = frame[~here].sort_values("query_id")
        ids = ask.query_id.to_numpy(np.int64)
        rows, scored = visit(own, ids, np.array(ask.v.tolist(), float), k, ask.kth.to_numpy(float))
        n, m = len(rows), len(ids)  # after the rows found, one without vec_id counts each query's visit
        asked_by, found, score = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame({
            "query_id": np.concatenate([np.array(asked_by, np.int64), ids]), "vec_id": pd.array([*found, *[None] * m], "Int64"),
            "score": pd.array([*score, *[None] * m], "Int64" if score_type == "long" else "Float64"), "entries": np.concatenate([np.zeros(n, np.int64), scored]),
        })

    for s in range(slices):
        pages = index.where(F.pmod(F.xxhash64("page"), F.lit(slices)) == s) if slices > 1 else index
        most = pages.count()
        ends = [e for e in ROUNDS if e < most] + [None]
        for first, end in zip([0, *ends], ends):
            chosen = met(pages, state, first, end)
            groups = settle(chosen.select("page", "block").distinct())
            blobs = pages.select("page", "blob").join(groups, "page")
            sent = chosen.select("page", "block", "query_id", "v", "kth", F.lit(None).cast("binary").alias("blob"))
            there = blobs.select("page", "block", *[F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("v", "array<double>"), ("kth", "double"))], "blob")
            # a few rows hold much work here: their number, not their bytes, sets the number of tasks
            visits = max(1, min(MOST_TASKS, groups.count()))
            found = sent.union(there).repartition(visits, "page", "block").groupBy("page", "block").applyInPandas(run, f"query_id long, vec_id long, score {score_type}, entries long")
            found = settle(found)
            seen = found.where("vec_id IS NULL").groupBy("query_id").agg(F.count("*").alias("pages_visited"), F.sum("entries").alias("entries_scored"))
            rows = found.where("vec_id IS NOT NULL").select("query_id", "vec_id", "score")
            if best is not None:
                rows = rows.unionByName(best.select("query_id", "vec_id", "score"))
                seen = seen.unionByName(best.select("query_id", "pages_visited", "entries_scored").distinct()).groupBy("query_id").agg(F.sum("pages_visited").alias("pages_visited"), F.sum("entries_scored").alias("entries_scored"))
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            best = settle(ranked.join(seen, "query_id").select("query_id", "rank", "vec_id", "score", "pages_visited", "entries_scored"))
            if end is not None or s + 1 < slices:
                kth = best.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("new"))
                state = settle(state.join(kth, "query_id", "left").select("query_id", "block", "v", F.coalesce("new", "kth").alias("kth")))
    return best
