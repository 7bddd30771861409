"""Approximate nearest neighbours by a permutation index.

Each page of vectors draws pivots from its own.  The vectors are lifted to one common norm (a last component makes up
what is missing), so that inner products order like closeness.  Each is represented by the order of its ``prefix``
nearest pivots and posted, with the place, in those pivots' inverted files.  The induced footrule distance of two
prefixes is a constant less twice the sum of (prefix - larger place) over shared pivots, so adding up postings ranks
a page's vectors by footrule; the best ``share`` of them (k + 1 at least), and all that tie with the last, are reranked by exact
inner products.

Vectors far longer than the page's others would squeeze these into one direction when lifted: they are not posted
but reranked always.  Equal vectors are one entry of the index, so that copies neither crowd out other vectors nor are
lost among each other.  Every vector is indexed, and the share holds in every page, whatever its size.  Pages are
visited best first and left out only where no vector of theirs can be among the ``k`` best (``search``).
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.llm import search
from catalogkit.llm.mtree import compact

LOUD = 2.0  # times the norm that nine tenths of a page's vectors stay below


def _nearest(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the nearest pivots, in order."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


def _lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
    return np.column_stack([vectors, rest])


def post(ids: list, vectors: np.ndarray, wild: bool, pivots: int, prefix: int) -> dict:
    """A page: its vectors and their ids, the loud ones last, and the pivots' inverted files (vectors and places, by pivot)."""
    with np.errstate(over="ignore"):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
    loud = ~(norms <= LOUD * np.quantile(norms, 0.9))
    order = np.argsort(loud, kind="stable")
    ids, vectors, n = [ids[i] for i in order.tolist()], vectors[order], int((~loud).sum())
    page = {"ids": ids, "vectors": compact(vectors), "n": n}
    if n:
        quiet = _lift(vectors[:n], float(norms[~loud].max()))
        own = quiet[np.random.default_rng(n).permutation(n)[:pivots]]
        prefix = min(prefix, len(own))
        seen = _nearest(quiet, own, prefix)
        by_pivot = np.argsort(seen.ravel(), kind="stable")
        starts = np.searchsorted(seen.ravel()[by_pivot], np.arange(len(own) + 1))
        page |= {"pivots": own, "rows": (by_pivot // prefix).astype(np.int32), "gain": (prefix - by_pivot % prefix).astype(np.int16), "starts": starts, "prefix": prefix}
    return page


def ranked(page: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray | None = None, share: float = 0.3) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """(query_id, vec_id, score) of the ``k`` best found in the page for every query, unless they are below ``kth``, and how
    many were reranked."""
    vectors, n = page["vectors"].astype(float), page["n"]
    loud = np.arange(n, len(vectors))
    keep, out, counts = min(n, max(k + 1, int(np.ceil(share * n)))), [], np.zeros(len(query_ids), int)
    seen = _nearest(np.column_stack([queries, np.zeros(len(queries))]), page["pivots"], page["prefix"]) if n else [()] * len(queries)
    for at, (qid, q, order) in enumerate(zip(query_ids.tolist(), queries, seen)):
        chosen = loud
        if n:
            parts = [(page["starts"][p], page["starts"][p + 1]) for p in order]
            rows = np.concatenate([page["rows"][a:b] for a, b in parts])
            gains = np.concatenate([np.minimum(page["gain"][a:b], page["prefix"] - i) for i, (a, b) in enumerate(parts)])
            near = np.bincount(rows, gains, n)
            cut = np.partition(near, n - keep)[n - keep]
            chosen = np.concatenate([np.flatnonzero(near >= cut), loud])
        scores = np.einsum("ij,j->i", vectors[chosen], q)
        counts[at] = len(chosen)
        if kth is not None:  # below it nothing is among the k best of all pages
            chosen, scores = chosen[scores >= kth[at]], scores[scores >= kth[at]]
            if not len(chosen):
                continue
        if len(chosen) > k:  # one entry may hold the query's own id alone
            top = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            chosen, scores = chosen[top], scores[top]
        held = [page["ids"][i] for i in chosen.tolist()]
        ids, scores = np.concatenate(held), np.repeat(scores, list(map(len, held)))
        ids, scores = ids[ids != qid], scores[ids != qid]
        best = np.lexsort((ids, -scores))[:k]
        out += [(qid, int(ids[i]), float(scores[i])) for i in best.tolist()]
    return out, counts


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = 512, prefix: int = 48, share: float = 0.3, page_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, pages_visited, entries_scored): for each row whose vec_id is divisible by ``every``,
    the ``k`` nearest other rows found, nearest first, ties to the smaller vec_id; score is the exact inner product.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; rows of other
    lengths than the query's are no candidates; rows that repeat an id are candidates each.  A query finds fewer
    than ``k`` rows only where there are fewer.  An empty table gives no rows; extra columns are ignored.
    """
    rows = search.usable(vectors, drop_zero=True)
    index = search.build(rows, functools.partial(post, pivots=pivots, prefix=prefix), page_rows, k)
    return search.search(index, rows.where(F.col("vec_id") % every == 0), functools.partial(ranked, share=share), k, "double")
