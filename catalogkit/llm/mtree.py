"""Exact top-k inner products by best-first search of an M-tree.

Vectors are quantised to integers, on which scores are exact.  The tree's upper levels are Spark tables: vectors in
pages around global pivots, with covering radii (``search``).  Each page is an M-tree of its own: a node keeps a
pivot, a covering radius, the distance to its parent's pivot and the largest norm below it; a leaf keeps each
row's distance to its pivot.  With d the Euclidean distance, 2 q.x = |q|^2 + |x|^2 - d(q,x)^2, so a lower bound of d
gives an upper bound of the score.  Bounds come first from the stored distances by the triangle inequality,
without computing any distance, then from the distance to a pivot; nodes are taken from a heap by their bound until
none can reach the k-th best, which a query brings along from the pages before.

Vectors whose norm is WILD or more would leave the range in which doubles hold whole numbers exactly: they lie in
pages without bounds and are scored in whole numbers of any size, as is every row for a query of such a norm.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogkit.llm import search

WILD = float(2**26)  # a product of two smaller norms is below 2^52, where doubles are exact
LONG = 2**63


def quantise(vectors: np.ndarray, steps: int = 256) -> np.ndarray:
    """floor(steps * x); what is past the range of doubles stays at its end."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(steps * vectors))


def whole_scores(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact inner products of vectors of whole numbers; those past the range of a long stay at its end."""
    q = [int(x) for x in query.tolist()]
    return [min(max(sum(int(x) * y for x, y in zip(r, q)), -LONG), LONG - 1) for r in rows.tolist()]


def compact(x: np.ndarray) -> np.ndarray:
    """The same values in half the bytes where that is exact."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small if (small == x).all() else x


@dataclass
class Tree:
    ids: list  # of each entry: its vec_ids
    rows: np.ndarray  # in leaf order
    norms: np.ndarray  # squared
    to_pivot: np.ndarray  # each row's distance to its leaf's pivot
    pivot: np.ndarray  # per node: the pivot's vector
    radius: np.ndarray
    to_parent: np.ndarray
    top_norm: np.ndarray  # squared, largest below the node
    children: list  # per node: node numbers, or None
    span: list  # per node: its rows (first, end)


def grow(ids: list, x: np.ndarray, wild: bool = False, leaf: int | None = None, fanout: int = 8) -> Tree:
    """Bulk load: a node of more than ``leaf`` rows (a quarter of the page, 512 at most) deals them to the
    nearest of ``fanout`` pivots chosen farthest first.  A wild page has no tree."""
    leaf = leaf or min(512, max(32, -(-len(x) // 4)))
    if wild:
        none = np.zeros(0)
        return Tree(ids, x, none, none, none, none, none, none, [], [])
    norms = (x * x).sum(axis=1)
    order: list[int] = []
    pivot, radius, to_parent, top, children, span, to_pivot = [], [], [], [], [], [], {}

    def node(rows: np.ndarray, at: np.ndarray, parent: np.ndarray) -> int:
        own = len(pivot)
        d = np.sqrt(((x[rows] - at) ** 2).sum(axis=1))
        pivot.append(at)
        radius.append(float(d.max(initial=0)))
        to_parent.append(float(np.sqrt(((at - parent) ** 2).sum())))
        top.append(float(norms[rows].max(initial=0)))
        children.append(None)
        span.append(None)
        first = len(order)
        if len(rows) <= leaf or radius[own] == 0:
            order.extend(rows.tolist())
            to_pivot.update(zip(rows.tolist(), d.tolist()))
        else:
            chosen, gap, nearest = [int(d.argmax())], None, None
            for j in range(fanout):
                far = ((x[rows] - x[rows[chosen[-1]]]) ** 2).sum(axis=1)
                nearest = np.zeros(len(rows), int) if gap is None else np.where(far < gap, j, nearest)
                gap = far if gap is None else np.minimum(gap, far)
                if j + 1 < fanout:
                    chosen.append(int(gap.argmax()))
            parts = [(rows[nearest == j], x[rows[c]]) for j, c in enumerate(chosen) if (nearest == j).any()]
            children[own] = np.array([node(r, p, at) for r, p in parts])
        span[own] = (first, len(order))
        return own

    start = x.mean(axis=0)
    node(np.arange(len(x)), start, start)
    own = np.array(order, int)
    return Tree([ids[i] for i in order], compact(x[own]), norms[own], np.array([to_pivot[i] for i in order]), np.array(pivot), np.array(radius), np.array(to_parent), np.array(top), children, span)


def best(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(query_id, vec_id, score) rows that hold the ``k`` best of the tree for every query, unless they are below ``kth``,
    and how many entries were scored for each."""
    out, counts = [], np.zeros(len(query_ids), int)
    rows = tree.rows.astype(float)
    for n, (qid, q) in enumerate(zip(query_ids.tolist(), queries)):
        least = -np.inf if kth is None else float(kth[n])
        q2 = float(q @ q)
        if not len(tree.span) or not q2 < WILD * WILD:
            scores = whole_scores(rows, q)
            found = sorted(((-s, int(v)) for s, own in zip(scores, tree.ids) for v in own if v != qid))[:k]
            out += [(qid, v, -s) for s, v in found]
            counts[n] = len(rows)
            continue
        room = search.SLACK * (q2 + float(tree.top_norm[0])) + 1e-6
        bound = lambda near, norm: (q2 + norm - np.maximum(near, 0) ** 2) / 2 + room  # noqa: E731, B023
        at, scores = np.empty(0, int), np.empty(0)
        heap = [(-np.inf, 0, float(np.sqrt(((q - tree.pivot[0]) ** 2).sum())))]
        while heap:
            top, node, d = heapq.heappop(heap)
            if -top < least:
                break
            if tree.children[node] is None:
                a, b = tree.span[node]
                near = np.flatnonzero(bound(np.abs(d - tree.to_pivot[a:b]), tree.norms[a:b]) >= least) if least > -np.inf else np.arange(b - a)
                own = rows[a:b] @ q if 2 * len(near) > b - a else rows[a + near] @ q
                counts[n] += len(own)
                near = np.arange(b - a) if len(own) == b - a else near
                keep = own >= least
                at, scores = np.concatenate([at, near[keep] + a]), np.concatenate([scores, own[keep]])
                if len(at) > k:  # one entry may hold the query's own id alone
                    least = max(least, np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1])
                    keep = scores >= least
                    at, scores = at[keep], scores[keep]
                continue
            c = tree.children[node]
            c = c[bound(np.abs(d - tree.to_parent[c]) - tree.radius[c], tree.top_norm[c]) >= least]
            far = np.sqrt(((tree.pivot[c] - q) ** 2).sum(axis=1))
            for child, dist, value in zip(c.tolist(), far.tolist(), bound(far - tree.radius[c], tree.top_norm[c]).tolist()):
                if value >= least:
                    heapq.heappush(heap, (-value, child, dist))
        found = sorted((-s, int(v)) for i, s in zip(at.tolist(), scores.tolist()) for v in tree.ids[i] if v != qid)[:k]
        out += [(qid, v, int(-s)) for s, v in found]
    return out, counts


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, page_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, pages_visited, entries_scored): for each row whose vec_id is divisible by
    ``every``, the ``k`` other rows with the highest integer inner products, ties to the smaller vec_id.

    Vectors that are null, empty or hold null or non-finite components take no part; rows of other
    lengths than the query's are no candidates; rows that repeat an id are candidates each, but a
    query's own id never is, and a query whose id repeats is asked with the smallest of its vectors.  Scores past
    the range of a long stay at its end.  An empty table gives no rows; extra columns are ignored.
    """
    rows = search.usable(vectors)
    index = search.build(rows, grow, page_rows, k, quantise, WILD)
    return search.search(index, rows.where(F.col("vec_id") % every == 0), best, k, "long", quantise, WILD)
