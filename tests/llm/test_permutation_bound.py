import numpy as np

from catalogkit.llm import permutation


def test_a_page_gives_no_rows_below_the_kth_score():
    x = np.random.default_rng(5).normal(size=(400, 8))
    page = permutation.post([np.array([i]) for i in range(400)], x, False, 64, 16)
    ids, queries = np.arange(4) * 20, x[:4]
    free, _ = permutation.ranked(page, ids, queries, 20)
    kth = np.array([-np.inf, np.inf, *[sorted(s for q, _, s in free if q == i)[10] for i in ids[2:]]])
    bound, counts = permutation.ranked(page, ids, queries, 20, kth)
    limit = dict(zip(ids.tolist(), kth.tolist()))
    assert bound == [r for r in free if r[2] >= limit[r[0]]] and (counts > 20).all()
