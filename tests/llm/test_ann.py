"""The hash-prefix forest against brute force."""

from __future__ import annotations

import numpy as np

from inkstone.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int"


def vectors(n, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    return [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.5 * rng.standard_normal(width)], 1) for i in range(n)]


def brute(rows, queries, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    want = {}
    for q in queries:
        d = np.sqrt(((x - np.array(dict((r[0], r[1]) for r in rows)[q])) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:k]
        want[q] = [(int(ids[b]), float(d[b])) for b in best if np.isfinite(d[b])]
    return want


def test_recall_and_scores_over_blocks(spark):
    rows = vectors(3000)
    df = spark.createDataFrame(rows, SCHEMA)
    out = ann.nearest_neighbours(df, df.filter("vec_id % 50 = 0"), block_rows=700, candidates=120, share=0.2).collect()
    want = brute(rows, [i for i in range(0, 3000, 50)], 10)
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    exact = dict((r[0], np.array(r[1])) for r in rows)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        for _, v, s in found:
            assert abs(s - np.sqrt(((exact[q] - exact[v]) ** 2).sum())) < 1e-12
        hits += len({f[1] for f in found} & {v for v, _ in want[q]})
    assert hits / (10 * len(want)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (200, [0.0, 0.0], 1), (300, None, 1), (400, [nan, 1.0], 1), (500, [inf, 1.0], 1), (600, [None, 1.0], 1), (700, [1.0], 1), (None, [1.0, 1.0], 1), (5, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in ann.nearest_neighbours(df, df.filter("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 4), (0, 2, 5), (0, 3, 100), (100, 1, 0), (100, 2, 4), (100, 3, 5)]
    assert ann.nearest_neighbours(df.filter("false"), df).collect() == []
    assert ann.nearest_neighbours(df, df.filter("false")).collect() == []


def test_candidates_come_by_prefix():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 16))
    forest = ann.Forest(np.arange(2000), x, np.zeros(16), ann.planes(16, 8))
    h = forest.strings(forest.distances(x))
    assert h.shape == (8, 2000) and (np.sort(h, axis=1) == np.take_along_axis(h, forest.order.reshape(8, -1).astype(np.int64), axis=1)).all()
    d = forest.distances(x[:1])[0]
    for length in (forest.depth, forest.depth - 2, 3, 0):
        lo, hi = forest.ranges(d, h[:, 0], length, 10**6)
        found = {int(i) for a, b in zip(lo, hi, strict=True) for i in forest.order[a:b]}
        same = {int(i) for t in range(8) for i in np.flatnonzero(h[t] >> np.uint64(32 - length) == h[t, 0] >> np.uint64(32 - length))} if length else set(range(2000))
        assert same <= found and 0 in found
        first = forest.order[lo[0] : hi[0]]
        assert 0 in first  # the query's own prefix, where no bit differs, comes first
    assert len(forest.candidates(d, h[:, 0], 100)) == 100 and len(forest.candidates(d, h[:, 0], 5000)) == 2000
