"""Recall of the forest at the registered settings against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from inkstone.llm import ann


def recall(rows: dict, out: list) -> float:
    ids, x, got, hits = np.array(list(rows)), np.array(list(rows.values())), {}, 0
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, found in got.items():
        d = ((x - rows[q]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hits += len(found & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    return hits / (10 * len(got))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_tables(spark, sf):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()}
    share = max(ann.CANDIDATES, int(ann.SHARE * len(rows))) / len(rows)
    found = recall(rows, ann.op10_hash_prefix_forest(spark, f"/root/testdata/{sf}").collect())
    print("recall", sf, len(rows), found, "share looked at", min(share, 1))
    assert found >= 0.9


def test_recall_on_ten_thousand_rows_of_a_fifth(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((10_000, 64)).astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert max(ann.CANDIDATES, int(ann.SHARE * 5000)) <= 0.2 * 5000  # two blocks of half the rows
    found = recall(dict(enumerate(x)), ann.nearest_neighbours(df, df.filter("vec_id % 100 = 0")).collect())
    print("recall", found)
    assert found >= 0.9
