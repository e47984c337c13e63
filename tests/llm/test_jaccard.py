"""The similarity join against all pairs, also with clusters of several blocks."""

from __future__ import annotations

import re

import numpy as np
import pytest

from inkstone.llm import jaccard, rtree
from inkstone.llm.components import components

SCHEMA = "doc_id long, text string, n long, prefix string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, width, percent):
    sets = []
    for r in rows:
        w = words_of(r[1])
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    n = len(rows)
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if same_id or (both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)):
                label[find(i)] = find(j)
    smallest = {}
    for i in range(n):
        if rows[i][0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((r[0], len(s), None if r[0] is None else smallest[find(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def sample(seed, bases=14, copies=9, length=70):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [vocabulary[i] for i in rng.integers(0, 400, 25)]
    rows = []
    for _ in range(bases):
        base = [vocabulary[i] for i in rng.integers(0, 400, length)] + (passage if rng.random() < 0.5 else [])
        for _ in range(int(rng.integers(1, copies))):
            text = list(base)
            for _ in range(int(rng.integers(0, 5))):
                text[rng.integers(0, len(text))] = vocabulary[rng.integers(0, 400)]
            rows.append((int(rng.integers(0, 10**6)), (" " if rng.random() < 0.7 else "\n").join(text).upper() if rng.random() < 0.2 else " ".join(text), 1, "x"))
    rows += [(10**7, None, None, None), (10**7 + 1, "", 1, ""), (10**7 + 2, "one two", 1, ""), (10**7 + 3, "ONE\ttwo", 1, ""), (None, "one two", 1, ""), (10**7 + 4, "a b c", 1, "")]
    return rows + rows[:3] + [(rows[0][0], "quite another text with words of its own", 1, "")]


@pytest.mark.parametrize(("seed", "width", "percent", "block"), [(1, 4, 85, 2_000_000), (2, 5, 80, 150), (3, 3, 60, 90)])
def test_against_all_pairs(spark, seed, width, percent, block):
    rows = sample(seed)
    out = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), width=width, percent=percent, block_shingles=block)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, width, percent)


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_one(spark):
    rows = [(5, "a b c d e f", 1, ""), (3, "a b c d e f", 2, "p"), (9, "x y z u v w q", 1, ""), (None, "a b c d e f", 1, ""), (11, None, 1, "")]
    out = jaccard.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "n", "prefix"]
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([3, 9, None, 11], key=str)


def test_components(spark):
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103)] + [(500, int(i)) for i in rng.integers(501, 600, 30)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[105] == 100
    assert all(v == 500 for k, v in got.items() if k >= 500)


@pytest.mark.parametrize("scale", [1, 12, 60])
def test_tree_misses_nothing(scale):
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(60 if scale == 1 else 14):
        base = np.unique(rng.integers(0, 2**63, 110 * scale).astype(np.uint64))
        for _ in range(5):
            keep = rng.random(len(base)) > rng.random() * 0.15
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, 5).astype(np.uint64)])))
    sizes = np.array([len(s) for s in sets])

    def enough(p, q):
        both = len(np.intersect1d(sets[p], sets[q]))
        return 100 * both >= 80 * (sizes[p] + sizes[q] - both)

    got, want = rtree.Classes(len(sets)), rtree.Classes(len(sets))
    rtree.link_sets([rtree.point(s) for s in sets], sizes, 80, got, enough)
    for i in range(len(sets)):
        for j in range(i):
            if enough(i, j):
                want.union(i, j)
    assert [got.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


@pytest.mark.parametrize("most", [2, 5])
def test_cells_of_several_blocks(spark, monkeypatch, most):
    """Cells larger than a block lose no link, neither near copies nor unlike sets that share a shingle."""
    monkeypatch.setattr(jaccard, "CELL_SETS", most)
    rows = sample(5, bases=4, copies=12) + [(2 * 10**7 + i, f"one rare shingle shared {i} by sets like no other {i * 7}", 1, "") for i in range(12)]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), width=4, percent=85)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, 4, 85)
