"""Line removal and source mixing against plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from inkstone.llm import lines, mixing

SCHEMA = "doc_id long, text string, source string, keys string"


def documents(seed=2):
    rng = np.random.default_rng(seed)
    common = ["  Common LINE ", "common line", "©  x", "Über", "über", "", "\t"]
    rows = []
    for i in range(80):
        n = int(rng.integers(1, 8))
        text = "\n".join(common[rng.integers(0, 7)] if rng.random() < 0.4 else f"own {i} {j}" for j in range(n))
        rows.append((i, text, ["b", "a", None, "", "ü"][int(rng.choice(5, p=[0.6, 0.2, 0.1, 0.05, 0.05]))], "k"))
    return rows + [(200, None, "a", None), (201, "", None, ""), (None, "Common line\nkept", "b", ""), (None, "Common line\nkept", "b", ""), (7, rows[7][1], rows[7][2], "")]


def test_lines(spark):
    rows = documents()
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {(r[0] if r[0] is not None else r[1] or "", k) for r in rows for k in map(key, (r[1] or "").split("\n")) if k}
    counts = Counter(k for _, k in held)
    want = []
    for r in rows:
        parts = (r[1] or "").split("\n")
        kept = [x for x in parts if counts[key(x)] < 10]
        want.append((r[0], len(parts), len(parts) - len(kept), "\n".join(kept), r[3]))
    out = lines.drop_common_lines(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(((r.doc_id, r["__ld_lines"], r["__ld_dropped"], r.text, r["keys"]) for r in out), key=str) == sorted(want, key=str)
    assert lines.drop_common_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a\nb", "s", "")] * 10 + [(i, "c\nown", "s", "") for i in range(2, 11)] + [(2, "c\nother", "s", ""), (None, "d", "s", ""), (None, "d", "s", "")]
    out = lines.drop_common_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["__ld_dropped"] == 0 for r in out)  # c stands in nine documents
    out = lines.drop_common_lines(spark.createDataFrame([*rows, (None, "c", "s", "")], SCHEMA)).collect()
    assert Counter(r["__ld_dropped"] for r in out) == {0: 12, 1: 11}
    assert {r.text for r in out if r["__ld_dropped"]} == {"own", "other", ""}


def test_texts_of_very_many_lines(spark):
    shared = "\n".join(f"line {i}" for i in range(100_000))
    df = spark.createDataFrame([(i, shared + f"\nown {i}", "s", "") for i in range(10)], SCHEMA)
    out = sorted((r.doc_id, r.text, r["__ld_lines"], r["__ld_dropped"]) for r in lines.drop_common_lines(df).collect())
    assert out == [(i, f"own {i}", 100_001, 100_000) for i in range(10)]


def water(sizes, weights, most=3):
    """Shares by rounds: what is over the cap is shared again among the others."""
    total, target = sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    capped = set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        w = sum(weights[s] for s in free)
        for s in sizes:
            target[s] = most * sizes[s] if s in capped else rest * weights[s] / w
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target
        capped |= set(over)


def test_mix_plan(spark):
    rows = documents(5)
    size = lambda t: len((t or "").split())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.plan_mix(df.repartition(3)).collect()
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        taken[r["__m_source"]] += r["__m_taken"]
        assert r["__m_taken"] <= 3 * r["__m_size"] and 0 <= r["__m_time"] <= 1
        assert abs(r["__m_target"] - target[r["__m_source"]]) < 1e-6 and r["__m_words"] == sizes[r["__m_source"]]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.plan_mix(df.repartition(7)).collect()
    pick = lambda rs: sorted(((r["__m_id"], r["__m_hash"], r["__m_taken"], r["__m_time"]) for r in rs), key=str)
    assert pick(out) == pick(again)


def test_mix_orders_and_repeats(spark):
    rows = documents(6)
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df)
    assert out.columns == df.columns
    counts = Counter((r.doc_id, r.text) for r in out.collect())
    assert max(counts.values()) <= 6 and all((t or "").split() for _, t in counts)  # two equal rows, three passes each
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.plan_mix(spark.createDataFrame([(1, None, None, None)], SCHEMA)).first()["__m_taken"] == 0


def test_time_inverts_the_integral(spark):
    for knots in ([1.0, 1.0], [0.0, 2.0], [2.0, 0.0], [1.5, 1.0, 0.5], [0.5, 3.0, 0.0, 1.0]):
        shares = [i / 20 for i in range(21)]
        df = spark.createDataFrame([(s, knots) for s in shares], "s double, __m_knots array<double>")
        times = [r.t for r in df.select("s", mixing.time_of(F.col("s")).alias("t")).orderBy("s").collect()]
        grid = np.linspace(0, 1, 20001)
        w = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        area /= area[-1]
        for s, t in zip(shares, times, strict=True):
            assert abs(np.interp(t, grid, area) - s) < 1e-3
