"""Packing against whole-text tokenisation and the rules of the contract."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import packing

SCHEMA = "doc_id long, text string, bin string, fill int"


def reference(rows, limit):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for doc, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), limit)):
            part = ids[start : start + limit]
            want.append((doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return want


def check(rows, out, limit):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(reference(rows, limit), key=key)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins)


def test_pieces_and_layout(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("It's don't İstanbul, e\u0301a. A\u0301b; <|ENDOFTEXT|> É. 9. a.. Straße naïve été 12345 !? ΟΔΟΣ  x".split(" ")[j] for j in rng.integers(0, 16, n)), "a", 1) for i, n in enumerate(rng.integers(0, 400, 150))]
    rows += [(900, None, None, None), (901, "", "", 0), (902, " \n\t", "b", 2), (902, " \n\t", "b", 2), (None, "ab cd é", "c", 3), (903, "word " * 9000, "d", 4), (904, "<|endoftext|> a<|startoftext|>b", "", 5)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5), packing.tokenizer_path(), limit=256).collect()
    used = check(rows, out, 256)
    total = sum(r.length for r in out)
    assert used <= -(-total // 256) * 1.03 + 1


def test_tree_of_several_rounds(spark):
    rows = [(i, "word " * (100 + i % 90), "a", 1) for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(8), packing.tokenizer_path(), limit=256, items_per_task=20).collect()
    check(rows, out, 256)


def test_invalid_bytes(spark):
    df = spark.createDataFrame([(1, 0)], "doc_id long, x int").selectExpr("doc_id", "cast(unhex('61ff62') as string) as text")
    assert [(r.doc_id, r.ids_crc32) for r in packing.pack(df, packing.tokenizer_path()).collect()] == [(1, reference([(1, "a\ufffdb")], 2048)[0][4])]


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), packing.tokenizer_path()).collect() == []


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=60, deadline=None)
def test_best_fit(lengths):
    where, at, fills = packing.best_fit(np.array(lengths, np.int64), 50)
    assert len(where) == len(lengths)
    for b in range(len(fills)):
        inside = sorted((at[i], lengths[i]) for i in range(len(lengths)) if where[i] == b)
        total = 0
        for place, n in inside:
            assert place == total
            total += n
        assert total == fills[b] <= 50
    assert sum(fills) == sum(lengths)
    if len(fills) > 1:
        assert sum(sorted(fills)[:2]) > 50  # no two bins fit in one


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=80, deadline=None)
def test_best_fit_of_counts(lengths):
    counts = Counter(lengths)
    plan = packing.best_fit_counts(counts, 50)
    bins = defaultdict(list)
    for size in counts:
        mine = sorted(p for p in plan if p[0] == size)
        for rank in range(counts[size]):
            _, first, head, each, base = [p for p in mine if p[1] <= rank][-1]
            bins[head + (rank - first) // each].append((base + (rank - first) % each * size, size))
    for spans in bins.values():
        at = 0
        for place, n in sorted(spans):
            assert place == at
            at += n
        assert at <= 50
    assert len(bins) == len(packing.best_fit(np.array(lengths, np.int64), 50)[2])


def test_the_root_takes_what_combines_with_nothing(spark):
    fills = [(i, 1500 + i % 7) for i in range(500)] + [(1000 + i, 30 + i % 11) for i in range(200)]
    moved = packing.merged(spark.createDataFrame(fills, "bin long, fill long").repartition(4), 2048, 25).collect()
    assert len(moved) == len(fills)
    of, size = defaultdict(list), dict(fills)
    for r in moved:
        of[r.root].append((r.base, size[r.bin]))
    for spans in of.values():
        at = 0
        for base, n in sorted(spans):
            assert base == at
            at += n
        assert at <= 2048
    assert len(of) == 500  # each small bin lies in a large one


@pytest.mark.parametrize("n", [0, 1])
def test_small(n):
    where, at, fills = packing.best_fit(np.array([7] * n, np.int64), 10)
    assert list(where) == [0] * n and list(fills) == [7] * n
