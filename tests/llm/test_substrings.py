"""Substring removal against every window of a small corpus."""

from __future__ import annotations

import numpy as np
import pytest

from inkstone.llm import substrings

SCHEMA = "doc_id long, text string, start int, spans string"


def brute(rows, span):
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, cover = {}, {}
    # rows of one id with different texts: ordered by a hash in the engine, so tests keep them apart
    for none, i, text in docs:
        words = text.split()
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - span + 1):
            key = tuple(words[s : s + span])
            if key in seen:
                gone[s : s + span] = True
            else:
                seen[key] = (i, s)
        cover[none, i, text] = (len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone, strict=True) if not g).encode())
    return sorted(((r[0], *cover[r[0] is None, r[0] or 0, r[1] or ""]) for r in rows), key=str)


def corpus(seed, span):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ünïcode,", "A", "a"]
    word = lambda n: [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]
    passages = [word(int(rng.integers(span - 2, 3 * span))) for _ in range(6)]
    rows = []
    for i in rng.permutation(60):
        text = word(int(rng.integers(0, 2 * span)))
        for _ in range(int(rng.integers(0, 4))):
            p = list(passages[rng.integers(0, 6)])
            if rng.random() < 0.4:
                p[rng.integers(0, len(p))] = "changed"
            text += p + word(int(rng.integers(0, 6)))
        rows.append((int(i) * 3, ("\n" if rng.random() < 0.3 else " ").join(text), 1, "x"))
    rows.append((1000, " ".join(["ha"] * (3 * span)), 1, ""))
    rows.append((1001, " ".join(["ha", "ho"] * (2 * span)), 1, ""))
    rows += [(2000, rows[3][1], 0, ""), (2001, rows[3][1], 0, ""), (2001, rows[3][1], 0, ""), (2002, None, None, None), (2003, "", 0, ""), (None, rows[5][1], 0, ""), (None, " ".join(word(span)), 0, "")]
    return rows


@pytest.mark.parametrize(("seed", "span", "k"), [(1, 20, 8), (2, 8, 3), (3, 5, 8)])
def test_against_all_windows(spark, seed, span, k):
    rows = corpus(seed, span)
    out = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), span=span, k=k)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in out.collect()), key=str) == brute(rows, span)


def test_spans_name_their_sources(spark):
    from pyspark.sql import functions as F

    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"one two {passage} end", 0, ""), (2, f"other start here {passage} x y", 0, ""), (3, passage, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("th", F.xxhash64("text"))
    spans, copies = substrings.repeated_spans(docs)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in spans.collect()}
    assert got == {2: [(3, 31, 1, 2)], 3: [(0, 31, 1, 2)]}
    assert copies.collect() == []


def test_the_largest_id_and_rows_without_one(spark):
    text = " ".join(f"p{i}" for i in range(30))
    rows = [(2**63 - 1, text, 0, ""), (None, text, 0, ""), (5, "a " + text, 0, "")]
    out = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.n_words, r.n_removed) for r in out} == {(2**63 - 1, 30, 30), (None, 30, 30), (5, 31, 0)}


def test_pieces_by_rows_and_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (5, 5, 30, 1, 1, 1, 1, 0, 12)] + [None]
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts)})
    assert [p.column(0).to_pylist() for p in substrings.pieces(batch, 0, rows=3, size=10)] == [texts[0:2], texts[2:3], texts[3:6], texts[6:8], texts[8:]] or [len(p) for p in substrings.pieces(batch, 0, rows=3, size=10)] == [2, 1, 3, 2, 1, 1]


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
