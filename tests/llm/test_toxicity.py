"""Held-out accuracy on the labelled table, misspellings, folds and odd inputs."""

from __future__ import annotations

import zlib

import numpy as np

from inkstone.llm import toxicity

SCHEMA = "doc_id long, text string, toxic int, __x string"


def made(n, seed, words=60):
    rng = np.random.default_rng(seed)
    words_rng = np.random.default_rng(0)
    plain = ["".join(words_rng.choice(list("aeioubcdlmnrst"), words_rng.integers(2, 9))) for _ in range(500)]
    bad = ["grumblefitz", "snorkwaddle", "plindergash"]
    rows = []
    for i in range(n):
        text = [plain[j] for j in rng.integers(0, 500, int(rng.integers(3, words)))]
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * (1 + len(text) // 50)):
            text.insert(int(rng.integers(0, len(text))), bad[rng.integers(0, 3)] + "".join(rng.choice(list("aeiou"), 2)))
        rows.append((i, " ".join(text), toxic, "x"))
    return rows


def test_misspellings_in_short_and_long_texts():
    rows = made(600, 1)
    model = toxicity.fit([r[1].encode() for r in rows], np.array([r[2] for r in rows]))
    held = made(200, 1, 400)[100:] + made(100, 2)
    got = np.array(toxicity.WordScores(model).score([r[1].encode() for r in held])) >= 0.5
    assert (got == np.array([r[2] for r in held])).mean() > 0.95
    assert toxicity.WordScores(model).score([b"SNORKWADLE the", b"", b" \n"])[0] > 0.5


def word_number(model, word):
    """A word's number from its n-grams one at a time."""
    from inkstone.llm import common

    letters = "\x02" + word.encode().lower().decode() + "\x03"
    grams = [letters[i : i + n] for n in toxicity.NGRAMS for i in range(len(letters) - n + 1)]
    buckets = [int(common.rolling(np.array([ord(c) for c in g], np.uint64), len(g), 0x9E3779B97F4A7C15 + 2 * len(g))[0]) >> (64 - toxicity.BITS) for g in grams]
    return sum(float(model.weights[b]) for b in buckets) / max(len(buckets), 1)


def test_scores_word_by_word():
    rows = made(150, 6)
    model = toxicity.fit([r[1].encode() for r in rows], np.array([r[2] for r in rows]), rounds=5)
    texts = [r[1] for r in made(20, 7)] + ["", "a", "Naïve Ünï x\u2009y", "snorkwaddleea " * 10]
    for text, got in zip(texts, toxicity.WordScores(model).score([t.encode() for t in texts]), strict=True):
        words = [w.decode() for w in text.encode().split()]
        parts = [words[i : i + toxicity.SEGMENT] for i in range(0, max(len(words), 1), toxicity.SEGMENT)]
        odds = max(sum(word_number(model, w) for w in p) / max(len(p), 1) for p in parts) + model.bias
        assert abs(got - 1 / (1 + np.exp(-odds))) < 1e-6


def test_training_is_bounded_in_bytes_and_takes_an_id_once(spark, monkeypatch):
    rows = [(i, "w" * 100 + f" {i}", i % 2, "") for i in range(40)]
    rows += [(0, "other text of an id", 0, ""), (99, "x" * 5000, 1, "")]
    docs, seen = spark.createDataFrame(rows, SCHEMA), {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.update(texts=texts, labels=labels))
    toxicity.train(docs, docs.select("doc_id", "toxic"), sample_bytes=1000)
    for k in (0, 1):
        mine = [t for t, x in zip(seen["texts"], seen["labels"], strict=True) if x == k]
        assert 800 <= sum(map(len, mine)) <= 1000 and len(mine) in (9, 10)
    toxicity.train(docs, docs.select("doc_id", "toxic"))
    assert len(seen["texts"]) == 41 and sum(t.startswith(b"other") for t in seen["texts"]) == 1


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = made(120, 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    flipped = [(i, t, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x, z) for i, t, x, z in rows]
    one = toxicity.train(docs.drop("toxic"), docs, folds=5)
    two = toxicity.train(docs.drop("toxic"), spark.createDataFrame(flipped, SCHEMA), folds=5)
    assert np.array_equal(one.weights, two.weights)


def test_odd_rows(spark):
    rows = made(80, 4) + [(1000, None, None, None), (1001, "", 0, ""), (None, "snorkwaddleai", 1, ""), (1002, "x" * 50000, 0, ""), (1002, "x" * 50000, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    out = toxicity.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["__tx_score"] <= 1 for r in out)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert {r["__tx_score"] for r in out if r.doc_id in (1000, 1001)} == {out[80]["__tx_score"]}


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame(made(5, 5), SCHEMA)
    none = docs.filter("false")
    assert {r["__tx_score"] for r in toxicity.scored(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert toxicity.scored(none, toxicity.train(docs, none)).collect() == []


def test_query(spark, data):
    rows = toxicity.op7_toxicity(spark, data).collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
