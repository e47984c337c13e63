"""The pipeline: each stage keeps its promises on the smallest tables; operators import cleanly."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from inkstone.llm import common, jaccard, toxicity
from inkstone.plans.staging import stage


def test_stages(spark, data):
    docs = common.table(spark, data, "documents")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = stage(function(spark, docs, data), f"test_{name}")
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.train(before, common.table(spark, data, "labels"))
            want = {i for i, s in zip(texts, toxicity.WordScores(model).score([(t or "").encode() for t in texts.values()]), strict=True) if s < 0.5}
            assert {r.doc_id for r in kept[name]} == want
        if name == "line_dedup":
            assert {r.doc_id for r in kept[name]} == {r.doc_id for r in kept["toxicity"]}
            assert all(r.n_chars == len(r.text) for r in kept[name])
        if name == "ngram_jaccard":
            classes = {r.component_id for r in jaccard.near_duplicates(before).collect()}
            assert {r.doc_id for r in kept[name]} == classes
        if name == "mix_sources":
            assert max(Counter(r.doc_id for r in kept[name]).values()) <= 3
            assert {r.doc_id for r in kept[name]} <= {r.doc_id for r in kept["ngram_jaccard"]}
    bins = Counter()
    for r in kept["best_fit_packing"]:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048
    assert {r.doc_id for r in kept["best_fit_packing"]} == {r.doc_id for r in kept["mix_sources"]}


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= names
