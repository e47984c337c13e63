"""The automaton against cutting pieces one by one."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import tokencount
from inkstone.llm.tokencount import START, UNKNOWN, Automaton


def greedy(pieces, word):
    rest, n = START + word, 0
    while rest:
        fit = next((k for k in range(min(len(rest), 20), 0, -1) if rest[:k] in pieces), 0)
        if not fit:
            return 1 + UNKNOWN
        rest, n = rest[fit:], n + 1
    return n


LETTERS = st.text("abc", min_size=1, max_size=6)


@given(st.lists(LETTERS, max_size=12), st.lists(st.text("abc", max_size=4), max_size=6), st.text("abcd", min_size=1, max_size=14))
@settings(max_examples=400, deadline=None)
def test_small_vocabularies(inside, starts, word):
    pieces = {*inside, *(START + s for s in starts)}
    assert Automaton(pieces).count(word) == greedy(pieces, word)


def test_rows(spark):
    rows = [(1, "The quick, brown\tfox\x85über 日本 漢字 \U0001f600", 0, ""), (2, None, None, None), (3, "", 0, ""), (None, "a a", 0, ""), (4, "x" * 3000 + " y", 0, ""), (4, "b", 0, ""), (4, "b", 0, "")]
    out = tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_words int, n_tokens string"), tokencount.vocabulary_path()).collect()
    pieces = set(tokencount.vocabulary(tokencount.vocabulary_path()))
    want = []
    for i, text, *_ in rows:
        counts = [greedy(pieces, w.decode()) for w in (text or "").encode().split()]
        want.append((i, len(counts), sum(c % UNKNOWN for c in counts), sum(c // UNKNOWN for c in counts)))
    assert [tuple(r) for r in out] == want
    assert tokencount.token_counts(spark.createDataFrame([], "doc_id long, text string"), tokencount.vocabulary_path()).collect() == []


def test_query(spark, data):
    pieces = set(tokencount.vocabulary(tokencount.vocabulary_path()))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = tokencount.op3_token_counts(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows[::7]:
        counts = [greedy(pieces, w.decode()) for w in texts[r.doc_id].encode().split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(counts), sum(c % UNKNOWN for c in counts), sum(c // UNKNOWN for c in counts))
