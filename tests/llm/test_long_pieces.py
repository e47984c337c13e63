"""Anchors of windows that start beyond what the low bits of a hash can number."""

from __future__ import annotations

from inkstone.llm import substrings


def test_anchors_beyond_the_place_bits(monkeypatch):
    monkeypatch.setattr(substrings, "PLACE_BITS", 8)
    shared = [f"s{i}" for i in range(60)]
    text = " ".join([*shared, *(f"x{i}" for i in range(700)), *shared]).encode()
    e = substrings.Edges([text], substrings.SPAN, substrings.K)
    n = len(shared) - substrings.SPAN + 1
    assert (e.hash_of_anchor[:n] == e.hash_of_anchor[-n:]).all()
    assert (e.anchors[-n:] >= len(shared) + 700).all()
    short = substrings.Edges([" ".join(shared).encode()], substrings.SPAN, substrings.K)
    assert (short.hash_of_anchor == e.hash_of_anchor[:n]).all()
