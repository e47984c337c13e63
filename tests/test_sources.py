"""Content streams, stored strings, messages, suggested items."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkstone.operators import structure
from inkstone.sources import content


def test_shown_text():
    stream = r"BT /F1-Bold 10 Tf 50 -100 Td (Hello \(w\)\n) Tj 0 -20 TD [(Wo) -500 (rld) 250] TJ T* (next) Tj 1 0 0 1 0 300 Tm (place) Tj ET"
    got = content.shown_in(stream)
    assert [(g[0], round(g[1], 3), round(g[2], 3)) for g in got[:1]] == [("Hello (w)", 50.0, 700.0)]
    assert [g[0] for g in got] == ["Hello (w)", "World", "next", "place"]
    hello = content.width_of("Hello (w)", 10)
    assert hello == pytest.approx(10 * (0.5 * 6 + 0.35 * 3))
    assert got[1][1:4] == pytest.approx((50 + hello + 4, 680.0, 25 + 7.5))
    assert got[2][2] == pytest.approx(668.0) and got[3][2] == 300.0 and got[3][1] > 0
    assert all(g[6] for g in got) and got[0][5] == "F1-Bold"


def test_streams_are_dealt_to_pages(spark):
    body = "".join(f"stream\nBT ({t}) Tj ET\nendstream\n" for t in "abc")
    raw = "/Type /Page /Type /Page /Type /Pages " + body + "stream\nno text\nendstream"
    rows = [(1, raw), (2, None), (3, "")]
    got = [(r.doc_id, r.page_num, r.line_index, r.text) for r in content.content_lines(spark.createDataFrame(rows, "doc_id long, raw string")).collect()]
    assert got == [(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 2, 0, "c")]


def test_strings(spark):
    raws = ["שלום".encode("utf-16"), b"\xfe\xff" + "ab".encode("utf-16-be"), "é".encode(), "שלום".encode("cp1255"), b"", None]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(raws)], "i int, b binary")
    assert [r.t for r in df.select("i", content.decoded(F.col("b")).alias("t")).orderBy("i").collect()] == ["שלום", "ab", "é", "שלום", "", None]
    texts = spark.createDataFrame([(0, "a(b)\\ ש"), (1, "Ã©t"), (2, "été"), (3, "ש")], "i int, t string")
    got = texts.select("i", content.escaped(F.col("t")).alias("e"), content.repaired(F.col("t")).alias("r")).orderBy("i").collect()
    assert got[0].e == "a\\(b\\)\\\\ ?" and [r.r for r in got[1:]] == ["ét", "été", "ש"]


def test_messages(spark):
    rows = [(1, 1, "text/plain", "p1"), (1, 2, "text/html", "h1"), (1, 3, "text/html", "h2"), (2, 1, "text/plain", "p"), (2, 2, "text/plain", "q"), (3, 1, "image/png", "x")]
    got = {r.doc_id: (r.body, r.is_html) for r in content.message_bodies(spark.createDataFrame(rows, "doc_id long, seq int, content_type string, text string")).collect()}
    assert got == {1: ("h1", True), 2: ("p", False), 3: (None, False)}


def test_wrapping(spark):
    items = [(1, 1, i, t, t) for i, t in enumerate(["h2", "li", "li", "p", "tr", "tr", "li", "odd"])]
    df = spark.createDataFrame(items, "doc_id long, page_num int, ord int, type string, text string")
    assert [(r.elem_type, r.n_items) for r in structure.wrapped(df).orderBy("ord").collect()] == [("H2", 0), ("L", 2), ("P", 0), ("Table", 2), ("L", 1), ("P", 0)]
    assert [r.elem_type for r in structure.wrapped(df, each_row=True).orderBy("ord").collect()].count("Table") == 2


def test_inspect(spark):
    rows = [(1, "Sect", 0, "alt"), (1, "H1", 1, None), (1, "H1", 2, "x"), (1, "P", 51, None)]
    got = {(r.elem_type, r.n, r.max_depth, r.warnings) for r in structure.inspect(spark.createDataFrame(rows, "doc_id long, elem_type string, depth int, alt string")).collect()}
    assert got == {("Sect", 1, 0, 1), ("H1", 2, 2, 0)}


def test_replies(spark):
    reply = '```json\n[{"type": "h2", "text": "T"}, {"type": "tr", "cells": [{"type": "th", "text": "a"}, {"type": "td", "text": "b"}]}]\n```'
    items = structure.suggested_items(spark.createDataFrame([(1, 1, reply), (2, 1, "none"), (3, 1, None)], "doc_id long, page_num int, reply string"))
    assert [(r.ord, r.type, r.text) for r in items.orderBy("ord").collect()] == [(0, "h2", "T"), (1, "tr", None)]
    assert [(r.ord, r.col_no, r.role, r.text) for r in structure.suggested_cells(items).orderBy("col_no").collect()] == [(1, 1, "TH", "a"), (1, 2, "TD", "b")]
