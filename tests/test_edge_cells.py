"""Cells of positioned rows, header rows and marked content."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.operators import edge
from inkstone.sources import content

SCHEMA = "doc_id long, page_num int, line_index int, text string, x double, y double, width double, font_size double, bold boolean"


def built(spark, *rows):
    """Elements of one page, from rows of (text, x) cells, 30 points apart."""
    cells = [(t, x, 700.0 - 30 * n) for n, row in enumerate(rows) for t, x in row]
    raw = spark.createDataFrame([(1, 1, i, t, x, y, 40.0, 12.0, False) for i, (t, x, y) in enumerate(cells)], SCHEMA)
    return edge.documents(edge.row_lines(edge.grouped_rows(raw))).orderBy("ord").collect()


def table(element):
    return [(c.row_no, c.col_no, c.type, c.text) for c in element.cells]


def test_positioned_cells_are_a_table(spark):
    long = "a cell of words that goes on and on for more than fifty characters"
    got = built(spark, [("Place", 10.0), ("Count", 200.0)], [("north", 12.0), ("12", 205.0)], [(long, 10.0), ("7", 200.0)], [("south", 11.0), ("9", 200.0)])
    assert [(e.elem_type, e.n_items) for e in got] == [("Table", 4)]
    assert table(got[0])[:4] == [(0, 0, "TH", "Place"), (0, 1, "TH", "Count"), (1, 0, "TD", "north"), (1, 1, "TD", "12")]


def test_positioned_pairs_are_header_cells(spark):
    long = "an answer in words that goes on and on for more than fifty characters"
    got = built(spark, [("name", 10.0), (long, 100.0)], [("town", 10.0), (long, 160.0)], [("date", 10.0), (long, 220.0)])
    assert [(e.elem_type, e.n_items) for e in got] == [("Table", 3)]
    assert table(got[0])[:2] == [(0, 0, "TH", "name"), (0, 1, "TD", long)]


def test_items_have_depth_and_no_marks(spark):
    rows = [(1, 1, i, t, x, 700.0 - 12 * i, 300.0, 12.0, False, 0.0) for i, (t, x) in enumerate([("1. first item of the list", 10.0), ("1.1 an item below the first", 10.0), ("(2) an item set in by far", 60.0), ("a) an item set in a little", 20.0)])]
    got = edge.documents(spark.createDataFrame(rows, SCHEMA + ", gap_before double")).collect()
    assert [(e.elem_type, e.n_items, e.of_pairs) for e in got] == [("L", 4, False)]
    assert [(x.text, x.depth) for x in got[0]["items"]] == [("first item of the list", 1), ("an item below the first", 2), ("an item set in by far", 3), ("an item set in a little", 1)]


def test_pair_tables_are_counted(spark):
    rows = [(1, 1, i, t, 10.0, 700.0 - 12 * i, 300.0, 12.0, False, 0.0) for i, t in enumerate(["Name: x", "Town: y", "Date: z"])]
    got = edge.counters(edge.documents(spark.createDataFrame(rows, SCHEMA + ", gap_before double"))).first()
    assert (got.tables, got.pair_tables, got.lists) == (1, 1, 0)


def test_same_columns(spark):
    cases = [([0.0, 50.0], [16.0, 66.0], True), ([0.0, 50.0], [17.0, 50.0], False), ([0.0, 50.0, 90.0], [0.0, 50.0], True), ([0.0, 1.0, 2.0, 3.0], [0.0, 1.0], False), ([0.0], [0.0], False), (None, [0.0, 1.0], False), ([0.0, 50.0, 90.0], [0.0, 50.0, 190.0], True)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<double>, b array<double>")
    got = [r.s for r in frame.select("i", edge.same_columns(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_header_rows():
    assert edge.has_header([["a", "b"], ["1", "2"]])
    assert not edge.has_header([["1", "b"], ["1", "2"]])
    assert not edge.has_header([["a", "b", "3"], ["x", "y", "z"]])
    assert not edge.has_header([["a" * 51, "b"], ["1", "2"]])
    assert not edge.has_header([["a", "b"]])


def test_markers(spark):
    streams = ["/P <</MCID 0>> BDC\nEMC\n/H1 <</Lang (x) /MCID 12>> BDC EMC /Artifact <</Type /Pagination>> BDC", "BT (x) Tj ET", "", None]
    rows = spark.createDataFrame(list(enumerate(streams)), "i int, s string").select("i", content.markers(F.col("s")).alias("m"), content.unmarked(F.col("s")).alias("u")).orderBy("i").collect()
    assert [[tuple(m) for m in r.m] for r in rows] == [[("P", 0), ("H1", 12)], [], [], []]
    assert [r.u for r in rows] == [False, True, False, False]
