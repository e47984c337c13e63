"""Rules walked a document at a time: one exchange, batches that part documents, running lines."""

import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import edge
from inkstone.operators import lines as L
from inkstone.sources import bridge



def paged(spark, n=130):
    """Document 1: pages of 40 lines with one header, numbered differently; document 2: one page; 3: none."""
    body = [f"Report 2024-01-{i // 40 + 10} page {i // 40}" if i % 40 == 0 else f"line {''.join(chr(97 + int(d)) for d in str(i)) * 20} of the text that goes on for a while, {i}." for i in range(n)]
    return spark.createDataFrame([(1, "\n".join(body)), (2, "Report 2024-01-10 page 0\nmore"), (3, None), (None, "left out")], "doc_id long, text string")


def test_edge_documents_deal_out_lines_once(spark):
    df = edge.documents(bridge.text_lines(paged(spark)))
    said = df._jdf.queryExecution().toString()
    assert said.split("== Physical Plan ==")[1].count("Exchange") == 1 and "Join" not in said and "FlatMapGroups" not in said


def test_edge_counters_add_no_join(spark):
    df = edge.counters(edge.documents(bridge.text_lines(paged(spark))))
    said = df._jdf.queryExecution().toString()
    assert "Join" not in said and "FlatMapGroups" not in said
    assert {r.doc_id: (r.artifacts, r.headings) for r in df.collect()}[1] == (4, 1)


def odd_lines(spark):
    """Two documents of blocks with and without cells, sizes, widths and gaps that are missing, and texts of every kind."""
    texts = ["Report 2024-01-1 page 1", "x|y", "signed", "Name: a", "Phone: 1", "Town: b", "1. one", "1.1 two", "a) three", "| a | b |", "| 1 | 2 | 3 |", "", None, "word", "words", "other", "a\tb", "a  b  c", "12 and 13", "long " * 40 + "7", "short:", "Ende.", "______", "tail"]
    rows = []
    for doc in (1, 2, None):
        for i in range(120):
            t = texts[(i * 7 + i // 24 if doc == 1 else i) % 24] if i % 12 else f"Head {i}"
            cells = ([t, "v"] if i % 5 == 0 else [t, "v", ""], [0.0, 90.0, 180.0][: 2 + (i % 5 > 0)]) if t and doc == 1 and i % 9 in (3, 4, 5) else (None, None)
            rows.append((doc, i // 12 + 1 if i != 50 else None, i % 12, t, float(i % 4 * 12), 200.0 if i % 3 else None, 10.0 + i % 6 if i % 19 else None, i % 7 == 0 if i % 23 else None, 14.0 * (i % 3) if i % 13 else None, *cells))
    return spark.createDataFrame(rows, "doc_id long, page_num int, line_index int, text string, x double, width double, font_size double, bold boolean, gap_before double, cell_texts array<string>, cell_xs array<double>")


@pytest.mark.parametrize("ratio, group", [(0.5, "doc_id"), (0.1, "doc_id"), (0.5, "source")])
def test_counters_from_lines_are_those_of_elements(spark, ratio, group):
    for lines in (odd_lines(spark), bridge.text_lines(paged(spark))):
        lines = lines.withColumn("source", F.lit("s"))
        expected = edge.counters(edge.documents(lines, ratio, group))
        got = edge.document_counters(lines, ratio, group)
        assert got.columns == expected.columns and [t for _, t in got.dtypes] == [t for _, t in expected.dtypes]
        assert sorted(got.collect()) == sorted(expected.collect()) and got.count() == 2
    total = edge.document_counters(odd_lines(spark)).groupBy().sum().first()
    assert all(total[f"sum({c})"] > 0 for c in got.columns), total


def test_edge_counters_deal_out_no_long_texts(spark, data):
    """Counting needs no element: neither texts nor cells go to Python, and only texts of lines that may run are dealt out."""
    from inkstone.plans import catalog

    df = catalog.QUERIES["edge_counters"](spark, data)
    said = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    walk = next(i for i, x in enumerate(said) if "MapInArrow" in x)
    dealt = next(i for i, x in enumerate(said) if "RepartitionByExpression" in x)
    above = "\n".join(said[walk:dealt])
    assert "text#" not in above and "cells#" not in above.replace("n_cells#", "") and "clean#" not in above
    expected = catalog.QUERIES["edge_documents"](spark, data)
    assert sorted(df.collect()) == sorted(edge.counters(expected).collect())


def test_columns_are_listed_as_they_are():
    import pyarrow as pa

    from inkstone.operators.walk import _listed

    for values, kind in (([1, None, 2**62], pa.int64()), ([1, 2], pa.int32()), ([True, None], pa.bool_()), ([True, False], pa.bool_()), ([None, None], pa.string()), (["a", None, ""], pa.string()), ([["a", None], None], pa.list_(pa.string())), ([None], pa.bool_()), ([], pa.int64())):
        got = _listed(pa.array(values, kind))
        assert got == values and [type(x) for x in got] == [type(x) for x in values]
    assert str(_listed(pa.array([1.5, None], pa.float64()))) == "[1.5, nan]"


def test_texts_are_split_and_cleaned_as_by_patterns(spark):
    texts = ["a\r\nb\r\r\nc\rd\n\n e ", "\r\n", "", None, *(f"x{b}{b}y{b}\n{b}z" for b in T.BLANKS), "é–ü\u3000x", "”q“\r"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1), T.clean), lambda t: t != "")
    expected = sorted((r.doc_id, r.text) for r in df.select("doc_id", F.explode(old).alias("text")).collect())
    got = bridge.text_lines(df)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == expected
    few = {(r.doc_id, r.line_index): r.width for r in bridge.text_lines(df, measured=1).collect()}
    assert {(r.doc_id, r.line_index): r.width if len(r.text) <= 1 else None for r in got.collect()} == few


def test_key_and_value_looks_for_a_colon_first(spark):
    texts = ["a: b", "ab: c", "ab：c", "ab:", "ab: ", "x" * 40 + ":y", "x" * 41 + ":y", "é😀: z", "😀" * 40 + ":y", "a:b:c", ": a", "no", "", None]
    t = F.col("t")
    for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.clean(t).rlike(T.EDGE_KEY_VALUE), T.edge_is_key_value(t)).collect():
        assert r[1] == r[2], r


@pytest.mark.parametrize("rows", [7, 10000])
def test_running_lines_of_documents_that_batches_part(spark, rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        got = edge.documents(bridge.text_lines(paged(spark))).orderBy("doc_id", "ord").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = {(r.doc_id, r.key) for r in L.repeated_lines(bridge.text_lines(paged(spark))).collect()}
    artifacts = [r for r in got if r.elem_type == "Artifact"]
    assert expected == {(1, "report #date page #")} and [(r.doc_id, r.page_num) for r in artifacts] == [(1, p) for p in (1, 2, 3, 4)]
    assert [r.ord for r in got if r.doc_id == 1] == list(range(130)) and {r.doc_id for r in got} == {1, 2}


def test_fast_forms_of_text_rules_agree(spark):
    texts = ["", " ", "a b", "a  b", " a　　b ", "a\tb\r", "x   y", "é à ü", "SiGnature", "a sígn", "חתום", "____", "__", "מאשר x", "1) a", "(1.2.3)  b", "1. ", "ab12.3/4 c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    old_sign = T.clean(t).rlike(T.EDGE_SIGNATURE) | T.clean(t).rlike("^_{3,}")
    old_unmarked = T.clean(F.regexp_replace(t, T.EDGE_NUMBERED, ""))
    old_count = F.length(t) - F.length(F.regexp_replace(t, "[A-Za-z0-9]", ""))
    for r in df.select("t", T.clean(t), T.cleaned(t), old_sign, T.edge_is_signature(t), old_unmarked, T.edge_unmarked(t), old_count, T.count(t, "[A-Za-z0-9]")).collect():
        assert r[1] == r[2] and r[3] == r[4] and r[5] == r[6] and r[7] == r[8], r


def test_strip_and_words_of_every_blank(spark):
    texts = ["", *(f"{b}a{b}{b}b c{b}" for b in T.BLANKS), T.BLANKS, "a", "\u200bx ", "é\r\n", None]
    t = F.col("t")
    old = F.regexp_replace(F.regexp_replace(t, f"^{T.WS}+", ""), f"{T.WS}+$", "")
    for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", old, T.strip(t), F.size(T.words(t)), T.n_words(t)).collect():
        assert r[1] == r[2] and r[3] == r[4], r


def blocks(spark, rows):
    return spark.createDataFrame([(d, p, s, t, x, y, 50.0, 10.0, 10.0, False) for d, p, s, t, x, y in rows], "doc_id long, page_num long, block_seq int, text string, x double, y double, width double, height double, font_size double, is_bold boolean")


def test_walks_of_blocks_make_no_frame_for_each_document(spark):
    from inkstone.operators import layout

    rows = [(1, 1, i, "Name: a" if i != 4 else "x", 0.0, 20.0 * i) for i in range(1, 9)] + [(2, 1, i, "word", 0.0, 20.0 * i) for i in range(1, 6)]
    pairs = layout.key_value_runs(blocks(spark, rows))
    assert [(r.doc_id, r.run_no, r.row_no, r.block_seq) for r in pairs.orderBy("doc_id", "run_no", "row_no").collect()] == [(1, 1, i, i) for i in (1, 2, 3)] + [(1, 2, i, i + 4) for i in (1, 2, 3, 4)]
    held = blocks(spark, rows).withColumn("place", F.col("block_seq") * 10).withColumn("candidate", F.col("block_seq") != 2).withColumn("n_chars", F.lit(4))
    lists = layout.implied_lists(held)
    assert [(r.doc_id, r.list_no, r.block_seq) for r in lists.orderBy("doc_id", "block_seq").collect()] == [(1, 1, i) for i in range(3, 9)] + [(2, 1, i) for i in (3, 4, 5)]
    for df in (pairs, lists):
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
