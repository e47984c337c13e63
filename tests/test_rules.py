"""Rules at their thresholds, on rows made by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkstone.functions import quality, text as T
from inkstone.operators import detect, edge, layout, ledger, lines, structure
from inkstone.sources import bridge

BLOCK = "doc_id long, page_num long, block_seq int, text string, x double, y double, width double, height double, font_size double, is_bold boolean"


def block(seq, y, x=0.0, text="t", page=1, doc=1, width=50.0, height=10.0, size=12.0, bold=False):
    return (doc, page, seq, text, float(x), float(y), float(width), float(height), float(size), bold)


@pytest.fixture(scope="module")
def blocks(spark):
    return lambda rows: spark.createDataFrame(rows, BLOCK)


def column(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_list_marks(spark):
    yes = ["1. a", "(2) a", "א. ב", "a) x", "• x", "- x", "iv. x", "X. x", '"term" - meaning', "”מונח” – פירוש"]
    no = ["1.a", "1.1. a", "xii. x", "•x", "word. x", "ך. x", ""]
    assert column(spark, T.is_list_item, yes) == [True] * len(yes)
    assert column(spark, T.is_list_item, no) == [False] * len(no)


def test_clauses(spark):
    assert column(spark, T.clause_level, ["1. a", "1.1. a", "1.1.1. a", "1.1.1.1. a", "1.a", "a", ""]) == [1, 2, 3, 3, None, None, None]


def test_key_values_and_sections(spark):
    assert column(spark, T.is_key_value, ["Name: x", "a b c d e f: x", "a b c d e f g: x", "x" * 45 + ": v", "x" * 46 + ": v", "k:", "no colon", "k：v"]) == [True, True, False, True, False, False, False, True]
    assert column(spark, T.is_section, ["נוכחים:", "x" * 60 + ":", "x" * 61 + ":", "a: b", "a:  "]) == [True, True, False, False, True]


def test_signatures_and_scripts(spark):
    assert column(spark, T.is_signature, ["Signed by", "חתימה", "___", "____", "-" * 4, "x" * 77 + "____", "x" * 76 + "____", ""]) == [True, True, False, True, True, False, True, False]
    assert column(spark, T.is_hebrew, ["אב ab", "אב abc", "123", "א"]) == [True, False, False, True]
    assert column(spark, T.strip_mark, ["1. item", "• point", "א) דבר", "plain"]) == ["item", "point", "דבר", "plain"]
    assert column(spark, T.title_of, ["a-b_c.v2.pdf", "plain"]) == ["a b c.v2", "plain"]


def test_edge_rules(spark):
    assert column(spark, T.edge_is_numbered, ["1.2.3 x", "(4) x", "5x", "א) x", "b) x"]) == [True, True, False, True, True]
    assert column(spark, T.edge_depth, ["1 x", "1.2 x", "1.2.3.4 x", "x"]) == [1, 2, 3, 1]
    assert column(spark, T.edge_is_row, ["a|b|c", "a | b", "a\tb", "1 and 2", "only 1", "x" * 43 + "|b"]) == [True, True, True, True, False, False]
    assert column(spark, T.repeat_key, ["Page 3 of  12", "On 1/2/2020 At"]) == ["page # of #", "on #date at"]


def test_quality(spark):
    got = spark.createDataFrame([("",), ("ab {}",), ("word ?? a 12",), ("aaaaaa ok",), ("��ok",)], "t string").select(quality.bad_char_ratio(F.col("t")).alias("b"), quality.gibberish_ratio(F.col("t")).alias("g"), quality.edge_gibberish_ratio(F.col("t")).alias("e"), quality.foreign_ratio(F.col("t")).alias("f")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 0.0, 0.0), (0.5, 0.5, 0.0, 0.0), (0.0, 0.5, 0.0, 0.0), (0.0, 0.0, 0.5, 0.0), (0.5, 0.0, 1.0, 0.5)]
    gate = spark.createDataFrame([(0.62, 0.22, 0.35, 24.0, True), (0.61, 0.22, 0.35, 24.0, False), (0.62, 0.23, 0.35, 24.0, False), (0.62, 0.22, 0.36, 24.0, False), (0.62, 0.22, 0.35, 23.9, False)], "c double, b double, g double, p double, ok boolean")
    assert gate.filter(quality.quality_ok(F.col("c"), F.col("b"), F.col("g"), F.col("p")) != F.col("ok")).count() == 0
    assert column(spark, quality.scanned_class, ["x" * 29, "x" * 30, "?" * 6 + "x" * 24, "?" * 7 + "x" * 24]) == ["review_required", "basic_accessible_scanned", "basic_accessible_scanned", "review_required"]


def test_policies(spark):
    rows = spark.createDataFrame([(30,), (31,), (100,), (101,), (1000,)], "p int").select(quality.dpi(F.col("p")), quality.job_timeout(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(150, 420), (120, 424), (120, 700), (100, 704), (100, 3600)]
    scores = spark.createDataFrame([(59,), (60,), (84,), (85,)], "s int").select(quality.status_of(F.col("s")).alias("s")).collect()
    assert [r.s for r in scores] == ["non_compliant", "needs_review", "needs_review", "compliant"]
    table = spark.createDataFrame([(False, False, "compliant", "x"), (False, False, "needs_review", "x"), (False, True, "compliant", "x"), (True, True, "x", "review_required"), (True, True, "x", "basic_accessible_scanned"), (True, False, "x", "x")], "f boolean, s boolean, st string, c string")
    a = [F.col(c) for c in ("f", "s", "st", "c")]
    got = table.select(quality.service_status(*a).alias("a"), quality.service_score(a[0], a[1], F.lit(90), a[3]).alias("b")).collect()
    assert [tuple(r) for r in got] == [("full_accessible", 90), ("needs_review", 90), ("basic_accessible_scanned", 75), ("review_required", 45), ("basic_accessible_scanned", 65), ("review_required", 45)]


def test_reading_order_is_by_the_first_of_a_line(blocks):
    rows = [block(1, 0), block(2, 6, 30), block(3, 12), block(4, 13, 40), block(1, 0, page=2)]
    got = {(r.page_num, r.block_seq): (r.line, r.place) for r in layout.reading_order(blocks(rows)).collect()}
    assert got == {(1, 2): (1, 1), (1, 1): (1, 2), (1, 4): (2, 3), (1, 3): (2, 4), (2, 1): (1, 5)}


def test_running_blocks_need_pages(blocks):
    two = [block(1, 5, page=p) for p in (1, 2)]
    assert layout.without_running(blocks(two)).count() == 2
    ten = [block(1, 5 if p <= 4 else 100 * p, page=p) for p in range(1, 11)]
    assert layout.running_blocks(blocks(ten)).count() == 4
    nine = [block(1, 5 if p <= 2 else 100 * p, page=p) for p in range(1, 10)]
    assert layout.running_blocks(blocks(nine)).count() == 0


def test_chain_clusters(spark):
    df = spark.createDataFrame([(1, 1, v) for v in (0.0, 4.0, 8.0, 12.0, 12.0, 16.1)], "doc_id int, page_num int, v double")
    assert sorted((r.centre, r.n) for r in layout.chain_clusters(df, "v", ["doc_id", "page_num"]).collect()) == [(6.0, 4), (16.1, 1)]


def test_ruled_grid(spark, blocks):
    rules = spark.createDataFrame([(1, 1, 0.0, y, 200.0, y) for y in (0.0, 20.0, 40.0)] + [(1, 1, x, 0.0, x, 40.0) for x in (0.0, 100.0, 200.0)], "doc_id long, page_num long, x0 double, y0 double, x1 double, y1 double")
    rows = [block(1, 2, 110, "right head"), block(2, 2, 10, "left head"), block(3, 22, 110, "right"), block(4, 24, 96, "astride", width=8), block(5, 100, 0, "out")]
    got = {(r.row_no, r.col_no): (r.role, r.text) for r in layout.border_tables(blocks(rows), rules).collect()}
    assert got == {(1, 1): ("TH", "right head"), (1, 2): ("TH", "left head"), (2, 1): ("TD", "right astride"), (2, 2): ("TD", "astride")}
    assert layout.grid_cells(rules.filter("y0 = 0 and x1 > x0")).count() == 0


def test_aligned_tables(blocks):
    rows = [block(1, 0, 0), block(2, 0, 100), block(3, 20, 5), block(4, 20, 110), block(5, 40, 0), block(6, 60, 0), block(7, 60, 100), block(8, 60, 200), block(9, 80, 0)]
    got = sorted((r.table_no, r.row_no, r.col_no, r.block_seq) for r in layout.aligned_tables(blocks(rows)).collect())
    assert got == [(1, 1, 1, 2), (1, 1, 2, 1), (1, 2, 1, 4), (1, 2, 2, 3)]


def test_key_value_runs_restart_one_further(blocks):
    rows = [block(1, 0, 100, "a: 1"), block(2, 10, 0, "b: 2"), block(3, 20, 10, "c: 3"), block(4, 30, 24, "d: 4"), block(5, 40, 0, "none")]
    assert [(r.run_no, r.row_no, r.block_seq, r.label) for r in layout.key_value_runs(blocks(rows)).orderBy("row_no").collect()] == [(1, 1, 2, "b"), (1, 2, 3, "c"), (1, 3, 4, "d")]


def test_implied_lists(blocks):
    head = [block(1, 0, text="Title", size=30), block(2, 30, text="Second", size=30)]
    items = [block(3 + i, 100 + 20 * i, text=f"item number {i}") for i in range(4)]
    far = [block(9, 400, text="far away")]
    got = layout.implied_lists(layout.list_candidates(blocks(head + items + far))).collect()
    assert sorted((r.list_no, r.item_no, r.block_seq) for r in got) == [(1, 1, 3), (1, 2, 4), (1, 3, 5), (1, 4, 6)]


def test_headings(blocks):
    rows = [block(1, 10, text="Document title"), block(2, 30, text="Part:"), block(3, 41, text="plain text of the page"), block(4, 52, text="bold words", bold=True), block(5, 200, text="after a gap", bold=True), block(6, 211, text="1. item", bold=True)]
    got = {r.block_seq: r.level for r in layout.headings(blocks(rows)).collect()}
    assert got[1] == 1 and got[2] == 2 and got[3] is None and got[4] == 3 and got[5] == 1 and got[6] is None


def test_detection_routes(spark, blocks):
    rows = [block(1, 10, text="Document title"), block(2, 40, text="1. first thing"), block(3, 60, text="2. second thing"), block(4, 80, text="a long paragraph " * 10), block(5, 100, text="signed here")]
    one = [(e.elem_type, e.text) for e in detect.detect(blocks(rows)).orderBy("ord").collect()]
    assert one == [("H1", "Document title"), ("L", ""), ("P", ("a long paragraph " * 10).strip()), ("Figure", "Signature")]
    types = spark.createDataFrame([(1, "legal")], "doc_id long, doc_type string")
    two = [(e.elem_type, e.text) for e in detect.detect(blocks(rows), types=types).orderBy("ord").collect()]
    assert two[1:3] == [("H1", "1. first thing"), ("H1", "2. second thing")]


def test_cells_of_detected_tables(spark, blocks):
    rows = [block(1, 10, 300, "b"), block(2, 10, 100, "a"), block(3, 30, 300, " d "), block(4, 30, 100, "c"), block(5, 200, text="Name: x"), block(6, 220, text="Town: y"), block(7, 240, text="Date: z")]
    got = sorted((r.table_no, r.source, r.row_no, r.col_no, r.role, r.scope, r.text) for r in detect.table_cells(blocks(rows)).fillna("", ["scope"]).collect())
    assert got[:4] == [(1, "align", 1, 1, "TH", "Col", "b"), (1, "align", 1, 2, "TH", "Col", "a"), (1, "align", 2, 1, "TD", "", "d"), (1, "align", 2, 2, "TD", "", "c")]
    assert got[4:] == [(2, "keyvalue", i + 1, c, role, scope, t) for i, pair in enumerate([("Name", "x"), ("Town", "y"), ("Date", "z")]) for c, role, scope, t in [(1, "TH", "Row", pair[0]), (2, "TD", "", pair[1])]]


def test_type_scores(spark):
    words = "פרוטוקול נוכחים החלטה ועדה".split()
    rows = [(1, 1, i, w) for i, w in enumerate(words)] + [(2, 1, i, f"{i + 1}. סעיף {i}") for i in range(5)] + [(3, 1, i, "plain words") for i in range(5)] + [(4, 1, 0, "only one")]
    got = {r.doc_id: r for r in structure.type_scores(spark.createDataFrame(rows, "doc_id long, page_num int, seq int, text string")).collect()}
    assert got[1].doc_type == "protocol" and got[1].protocol == 4 + 4 + 2 + 1
    assert got[2].doc_type == "legal" and got[2].legal == 1 + 4
    assert got[3].doc_type == "general" and got[4].doc_type == "scanned"


def found(spark, rows, **facts):
    schema = "doc_id long, ord int, elem_type string, text string, page_num int, parent_ord int, table_id int"
    e = spark.createDataFrame([(1, i, *(r + (None,) * (5 - len(r)))) for i, r in enumerate(rows)], schema)
    meta = {"lang": "he", "title": "t", "doc_type": None, "heading_candidates": 0, "list_candidates": 0, "table_candidates": 0, "kv_candidates": 0} | facts
    f = spark.createDataFrame([(1, *meta.values())], "doc_id long, lang string, title string, doc_type string, heading_candidates int, list_candidates int, table_candidates int, kv_candidates int")
    features = structure.features(e, f)
    out = structure.findings(features)
    score = structure.compliance_score(features, out).first()
    return {r.test_id for r in out.collect()}, score.score, score.status


def test_findings(spark):
    p = ("P", "x")
    assert found(spark, [p] * 4)[0] == set()
    assert found(spark, [p] * 5) == ({"PARAGRAPH_ONLY"}, 45, "non_compliant")
    assert found(spark, [p] * 6)[0] == {"PARAGRAPH_ONLY", "MCID_UNBOUND"}
    assert found(spark, [("H1", "a"), ("H3", "b")])[0] == {"HEADING_LEVEL_SKIP"}
    assert found(spark, [("H2", "a"), ("H3", "b"), ("H1", "c")])[0] == {"FIRST_HEADING_NOT_H1"}
    assert found(spark, [("LI", ""), p])[0] == {"LI_EMPTY"}
    assert found(spark, [("Table", ""), p])[0] == {"TABLE_NO_CELLS", "TABLE_NO_TH"}
    assert found(spark, [("Table", ""), ("TD", "x", None, 0, 0)])[0] == {"TABLE_NO_TH"}
    assert found(spark, [p], lang=" ", title="")[0] == {"LANG_MISSING"}
    assert found(spark, [p], lang="en", title="")[1:] == (80, "needs_review")
    assert found(spark, [p], kv_candidates=3) == ({"KV_FLAT_PARAGRAPHS"}, 100, "needs_review")
    assert found(spark, [p], heading_candidates=1)[0] == {"HEADINGS_LOST", "HEADING_CANDIDATES_LOST"}
    assert found(spark, [p], doc_type="protocol")[0] == {"PROTOCOL_NO_HEADING", "PROTOCOL_NO_LIST"}
    assert found(spark, [p], doc_type="form")[0] == {"FORM_FIELDS_UNTAGGED"}
    jumps = lambda n: [("H1", "x", page) for k in range(n) for page in (9, 1)]
    assert found(spark, jumps(1))[0] == {"READING_ORDER_SUSPECT"}
    assert "READING_ORDER_BROKEN" in found(spark, jumps(4))[0]
    assert found(spark, [("H1", "x", 3), ("P", "y", 2)])[0] == set()


def test_ocr_findings(spark):
    rows = [(1, 1, "fine", 39.9), (2, 1, "fine", 40.0), (2, 2, " ", 60.0), (3, 1, "", None), (4, 1, "日" * 15 + "a" * 85, 60.0), (5, 1, "日" * 30 + "a" * 70, None)]
    got = {(r.doc_id, r.test_id) for r in lines.ocr_findings(spark.createDataFrame(rows, "doc_id long, page_num int, text string, confidence double")).collect()}
    assert got == {(1, "OCR_LOW_CONFIDENCE"), (2, "OCR_EMPTY_PAGES"), (2, "OCR_MEDIUM_CONFIDENCE"), (3, "OCR_EMPTY_PAGES"), (4, "OCR_POOR_QUALITY"), (5, "OCR_GIBBERISH")}


def test_ocr_lines(spark):
    schema = "doc_id long, page_num int, word_seq int, level int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf int, text string, dpi int"
    rows = [(1, 1, 1, 5, 1, 1, 1, 100, 10, 50, 20, 90, " one", 144), (1, 1, 2, 5, 1, 1, 1, 160, 12, 40, 20, 20, "two", 144), (1, 1, 3, 5, 1, 1, 2, 0, 50, 0, 0, 50, "dot", 0), (1, 1, 4, 5, 1, 1, 2, 0, 50, 9, 9, 19, "no", 0), (1, 1, 5, 5, 1, 1, 2, 0, 50, 9, 9, 50, "  ", 0), (1, 1, 6, 4, 1, 1, 3, 0, 0, 9, 9, -1, "line", 0)]
    df = spark.createDataFrame(rows, schema)
    got = [(r.text, r.x, r.y, r.width, r.height, r.font_size) for r in bridge.ocr_lines(df).orderBy("block_seq").collect()]
    assert got == [("one two", 50.0, 5.0, 50.0, 11.0, 8.25), ("dot", 0.0, 18.0, 1.0, 1.0, 6.0)]
    assert bridge.ocr_confidences(df).first().confidence == round((90 + 20 + 50 + 19) / 4 / 100, 4)


def test_marks(spark):
    leaf = "doc_id long, page_num int, ord int, text string"
    leaves = spark.createDataFrame([(1, 1, 0, "alpha beta"), (1, 1, 1, "alpha beta"), (1, 1, 2, "zzz"), (1, 1, 3, "q")], leaf)
    marks = spark.createDataFrame([(1, 1, 0, "gamma"), (1, 1, 1, "alphabeta"), (1, 1, 2, "alpha beta")], leaf.replace("ord", "mcid"))
    got = {r.ord: (r.mcid, r.by_text) for r in structure.assign_marks(structure.mark_scores(leaves, marks), leaves, marks).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (0, False)}
    claims = spark.createDataFrame([(1, 1, 0, 7), (1, 1, 0, 5)], "doc_id long, page_num int, mcid int, ord int")
    assert {(r.mcid, r.owner, r.by_section) for r in structure.owners(marks, claims).collect()} == {(0, 5, False), (1, None, True), (2, None, True)}
    assert {r.mcid for r in structure.unclaimed(marks, claims).collect()} == {1, 2}


def test_export_checks(spark):
    schema = "doc_id long, lang string, title string, pdfua boolean, marked boolean, display_title boolean, tree boolean, kids boolean, parent_tree boolean, tabs boolean, struct_parents boolean, marks boolean, xmp boolean, images int, figures int, alts int"
    rows = [(1, "he", "t", *[True] * 10, 2, 2, 1), (2, "h", " ", True, True, True, True, False, True, True, True, False, True, 1, 1, 0), (3, None, None, *[False] * 10, 1, 0, 0)]
    checks = structure.export_checks(spark.createDataFrame(rows, schema))
    failed = {i: {r.name for r in checks.filter(f"doc_id = {i} and not passed").collect()} for i in (1, 2, 3)}
    assert failed[1] == set() and failed[2] == {"Document title", "Language", "Structure tree children"} and len(failed[3]) == 13
    assert {r.doc_id: (r.score, r.passed) for r in structure.pass_rate(checks).collect()} == {1: (100, True), 2: (77, False), 3: (0, False)}


def test_edge_documents(spark):
    texts = ["Annual report", "a | b | c", "1 | 2 | 3", "Name: x", "Town: y", "Date: z", "1. one item here", "2. two items here", "This is a paragraph that goes on and on, long enough to be nothing but a paragraph of its own here.", "Signed by me"]
    docs = spark.createDataFrame([(1, "\n".join(texts), "")], "doc_id long, text string, source string")
    got = [(r.elem_type, r.n_items) for r in edge.documents(bridge.text_lines(docs)).orderBy("ord").collect()]
    assert got == [("H1", 0), ("Table", 2), ("Table", 3), ("L", 2), ("P", 0), ("Figure", 0)]
    plain = spark.createDataFrame([(2, "x" * 96 + "\nsmall words, and more of them. and more still, so it is long", "")], "doc_id long, text string, source string")
    assert [r.elem_type for r in edge.documents(bridge.text_lines(plain)).orderBy("ord").collect()].count("H1") == 1


def test_edge_rows(spark):
    rows = [(1, 1, i, t, x, y, 10.0, 12.0, False) for i, (t, x, y) in enumerate([("b", 50.0, 700.0), ("a", 10.0, 703.5), ("c", 10.0, 696.4), ("d", 0.0, 500.0)])]
    got = [(r.text, r.cell_texts) for r in edge.grouped_rows(spark.createDataFrame(rows, "doc_id long, page_num int, line_index int, text string, x double, y double, width double, font_size double, bold boolean")).orderBy("row_no").collect()]
    assert got == [("a b", ["a", "b"]), ("c", None), ("d", None)]


def test_scanned_pdf(spark):
    page, image = "/Type /Page ", "/Subtype /Image "
    text = lambda n: f"({'x' * n}) Tj "
    assert column(spark, T.scanned_pdf, [page + image + text(49), page + image + text(50), page + text(19), page + text(20), ""]) == [True, False, True, False, False]


def test_ledger_on_nothing(spark):
    none = spark.createDataFrame([], "id long, original_name string, file_size long, pages long, status string, created_at timestamp_ntz, processing_time_seconds double, validation_report string")
    row = ledger.stats(none).first()
    assert (row.total_documents, row.success_rate, row.total_pages, row.avg_processing_time_seconds) == (0, 0.0, 0, 0.0)
    logs = spark.createDataFrame([(1, 7, "start", "processing"), (2, 7, "end", "done")], "id long, job_id long, operation string, status string").withColumn("timestamp", F.current_timestamp())
    states = ledger.states_of(spark.createDataFrame([(7,), (8,)], "job_id long"), logs)
    assert {r.job_id: (r.status, r.progress) for r in states.collect()} == {7: ("done", 100), 8: ("processing", 5)}
    assert ledger.report(none, spark.createDataFrame([(1,)], "id long")).first().state == "not_found"


def test_streaming_alerts(spark, data, tmp_path):
    from inkstone.streaming import alerts

    logs = bridge.operation_logs(spark, data)
    logs.write.parquet(str(tmp_path / "logs"))
    stream = alerts.hourly_alerts(spark.readStream.schema(logs.schema).parquet(str(tmp_path / "logs")))
    query = stream.writeStream.format("memory").queryName("alerts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.hour, r.total, r.failures, r.rate, r.alert) for r in spark.table("alerts").collect()}
    assert got == {(r.hour, r.total, r.failures, r.rate, r.alert) for r in ledger.hourly_alerts(logs).collect()}
