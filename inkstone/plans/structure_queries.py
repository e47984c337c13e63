"""Registered queries on element rows, findings and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import detect, edge, lines, structure as S
from inkstone.plans.staging import stage
from inkstone.plans.text_queries import listed, matches, repeat_key
from inkstone.sources import bridge
from inkstone.sources.bridge import ELEMENTS_SQL, FACTS_SQL, LINES_SQL

#: A lexicon in the test data's own words, where the built-in one finds nothing.
LEXICON = {"protocol": ("the", "and", "of", "with"), "legal": ("de", "la", "les", "que", "est"), "workplan": ("der", "die", "und"), "form": ("el", "los", "por", "con")}
FIRST_PAGE = {"protocol": ((4, ("the and",)),), "legal": ((3, ("de la", "la de")),), "form": ((3, ("por el",)),)}


def elements(spark, sf_dir):
    return bridge.html_elements(bridge.table(spark, sf_dir, "pages"))


def facts(spark, sf_dir):
    return bridge.page_facts(bridge.table(spark, sf_dir, "pages"))


def features(spark, sf_dir):
    """Features of pages, typed in turn by their number, so that rules by type have work."""
    kinds = F.array(*[F.lit(t) for t in (*S.TYPES, "general")])
    typed = facts(spark, sf_dir).withColumn("doc_type", F.element_at(kinds, (F.pmod("doc_id", F.lit(6)) + 1).cast("int")))
    return S.features(elements(spark, sf_dir), typed.withColumn("table_candidates", F.when(F.pmod("doc_id", F.lit(10)) == 0, 1).otherwise(0)))


def findings(spark, sf_dir):
    return S.findings(features(spark, sf_dir))


def gate(spark, sf_dir):
    return S.gate(findings(spark, sf_dir))


def compliance(spark, sf_dir):
    f = stage(features(spark, sf_dir), "features")
    return S.compliance_score(f, S.findings(f))


def export_facts(spark, sf_dir):
    """What a page offers in place of each fact of an exported file."""
    e = elements(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("elem_type") == "L").alias("lists"))
    html = bridge.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lower(F.coalesce("html", F.lit(""))).alias("h"))
    rows = facts(spark, sf_dir).join(html, "doc_id").join(e, "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select(
        "doc_id", "lang", "title", F.startswith("h", F.lit("<!doctype html")).alias("pdfua"), (n > 0).alias("marked"), F.col("title").isNotNull().alias("display_title"), F.contains("h", F.lit("<article")).alias("tree"), (n > 3).alias("kids"),
        F.coalesce("lists", F.lit(False)).alias("parent_tree"), F.contains("h", F.lit("<nav")).alias("tabs"), F.contains("h", F.lit("<footer")).alias("struct_parents"), F.contains("h", F.lit("<p")).alias("marks"), F.contains("h", F.lit("<meta")).alias("xmp"),
        F.lit(0).alias("images"), F.lit(0).alias("figures"), F.lit(0).alias("alts"),
    )


def export_checks(spark, sf_dir):
    return S.export_checks(export_facts(spark, sf_dir))


def type_scores(spark, sf_dir):
    rows = bridge.text_lines(bridge.table(spark, sf_dir, "documents"))
    return S.type_scores(rows.withColumn("seq", F.col("line_index")), keywords=LEXICON, bonuses=FIRST_PAGE)


def suggestions(spark, sf_dir):
    """Turns of conversations as suggested elements of every third page, some beyond those there are."""
    kind = F.when(F.col("role") == "user", "H2").when(F.col("role") == "assistant", "P").otherwise("LI")
    return bridge.table(spark, sf_dir, "conversations").select(F.pmod(F.col("conv_id") * 3, F.lit(50)).alias("doc_id"), (F.col("conv_id") * 3).alias("page_num"), F.col("turn").alias("ord"), kind.alias("elem_type"), "text")


def ai_structure_merge(spark, sf_dir):
    """Pages of paragraphs only give way to suggestions where there are any; fifty documents."""
    own = elements(spark, sf_dir).select(F.pmod("doc_id", F.lit(50)).alias("doc_id"), F.col("doc_id").alias("page_num"), F.col("ord").cast("long").alias("ord"), "elem_type", "text")
    return S.merge_suggestions(own, suggestions(spark, sf_dir))


def _leaves_and_marks(spark, sf_dir):
    """Every line of each document's pages, as a leaf and as a mark."""
    rows = bridge.text_lines(bridge.table(spark, sf_dir, "documents")).select("doc_id", "page_num", "line_index", "text")
    return rows.withColumnRenamed("line_index", "ord"), rows.withColumnRenamed("line_index", "mcid")


def mark_scores(spark, sf_dir):
    return S.mark_scores(*_leaves_and_marks(spark, sf_dir)).withColumn("score", F.round("score", 9))


def mark_assignment(spark, sf_dir):
    leaves, marks = _leaves_and_marks(spark, sf_dir)
    return S.assign_marks(S.mark_scores(leaves, marks), leaves, marks)


def flagship(spark, sf_dir):
    """From documents to verdicts: lines, running lines removed, elements, findings, score."""
    docs = bridge.table(spark, sf_dir, "documents")
    rows = stage(bridge.text_lines(docs, keep=("source",)), "lines")
    kept = stage(lines.without_repeated(rows, 0.1, "source"), "kept_lines")
    scored = lines.heading_scores(kept)
    t = F.col("text")
    kind = F.when(T.is_list_item(t), "LI").when(F.col("level").isNotNull(), F.concat(F.lit("H"), "level")).otherwise("P")
    e = kept.join(scored, ["doc_id", "page_num", "line_index"]).select("doc_id", (F.col("page_num") * 1000 + F.col("line_index")).alias("ord"), kind.alias("elem_type"), "text", "page_num")
    meta = docs.select("doc_id", "lang", F.col("source").alias("title"))
    f = stage(S.features(e, meta), "features")
    score = S.compliance_score(f, S.findings(f)).select("doc_id", "score", "status")
    labels = bridge.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return score.join(labels, "doc_id", "left").select("doc_id", "score", "status", "quality")


def structure_detection(spark, sf_dir):
    """Detected structure of all block documents, typed in turn so that every route is taken."""
    b = bridge.blocks(spark, sf_dir)
    kinds = F.array(*[F.lit(t) for t in ("general", "legal", "protocol", "workplan")])
    types = b.select("doc_id").distinct().withColumn("doc_type", F.element_at(kinds, (F.pmod("doc_id", F.lit(4)) + 1).cast("int")))
    return detect.detect(b, types=types)


def _edge_lines(spark, sf_dir):
    """Lines of documents, clean, with the widths that heading scores ask for."""
    return bridge.text_lines(bridge.table(spark, sf_dir, "documents"), measured=lines.NARROW)


def edge_documents(spark, sf_dir):
    return edge.documents(_edge_lines(spark, sf_dir), clean=True)


def edge_counters(spark, sf_dir):
    return edge.document_counters(_edge_lines(spark, sf_dir), clean=True)


def edge_rows(spark, sf_dir):
    """Rows of the block pages, seen from the bottom."""
    b = bridge.blocks(spark, sf_dir)
    return edge.grouped_rows(b.select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.col("block_seq").alias("line_index"), "text", "x", (800.0 - F.col("y")).alias("y"), "width", "font_size", F.col("is_bold").alias("bold"))).select("doc_id", "page_num", "row_no", "text", F.size("cell_texts").alias("n_cells"))


QUERIES = {
    "structure_detection": structure_detection,
    "table_cells": lambda s, d: detect.table_cells(bridge.blocks(s, d)),
    "edge_documents": edge_documents,
    "edge_counters": edge_counters,
    "edge_rows": edge_rows,
    "html_elements": elements,
    "html_facts": facts,
    "bookmarks": lambda s, d: S.bookmarks(elements(s, d)),
    "parent_tree": lambda s, d: S.parent_tree(elements(s, d)),
    "element_counts": lambda s, d: S.element_counts(elements(s, d)),
    "list_runs": lambda s, d: S.list_runs(elements(s, d)),
    "short_runs_after_heading": lambda s, d: S.name_lists(elements(s, d), lambda t: t != "", 60, 2),
    "heading_clamp": lambda s, d: S.clamped_headings(elements(s, d)),
    "structure_json_round_trip": lambda s, d: S.from_json(S.structure_json(elements(s, d))),
    "findings_structure": findings,
    "gate_verdicts": gate,
    "type_warnings": lambda s, d: S.type_warnings(features(s, d)),
    "compliance_score": compliance,
    "export_checks": export_checks,
    "export_proxy_gate": lambda s, d: S.proxy_gate(export_facts(s, d)),
    "export_pass_rate": lambda s, d: S.pass_rate(export_checks(s, d)),
    "doc_type_scores": type_scores,
    "ai_structure_merge": ai_structure_merge,
    "mark_scores": mark_scores,
    "mark_assignment": mark_assignment,
    "document_end_to_end": flagship,
}

_E = "WITH " + ELEMENTS_SQL
_F = _E + "," + FACTS_SQL + """,
leveled AS (SELECT *, CASE WHEN elem_type SIMILAR TO 'H[1-6]' THEN elem_type[2]::INT END AS level FROM elements),
stepped AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM leveled),
agg AS (
  SELECT doc_id, count(*) FILTER (elem_type NOT IN ('Artifact','Document','Sect','Div','Part','Art','Span','Link')) AS n_real,
         bool_or(elem_type <> 'P') AS has_other, bool_or(level IS NOT NULL) AS has_h, bool_or(elem_type = 'H2') AS has_h2, bool_or(elem_type = 'L') AS has_l,
         bool_or(elem_type = 'Table') AS has_t, bool_or(text <> '') AS has_text, min_by(level, ord) FILTER (level IS NOT NULL) AS first_level,
         coalesce(bool_or(level > before + 1), false) AS skips, bool_or(elem_type = 'LI' AND text = '') AS empty_li,
         count(*) FILTER (text <> '' AND (level IS NOT NULL OR elem_type IN ('P','TD','TH','Figure'))) AS unbound
  FROM stepped GROUP BY 1
),
features AS (
  SELECT f.doc_id, f.lang, f.title, ['protocol','legal','workplan','form','newsletter','general'][f.doc_id % 6 + 1] AS kind, f.doc_id % 10 = 0 AS wants_table,
         coalesce(n_real, 0) AS n_real, coalesce(has_other, false) AS has_other, coalesce(has_h, false) AS has_h, coalesce(has_h2, false) AS has_h2, coalesce(has_l, false) AS has_l,
         coalesce(has_t, false) AS has_t, coalesce(has_text, false) AS has_text, first_level, coalesce(skips, false) AS skips, coalesce(empty_li, false) AS empty_li, coalesce(unbound, 0) AS unbound
  FROM facts f LEFT JOIN agg USING (doc_id)
),
findings AS (
  SELECT doc_id, r.rule_no, r.test_id, r.severity, r.criterion FROM (
    SELECT doc_id, unnest([
      {'on': lang IS NULL, 'rule_no': 0, 'test_id': 'LANG_MISSING', 'severity': 'hard_fail', 'criterion': 'WCAG 3.1.1'},
      {'on': n_real >= 5 AND NOT has_other, 'rule_no': 1, 'test_id': 'PARAGRAPH_ONLY', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'},
      {'on': wants_table AND NOT has_t, 'rule_no': 4, 'test_id': 'TABLES_LOST', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'},
      {'on': coalesce(first_level > 1, false), 'rule_no': 5, 'test_id': 'FIRST_HEADING_NOT_H1', 'severity': 'warning', 'criterion': 'PDF/UA §7.5'},
      {'on': skips, 'rule_no': 6, 'test_id': 'HEADING_LEVEL_SKIP', 'severity': 'hard_fail', 'criterion': 'PDF/UA §7.5'},
      {'on': empty_li, 'rule_no': 9, 'test_id': 'LI_EMPTY', 'severity': 'warning', 'criterion': 'WCAG 1.3.1'},
      {'on': wants_table AND NOT has_t, 'rule_no': 10, 'test_id': 'TABLE_NOT_EXPORTED', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'},
      {'on': unbound > 5, 'rule_no': 14, 'test_id': 'MCID_UNBOUND', 'severity': 'warning', 'criterion': 'PDF/UA §7.3'},
      {'on': kind = 'protocol' AND NOT has_h, 'rule_no': 17, 'test_id': 'PROTOCOL_NO_HEADING', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'},
      {'on': kind = 'protocol' AND has_h AND NOT has_h2, 'rule_no': 18, 'test_id': 'PROTOCOL_NO_H2', 'severity': 'warning', 'criterion': 'WCAG 1.3.1'},
      {'on': kind = 'protocol' AND NOT has_l, 'rule_no': 19, 'test_id': 'PROTOCOL_NO_LIST', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'},
      {'on': kind = 'legal' AND NOT has_h, 'rule_no': 20, 'test_id': 'LEGAL_NO_HEADING', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'},
      {'on': kind = 'workplan' AND NOT has_t, 'rule_no': 21, 'test_id': 'WORKPLAN_NO_TABLE', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'},
      {'on': kind = 'newsletter' AND NOT has_h, 'rule_no': 22, 'test_id': 'NEWSLETTER_NO_HEADING', 'severity': 'warning', 'criterion': 'WCAG 1.3.1'},
      {'on': kind = 'form', 'rule_no': 23, 'test_id': 'FORM_FIELDS_UNTAGGED', 'severity': 'needs_review', 'criterion': 'WCAG 1.3.1'}]) AS r FROM features) WHERE r."on"
),
gate AS (
  SELECT doc_id, count(*) FILTER (severity = 'hard_fail') AS hard_fails, count(*) FILTER (severity = 'needs_review') AS reviews, count(*) FILTER (severity = 'warning') AS warnings
  FROM findings GROUP BY 1
)"""
_X = _E + "," + FACTS_SQL + """,
counts AS (SELECT doc_id, count(*) AS n, bool_or(elem_type = 'L') AS lists FROM elements GROUP BY 1),
checks AS (
  SELECT doc_id, k.check_no, k.name, k.passed FROM (
    SELECT f.doc_id, unnest([
      {'check_no': 1, 'name': 'PDF/UA identifier', 'passed': starts_with(h, '<!doctype html')}, {'check_no': 2, 'name': 'Tagged PDF', 'passed': coalesce(n, 0) > 0},
      {'check_no': 3, 'name': 'Document title', 'passed': title IS NOT NULL}, {'check_no': 4, 'name': 'Display document title', 'passed': title IS NOT NULL},
      {'check_no': 5, 'name': 'Language', 'passed': coalesce(length(lang) >= 2, false)}, {'check_no': 6, 'name': 'Structure tree', 'passed': contains(h, '<article')},
      {'check_no': 7, 'name': 'Structure tree children', 'passed': contains(h, '<article') AND coalesce(n, 0) > 3}, {'check_no': 8, 'name': 'Parent tree', 'passed': contains(h, '<article') AND coalesce(lists, false)},
      {'check_no': 9, 'name': 'Tab order', 'passed': contains(h, '<nav')}, {'check_no': 10, 'name': 'StructParents', 'passed': contains(h, '<footer')},
      {'check_no': 11, 'name': 'Marked content (BDC/EMC)', 'passed': contains(h, '<p') OR (contains(h, '<article') AND contains(h, '<footer'))},
      {'check_no': 12, 'name': 'XMP Metadata', 'passed': contains(h, '<meta')}, {'check_no': 13, 'name': 'Alt text', 'passed': true}]) AS k
    FROM facts f JOIN (SELECT page_id AS doc_id, lower(coalesce(html, '')) AS h FROM pages) USING (doc_id) LEFT JOIN counts USING (doc_id))
)"""
_PAIRS = LINES_SQL + """,
leaves AS (SELECT doc_id, page_num, line_index AS ord, replace(text, ' ', '') AS a FROM text_lines),
marks AS (SELECT doc_id, page_num, line_index AS mcid, replace(text, ' ', '') AS b FROM text_lines),
chars AS (SELECT *, list_distinct(string_split(a, '')) AS sa, list_distinct(string_split(b, '')) AS sb FROM leaves JOIN marks USING (doc_id, page_num)),
scores AS (SELECT doc_id, page_num, ord, mcid, len(list_intersect(sa, sb)) / greatest(len(sa), len(sb)) + CASE WHEN contains(a, b) OR contains(b, a) THEN 0.5 ELSE 0 END::DOUBLE AS score FROM chars)"""


def _hits(words: tuple[str, ...]) -> str:
    return "len(list_intersect(tokens, [" + ", ".join(f"'{w}'" for w in words) + "]))::DOUBLE"


_ITEM = " OR ".join(matches("text", p) for p in (*T.LIST_ITEM, T.DEFINITION_ITEM))
SQL = {
    "html_elements": _E + " SELECT * FROM elements",
    "html_facts": "WITH " + FACTS_SQL + " SELECT * FROM facts",
    "bookmarks": _E + """,
h AS (SELECT doc_id, ord, elem_type[2]::INT AS level, left(text, 80) AS title FROM elements WHERE elem_type IN ('H1','H2','H3'))
SELECT *, lag(ord) OVER w AS prev_ord, lead(ord) OVER w AS next_ord FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""",
    "parent_tree": _E + """
SELECT doc_id, 1 AS page_num, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS mcid, ord AS owner
FROM elements WHERE elem_type SIMILAR TO 'H[1-6]' OR elem_type IN ('P','TD','TH','LBody','Caption','Figure')""",
    "element_counts": _E + """
SELECT doc_id, count(*) AS n, count(*) FILTER (elem_type SIMILAR TO 'H[1-6]') AS headings, count(*) FILTER (elem_type = 'L') AS lists, count(*) FILTER (elem_type = 'Table') AS tables,
       round(count(*) FILTER (elem_type IN ('H1','H2','H3','Table','L')) / count(*), 9) AS semantic_ratio,
       count(*) FILTER (elem_type IN ('H1','H2','H3','Table','L')) / count(*) >= 0.08 OR count(*) < 8 AS ratio_ok
FROM elements GROUP BY 1""",
    "list_runs": _E + """,
i AS (SELECT *, sum((elem_type <> 'LI')::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM elements),
r AS (SELECT doc_id, min(ord) AS first_ord, count(*) AS n FROM i WHERE elem_type = 'LI' GROUP BY doc_id, island)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_ord) AS run_no, first_ord, n FROM r""",
    "short_runs_after_heading": _E + f""",
o AS (SELECT *, elem_type = 'P' AND text <> '' AND len({listed("text")}) <= 60 AS ok FROM elements),
i AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM o),
p AS (SELECT *, max(CASE WHEN NOT ok THEN elem_type END) OVER (PARTITION BY doc_id, island) AS opener, count(*) FILTER (ok) OVER (PARTITION BY doc_id, island) AS n FROM i)
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY island) AS list_no, ord FROM p WHERE ok AND opener IN ('H1','H2','H3') AND n >= 2""",
    "heading_clamp": "WITH RECURSIVE " + ELEMENTS_SQL + """,
h AS (SELECT doc_id, ord, elem_type[2]::INT AS level, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM elements WHERE elem_type IN ('H1','H2','H3')),
c AS (SELECT doc_id, ord, level, i, 1 AS clamped FROM h WHERE i = 1
      UNION ALL SELECT h.doc_id, h.ord, h.level, h.i, least(h.level, c.clamped + 1, 3) FROM c JOIN h ON h.doc_id = c.doc_id AND h.i = c.i + 1)
SELECT doc_id, ord, level, clamped FROM c""",
    "structure_json_round_trip": _E + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, elem_type, text, 1 AS page_num FROM elements",
    "findings_structure": _F + " SELECT * FROM findings",
    "gate_verdicts": _F + " SELECT *, hard_fails = 0 AS passed, CASE WHEN hard_fails > 0 THEN 'non_compliant' WHEN reviews > 0 THEN 'needs_review' END AS override FROM gate",
    "type_warnings": _F + """
SELECT doc_id, unnest(list_filter([CASE WHEN kind IN ('protocol','legal','newsletter') AND NOT has_h THEN kind || '_no_headings' END,
  CASE WHEN kind IN ('protocol','legal') AND NOT has_l THEN kind || '_no_lists' END, CASE WHEN kind = 'workplan' AND NOT has_t THEN 'workplan_no_tables' END,
  CASE WHEN kind = 'form' THEN 'form_fields_untagged' END], lambda w: w IS NOT NULL)) AS warning FROM features""",
    "compliance_score": _F + """,
p AS (
  SELECT doc_id, 25 AS has_struct_tree, CASE WHEN has_text THEN 35 ELSE 0 END AS has_text_layer,
         CASE WHEN lower(lang) IN ('he-il','he','iw') THEN 20 WHEN lang IS NOT NULL THEN 10 ELSE 0 END AS has_lang, CASE WHEN title IS NOT NULL THEN 10 ELSE 0 END AS has_title, 5 AS has_pdfua_xmp, 5 AS has_markinfo,
         coalesce(hard_fails, 0) AS hard, coalesce(reviews, 0) AS reviews
  FROM features LEFT JOIN gate USING (doc_id)
),
s AS (SELECT *, least(CASE WHEN hard > 0 THEN 45 ELSE 100 END, has_struct_tree + has_text_layer + has_lang + has_title + has_pdfua_xmp + has_markinfo) AS score FROM p)
SELECT * EXCLUDE (hard, reviews), CASE WHEN hard = 0 AND reviews > 0 THEN 'needs_review' WHEN score >= 85 THEN 'compliant' WHEN score >= 60 THEN 'needs_review' ELSE 'non_compliant' END AS status FROM s""",
    "export_checks": _X + " SELECT * FROM checks",
    "export_proxy_gate": _X + """
SELECT doc_id, CASE check_no WHEN 6 THEN 'PAC_NO_STRUCT' WHEN 2 THEN 'PAC_NO_MARKINFO' WHEN 3 THEN 'PAC_NO_TITLE' WHEN 1 THEN 'PAC_NO_PDFUA_XMP' END AS test_id,
       CASE WHEN check_no IN (1, 3) THEN 'warning' ELSE 'hard_fail' END AS severity FROM checks WHERE check_no IN (1, 2, 3, 6) AND NOT passed
UNION ALL SELECT doc_id, 'PAC_NO_LANG', 'hard_fail' FROM facts WHERE lang IS NULL
UNION ALL SELECT page_id, 'PAC_NO_BDC', 'hard_fail' FROM pages WHERE NOT contains(lower(coalesce(html, '')), '<p')
UNION ALL SELECT f.doc_id, 'PAC_NO_PARENT_TREE', 'hard_fail' FROM facts f LEFT JOIN counts USING (doc_id) WHERE NOT coalesce(lists, false)""",
    "export_pass_rate": _X + " SELECT doc_id, floor(count(*) FILTER (passed) / count(*) * 100 + 0.5)::INT AS score, bool_and(passed) AS passed FROM checks GROUP BY 1",
    "doc_type_scores": "WITH " + LINES_SQL + f""",
w AS (SELECT doc_id, list_distinct(flatten(list(list_transform({listed("text")}, lambda w: lower(trim(w, '.,;:()"''[]')))))) AS tokens,
             count(*) FILTER ({matches("text", T.CLAUSE)}) AS clauses, count(*) AS blocks, count(DISTINCT page_num) AS pages,
             lower(left(string_agg(text, ' ' ORDER BY line_index) FILTER (page_num = 1), 800)) AS prefix FROM text_lines GROUP BY 1),
s AS (
  SELECT *, {_hits(LEXICON["protocol"])} + CASE WHEN contains(prefix, 'the and') THEN 4 ELSE 0 END AS protocol,
    {_hits(LEXICON["legal"])} + CASE WHEN contains(prefix, 'de la') OR contains(prefix, 'la de') THEN 3 ELSE 0 END + CASE WHEN clauses >= 5 THEN 4 WHEN clauses >= 2 THEN 2 WHEN clauses >= 1 THEN 1 ELSE 0 END AS legal,
    {_hits(LEXICON["workplan"])} AS workplan, {_hits(LEXICON["form"])} + CASE WHEN contains(prefix, 'por el') THEN 3 ELSE 0 END AS form, 0.0::DOUBLE AS newsletter
  FROM w
)
SELECT doc_id, protocol, legal, workplan, form, newsletter,
       CASE WHEN blocks < greatest(4.0::DOUBLE, pages * 1.5::DOUBLE) THEN 'scanned' WHEN greatest(protocol, legal, workplan, form, newsletter) < 2 THEN 'general'
            ELSE ['protocol','legal','workplan','form','newsletter'][list_position([protocol, legal, workplan, form, newsletter], greatest(protocol, legal, workplan, form, newsletter))] END AS doc_type
FROM s""",
    "ai_structure_merge": _E + """,
own AS (SELECT doc_id % 50 AS doc_id, doc_id AS page_num, ord::BIGINT AS ord, elem_type, text FROM elements),
sug AS (SELECT conv_id * 3 % 50 AS doc_id, conv_id * 3 AS page_num, turn AS ord, CASE role WHEN 'user' THEN 'H2' WHEN 'assistant' THEN 'P' ELSE 'LI' END AS elem_type, text FROM conversations),
rich AS (SELECT doc_id, page_num, bool_or(elem_type IN ('H1','H2','H3','Table','L')) AS rich FROM own GROUP BY ALL),
chosen AS (SELECT doc_id, page_num, coalesce(rich, false) OR s.offered IS NULL AS keep FROM rich FULL OUTER JOIN (SELECT DISTINCT doc_id, page_num, 1 AS offered FROM sug) s USING (doc_id, page_num))
SELECT o.*, 'rules' AS origin FROM own o JOIN chosen USING (doc_id, page_num) WHERE keep
UNION ALL SELECT s.*, 'suggested' FROM sug s JOIN chosen USING (doc_id, page_num) WHERE NOT keep""",
    "mark_scores": "WITH " + _PAIRS + " SELECT doc_id, page_num, ord, mcid, round(score, 9) AS score FROM scores",
    "document_end_to_end": "WITH " + LINES_SQL + f""",
sourced AS (SELECT l.*, d.source FROM text_lines l JOIN documents d USING (doc_id)),
edges AS (
  SELECT *, {repeat_key("text")} AS key FROM sourced
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY line_index) <= 3 OR row_number() OVER (PARTITION BY doc_id, page_num ORDER BY line_index DESC) <= 3
),
pages_of AS (SELECT source, count(*) AS pages FROM (SELECT DISTINCT source, doc_id, page_num FROM sourced) GROUP BY source),
repeated AS (
  SELECT e.source, e.key FROM (SELECT DISTINCT source, doc_id, page_num, key FROM edges WHERE length(key) BETWEEN 4 AND 120) e JOIN pages_of p USING (source)
  GROUP BY 1, 2 HAVING count(*) >= greatest(2, ceil(max(p.pages) * 0.1::DOUBLE))
),
kept AS (SELECT * FROM text_lines WHERE (doc_id, page_num, line_index) NOT IN (SELECT (e.doc_id, e.page_num, e.line_index) FROM edges e JOIN repeated r ON e.source = r.source AND e.key = r.key)),
near AS (
  SELECT *, CASE WHEN contains(text, '|') THEN list_filter(list_transform(string_split(text, '|'), lambda c: trim(c)), lambda c: c <> '') ELSE [] END AS cells,
         lag(text) OVER w AS prev, lead(text) OVER w AS next, lead(gap_before) OVER w AS next_gap FROM kept WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY line_index)
),
scored AS (
  SELECT *, CASE WHEN length(text) > 95 OR {matches("text", T.EDGE_NUMBERED + T.NWS)} OR {matches("text", T.EDGE_KEY_VALUE)}
      OR (len(cells) >= 3 OR (len(cells) >= 2 AND len(list_filter(cells, lambda c: length(c) > 42)) = 0) OR (len(regexp_extract_all(text, '\\b[0-9]+(?:[.,][0-9]+)?\\b')) >= 2 AND length(text) <= 140)) THEN 0.0 ELSE
    (length(text) <= 70)::INT + (NOT {matches("text", "[.!?]$")})::INT + {matches("text", "^[0-9]+(?:" + chr(92) + ".[0-9]+){0,2}" + T.WS + "+" + T.NWS)}::INT + (line_index <= 4)::INT
    + (prev IS NULL)::INT + (next IS NULL OR length(next) > length(text) + 20)::INT + 0.5 * {matches("text", "[:" + chr(92) + "x{FF1A}]$")}::INT
    + 0.75 * coalesce(next_gap >= 12 * 1.05, false)::INT + 0.75 * (width > 0 AND width < 430 AND length(text) <= 80)::INT END::DOUBLE AS score FROM near
),
el AS (
  SELECT doc_id, page_num * 1000 + line_index AS ord, text, CASE WHEN {_ITEM} THEN 'LI' WHEN score >= 4.25 THEN CASE WHEN line_index <= 4 THEN 'H1' ELSE 'H3' END ELSE 'P' END AS t FROM scored
),
st AS (SELECT *, CASE WHEN t LIKE 'H_' THEN t[2]::INT END AS level FROM el),
be AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM st),
ag AS (SELECT doc_id, count(*) >= 5 AND bool_and(t = 'P') AS only_p, coalesce(bool_or(level > before + 1), false) AS skips FROM be GROUP BY 1),
sc AS (
  SELECT d.doc_id, CASE WHEN coalesce(only_p, false) OR coalesce(skips, false) OR coalesce(trim(d.lang), '') = '' THEN 45 ELSE 100 END AS cap,
         45 + CASE WHEN a.doc_id IS NULL THEN 0 ELSE 35 END - CASE WHEN coalesce(d.lang, '') = '' THEN 10 ELSE 0 END + CASE WHEN coalesce(trim(d.source), '') = '' THEN 0 ELSE 10 END AS total
  FROM documents d LEFT JOIN ag a USING (doc_id)
),
fin AS (SELECT doc_id, least(cap, total) AS score FROM sc)
SELECT doc_id, score, CASE WHEN score >= 85 THEN 'compliant' WHEN score >= 60 THEN 'needs_review' ELSE 'non_compliant' END AS status, quality
FROM fin LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)""",
}
