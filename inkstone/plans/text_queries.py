"""Registered queries on texts and their lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import quality, text as T
from inkstone.operators import lines
from inkstone.sources import bridge
from inkstone.sources.bridge import LINES_SQL, clean_sql

#: No group of the test texts repeats a line on half of its pages, so the query asks for a tenth.
RATIO = 0.1


def _docs(f):
    return lambda spark, sf_dir: f(bridge.table(spark, sf_dir, "documents"))


def _lines(f):
    return lambda spark, sf_dir: f(bridge.text_lines(bridge.table(spark, sf_dir, "documents")))


def _sourced(spark, sf_dir):
    return bridge.text_lines(bridge.table(spark, sf_dir, "documents"), keep=("source",))


def repeated_lines_ratio10(spark, sf_dir):
    return lines.repeated_lines(_sourced(spark, sf_dir), RATIO, "source")


def repeated_lines_removed_ratio10(spark, sf_dir):
    kept = lines.without_repeated(_sourced(spark, sf_dir), RATIO, "source")
    return kept.select("doc_id", "page_num", "line_index", "text")


def _pages(docs):
    """Every line of a document as a page, with a made-up confidence."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("page_num", "text"))
    return rows.withColumn("confidence", F.pmod(F.col("doc_id") * 7, F.lit(101)).cast("double"))


def verdict_vs_label(spark, sf_dir):
    """Recognition verdict against the quality label."""
    v = lines.quality_verdict(bridge.table(spark, sf_dir, "documents"))
    return v.join(bridge.table(spark, sf_dir, "labels"), "doc_id").groupBy("passed", "edge_passed", "quality").agg(F.count(F.lit(1)).alias("n"))


def scanned_result_class(docs):
    return docs.select("doc_id", quality.scanned_class(F.coalesce("text", F.lit(""))).alias("class"))


def line_width_estimate(docs):
    return docs.select("doc_id", F.round(T.estimated_width(F.coalesce("text", F.lit("")), 11.0), 6).alias("width"))


QUERIES = {
    "text_lines": _lines(lambda d: d.withColumns({"width": F.round("width", 6)})),
    "line_width_estimate": _docs(line_width_estimate),
    "line_rules": _lines(lines.line_rules),
    "repeated_lines_ratio10": repeated_lines_ratio10,
    "repeated_lines_removed_ratio10": repeated_lines_removed_ratio10,
    "edge_heading_scores": _lines(lines.heading_scores),
    "ocr_quality": _docs(lines.document_quality),
    "ocr_verdict": _docs(lines.quality_verdict),
    "ocr_findings": _docs(lambda d: lines.ocr_findings(_pages(d))),
    "digital_or_scanned": _docs(lambda d: lines.digital_or_scanned(_pages(d))),
    "verdict_vs_label": verdict_vs_label,
    "scanned_result_class": _docs(scanned_result_class),
}

W, N = T.WS, T.NWS
_L = "WITH " + LINES_SQL


def stripped(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{W}+', ''), '{W}+$', '')"


def counted(x: str, pattern: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')))"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def listed(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{W}+'), lambda w: w <> '')"


def repeat_key(x: str) -> str:
    return f"lower(regexp_replace(regexp_replace({x}, '{T.EDGE_DATE}', '#DATE', 'g'), '[0-9]+', '#', 'g'))"


_REPEAT = repeat_key("text")
_RUNNING = LINES_SQL + f""",
sourced AS (SELECT l.*, d.source FROM text_lines l JOIN documents d USING (doc_id)),
edges AS (
  SELECT *, {_REPEAT} AS key FROM sourced
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY line_index) <= 3
       OR row_number() OVER (PARTITION BY doc_id, page_num ORDER BY line_index DESC) <= 3
),
pages_of AS (SELECT source, count(*) AS pages FROM (SELECT DISTINCT source, doc_id, page_num FROM sourced) GROUP BY source),
repeated AS (
  SELECT e.source, e.key, count(*) AS n, max(p.pages) AS pages
  FROM (SELECT DISTINCT source, doc_id, page_num, key FROM edges WHERE length(key) BETWEEN 4 AND 120) e JOIN pages_of p USING (source)
  GROUP BY 1, 2 HAVING count(*) >= greatest(2, ceil(max(p.pages) * 0.1::DOUBLE))
)"""
_E = r"()\[\]{}.,:;''\x{22}!?%\x{20AA}$\x{20AC}#@&*/+\-=<>_|\\\x{2010}-\x{2015}\x{5BE}\x{5F3}\x{5F4}"
_S = quality.EDGE_SCRIPTS
_QUALITY = f"""
base AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '{W}', '', 'g') AS v, {listed("coalesce(text, '')")} AS ws FROM documents),
quality AS (
  SELECT doc_id,
    round(CASE WHEN length(v) > 0 THEN {counted("v", quality.SUSPECT)} / length(v) ELSE 1 END, 9) AS bad_char_ratio,
    round(CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: length(regexp_replace(w, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) < greatest(2.0::DOUBLE, length(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')) * 0.45::DOUBLE))) / len(ws) ELSE 1 END, 9) AS gibberish_ratio,
    length({stripped("t")})::DOUBLE AS avg_chars_per_page,
    round(CASE WHEN length(t) > 0 THEN {counted("t", quality.FOREIGN)} / length(t) ELSE 0 END, 9) AS foreign_ratio,
    round((length(v) - length(regexp_replace(v, '[^{_S}{_E}]', '', 'g'))) / greatest(length(v), 1), 9) AS edge_bad_ratio,
    round(len(list_filter(ws, lambda w: length(regexp_replace(w, '[{_E}]', '', 'g')) > 1 AND (
        length(regexp_replace(regexp_replace(w, '[{_E}]', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(regexp_replace(w, '[{_E}]', '', 'g')) < 0.55
        OR (length(regexp_replace(w, '[{_E}]', '', 'g')) - length(regexp_replace(regexp_replace(w, '[{_E}]', '', 'g'), '[^{_S}]', '', 'g'))) / length(regexp_replace(w, '[{_E}]', '', 'g')) > 0.25
        OR len(list_filter(range(1, length(regexp_replace(w, '[{_E}]', '', 'g')) - 3), lambda i:
             regexp_replace(w, '[{_E}]', '', 'g')[i:i+4] = repeat(regexp_replace(w, '[{_E}]', '', 'g')[i:i], 5))) > 0))) / greatest(len(ws), 1), 9) AS edge_gibberish_ratio
  FROM base
),
verdict AS (
  SELECT doc_id, bad_char_ratio <= 0.22 AND gibberish_ratio <= 0.35 AND avg_chars_per_page >= 24 AS passed,
         concat_ws(',', CASE WHEN edge_bad_ratio > 0.22 THEN 'bad_chars' END, CASE WHEN edge_gibberish_ratio > 0.35 THEN 'gibberish' END,
                   CASE WHEN avg_chars_per_page < 24 THEN 'short' END) AS reasons
  FROM quality
)"""
_ITEM = " OR ".join(matches("text", p.replace("(?i:", "(?i:")) for p in (*T.LIST_ITEM, T.DEFINITION_ITEM))
_KV = T.KEY_VALUE
_ROW = f"""(len(cells) >= 3 OR (len(cells) >= 2 AND len(list_filter(cells, lambda c: length(c) > 42)) = 0)
   OR (len(regexp_extract_all(text, '\\b[0-9]+(?:[.,][0-9]+)?\\b')) >= 2 AND length(text) <= 140))"""
_CELLS = f"""CASE WHEN contains(text, '|') THEN list_filter(list_transform(string_split(text, '|'), lambda c: {stripped("c")}), lambda c: c <> '') ELSE [] END"""
SQL = {
    "text_lines": _L + " SELECT * REPLACE (round(width, 6) AS width) FROM text_lines",
    "line_width_estimate": f"""
SELECT doc_id, round({counted("t", "[" + chr(92) + "x{590}-" + chr(92) + "x{5FF}]")} * 6.05::DOUBLE + {counted("t", "[A-Za-z0-9]")} * 5.5::DOUBLE
   + (length(t) - {counted("t", "[" + chr(92) + "x{590}-" + chr(92) + "x{5FF}]")} - {counted("t", "[A-Za-z0-9]")}) * 3.85::DOUBLE, 6) AS width
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "line_rules": _L + f""",
kv AS (SELECT *, {stripped(f"regexp_extract(text, '{_KV}', 1)")} AS label, {stripped(f"regexp_extract(text, '{_KV}', 2)")} AS value, {_CELLS} AS cells FROM text_lines)
SELECT doc_id, page_num, line_index, ({_ITEM}) AS list_item, {matches("text", T.SECTION_COLON)} AS section,
  CASE WHEN {matches("text", T.CLAUSE)} THEN least(length(regexp_extract(text, '{T.CLAUSE}', 1)) - length(replace(regexp_extract(text, '{T.CLAUSE}', 1), '.', '')) + 1, 3) END AS clause_level,
  label <> '' AND value <> '' AND len({listed("label")}) <= 6 AND len({listed("value")}) <= 18 AS key_value,
  {matches("text", T.SIGNATURE)} OR (length(text) <= 80 AND {matches("text", T.RULED)}) AS signature,
  {counted("text", "[" + chr(92) + "x{5D0}-" + chr(92) + "x{5EA}]")} >= greatest({counted("text", "[a-zA-Z]")}, 1) AS hebrew,
  {stripped(f"regexp_replace(regexp_replace(text, '{T.LIST_MARK}', ''), '{T.BULLET}', '')")} AS unmarked,
  len(list_distinct(list_transform({listed("text")}, lambda w: lower(trim(w, '.,;:()"''[]'))))) AS n_tokens,
  {matches("text", T.EDGE_NUMBERED + N)} AS edge_numbered,
  CASE WHEN {matches("text", T.EDGE_DEPTH)} THEN least(length(regexp_extract(text, '{T.EDGE_DEPTH}', 1)) - length(replace(regexp_extract(text, '{T.EDGE_DEPTH}', 1), '.', '')) + 1, 3) ELSE 1 END AS edge_depth,
  {matches("text", T.EDGE_KEY_VALUE)} AS edge_key_value, {_ROW} AS edge_row,
  {matches("text", T.EDGE_SIGNATURE)} OR {matches("text", "^_{3,}")} AS edge_signature, {_REPEAT} AS repeat_key
FROM kv""",
    "repeated_lines_ratio10": "WITH " + _RUNNING + " SELECT * FROM repeated",
    "repeated_lines_removed_ratio10": "WITH " + _RUNNING + """
SELECT doc_id, page_num, line_index, text FROM text_lines
WHERE (doc_id, page_num, line_index) NOT IN (SELECT (e.doc_id, e.page_num, e.line_index) FROM edges e JOIN repeated r ON e.source = r.source AND e.key = r.key)""",
    "edge_heading_scores": _L + f""",
near AS (
  SELECT *, {_CELLS} AS cells, lag(text) OVER w AS prev, lead(text) OVER w AS next, lead(gap_before) OVER w AS next_gap
  FROM text_lines WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY line_index)
),
scored AS (
  SELECT *, CASE WHEN length(text) > 95 OR {matches("text", T.EDGE_NUMBERED + N)} OR {matches("text", T.EDGE_KEY_VALUE)} OR {_ROW} THEN 0.0 ELSE
    (length(text) <= 70)::INT + (NOT {matches("text", "[.!?]$")})::INT + {matches("text", "^[0-9]+(?:" + chr(92) + ".[0-9]+){0,2}" + W + "+" + N)}::INT + (line_index <= 4)::INT
    + (prev IS NULL)::INT + (next IS NULL OR length(next) > length(text) + 20)::INT + 0.5 * {matches("text", "[:" + chr(92) + "x{FF1A}]$")}::INT
    + 0.75 * coalesce(next_gap >= 12 * 1.05, false)::INT + 0.75 * (width > 0 AND width < 430 AND length(text) <= 80)::INT END::DOUBLE AS score
  FROM near
)
SELECT doc_id, page_num, line_index, score, CASE WHEN score >= 4.25 THEN CASE WHEN line_index <= 4 THEN 1 ELSE 3 END END AS level FROM scored""",
    "ocr_quality": "WITH " + _QUALITY + " SELECT * FROM quality",
    "ocr_verdict": "WITH " + _QUALITY + " SELECT doc_id, passed, reasons = '' AS edge_passed, reasons FROM verdict",
    "verdict_vs_label": "WITH " + _QUALITY + " SELECT passed, reasons = '' AS edge_passed, quality, count(*) AS n FROM verdict JOIN labels USING (doc_id) GROUP BY ALL",
    "ocr_findings": f"""
WITH pages_of AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, (doc_id * 7 % 101)::DOUBLE AS c FROM documents),
d AS (SELECT doc_id, sum({counted("t", quality.FOREIGN)}) / greatest(sum(length(t)), 1) AS ratio,
             count(*) FILTER ({stripped("t")} = '') / count(*) AS empty, avg(c) AS mean FROM pages_of GROUP BY 1),
f AS (
  SELECT doc_id, 'OCR_GIBBERISH' AS test_id, 'hard_fail' AS severity, 'WCAG 1.1.1' AS criterion FROM d WHERE ratio >= 0.30
  UNION ALL SELECT doc_id, 'OCR_POOR_QUALITY', 'needs_review', 'WCAG 1.1.1' FROM d WHERE ratio >= 0.15 AND ratio < 0.30
  UNION ALL SELECT doc_id, 'OCR_EMPTY_PAGES', 'hard_fail', 'WCAG 1.4.5' FROM d WHERE empty >= 0.5
  UNION ALL SELECT doc_id, 'OCR_PARTIAL_EMPTY', 'warning', 'WCAG 1.4.5' FROM d WHERE empty > 0 AND empty < 0.5
  UNION ALL SELECT doc_id, 'OCR_LOW_CONFIDENCE', 'hard_fail', 'WCAG 1.1.1' FROM d WHERE mean < 40
  UNION ALL SELECT doc_id, 'OCR_MEDIUM_CONFIDENCE', 'needs_review', 'WCAG 1.1.1' FROM d WHERE mean >= 40 AND mean < 60
) SELECT * FROM f""",
    "digital_or_scanned": f"""
SELECT doc_id, CASE WHEN sum(CASE WHEN n > 10 THEN n ELSE 0 END) > 50 THEN 'digital' ELSE 'scanned' END AS kind
FROM (SELECT doc_id, length({stripped("t")}) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents)) GROUP BY 1""",
    "scanned_result_class": f"""
SELECT doc_id, CASE WHEN length(t) < 30 OR (length(t) - length(replace(t, '?', ''))) / length(t) > 0.20 THEN 'review_required' ELSE 'basic_accessible_scanned' END AS class
FROM (SELECT doc_id, {stripped("coalesce(text, '')")} AS t FROM documents)""",
}
