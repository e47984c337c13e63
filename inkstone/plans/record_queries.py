"""Registered queries on stored records, trees, recognised words and replies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import quality, text as T
from inkstone.operators import edge, ledger, records as R, structure as S
from inkstone.plans.ledger_queries import _jobs, _logs
from inkstone.plans.structure_queries import _PAIRS, elements, facts
from inkstone.plans.text_queries import _docs, _lines, matches, stripped
from inkstone.sources import bridge, content
from inkstone.sources.bridge import BLOCKS_SQL, ELEMENTS_SQL, FACTS_SQL, JOBS_SQL, LINES_SQL, LOGS_SQL

#: Types dealt to the elements that stand for line items.
KINDS = ("P", "P", "H1", "P", "H2", "LI", "L", "P", "Table", "TD", "H3", "TH", "LBody", "TR", "TR")


def item_elements(spark, sf_dir):
    """Elements of all kinds: a document per page of blocks.  Every fourth document has only
    paragraphs, others lack headings, or lists and tables; pages run on, fall back or jump."""
    doc, ord_ = F.col("page_num"), F.col("block_seq")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.pmod(ord_ * 7 + doc * 3, F.lit(len(KINDS))) + 1).cast("int"))
    page = F.when(doc % 3 == 0, 1 + F.floor(ord_ / 5)).when(doc % 3 == 1, F.when(ord_ % 9 == 8, 1).otherwise(1 + F.floor(ord_ / 4))).otherwise(F.pmod(ord_ * 5, F.lit(7)) + 1)
    rows = bridge.blocks(spark, sf_dir).select(doc.alias("doc_id"), ord_.cast("int").alias("ord"), kind.alias("k"), F.when((ord_ + doc) % 5 == 0, "").otherwise(F.col("text")).alias("text"), page.cast("int").alias("page_num"), F.when(ord_ % 3 != 0, ord_).cast("int").alias("mcid"))
    k = F.col("k")
    plain = (F.col("doc_id") % 4 == 0) | ((F.col("doc_id") % 4 == 1) & k.isin("H1", "H2", "H3")) | ((F.col("doc_id") % 4 == 2) & k.isin("L", "LI", "LBody", "Table", "TR", "TD", "TH"))
    return R.tree(rows.withColumn("elem_type", F.when(plain, "P").otherwise(k)).drop("k"))


ITEMS_SQL = BLOCKS_SQL + f""",
typed AS (
  SELECT page_num AS doc_id, block_seq::INT AS ord, CASE WHEN (block_seq + page_num) % 5 = 0 THEN '' ELSE text END AS text, {list(KINDS)}[(block_seq * 7 + page_num * 3) % {len(KINDS)} + 1] AS k,
         (CASE page_num % 3 WHEN 0 THEN 1 + block_seq // 5 WHEN 1 THEN CASE WHEN block_seq % 9 = 8 THEN 1 ELSE 1 + block_seq // 4 END ELSE block_seq * 5 % 7 + 1 END)::INT AS page_num,
         CASE WHEN block_seq % 3 <> 0 THEN block_seq END AS mcid FROM blocks
),
kinds AS (
  SELECT * EXCLUDE (k), CASE WHEN doc_id % 4 = 0 OR (doc_id % 4 = 1 AND k IN ('H1','H2','H3')) OR (doc_id % 4 = 2 AND k IN ('L','LI','LBody','Table','TR','TD','TH')) THEN 'P' ELSE k END AS elem_type FROM typed
),
lasts AS (
  SELECT *, last_value(CASE WHEN elem_type = 'L' THEN ord END IGNORE NULLS) OVER w AS l, last_value(CASE WHEN elem_type = 'Table' THEN ord END IGNORE NULLS) OVER w AS t,
         last_value(CASE WHEN elem_type = 'TR' THEN ord END IGNORE NULLS) OVER w AS r, last_value(CASE WHEN elem_type = 'LI' THEN ord END IGNORE NULLS) OVER w AS i
  FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
parents AS (
  SELECT *, CASE elem_type WHEN 'LI' THEN l WHEN 'TR' THEN t WHEN 'TH' THEN CASE WHEN r > t THEN r ELSE t END WHEN 'TD' THEN CASE WHEN r > t THEN r ELSE t END WHEN 'LBody' THEN i END AS parent_ord FROM lasts
),
tree AS (
  SELECT doc_id, ord, elem_type, text, page_num, mcid, parent_ord, t,
         CASE WHEN parent_ord IS NULL THEN 0 WHEN (elem_type IN ('TH','TD') AND coalesce(r > t, false)) OR (elem_type = 'LBody' AND coalesce(i > l, false)) THEN 2 ELSE 1 END AS depth FROM parents
)"""


def nested(spark, sf_dir):
    """Page elements with their places in the tree, header cells with their scope."""
    rows = R.tree(elements(spark, sf_dir))
    return rows.withColumns({"page_num": F.lit(1), "attrs": F.when(F.col("elem_type") == "L", F.create_map(F.lit("ListNumbering"), F.lit("None")))})


def item_features(spark, sf_dir):
    """Features of the line items' documents, with candidates that ask for all rules."""
    rows = item_elements(spark, sf_dir)
    table = F.last(F.when(F.col("elem_type") == "Table", F.col("ord")), ignorenulls=True).over(S.W.partitionBy("doc_id").orderBy("ord"))
    rows = rows.withColumn("table_id", F.when(F.col("elem_type").isin("TD", "TH") & (F.col("ord") % 2 == 0), table))
    d = F.col("doc_id")
    kinds = F.array(*[F.lit(t) for t in (*S.TYPES, "general")])
    meta = rows.select("doc_id").distinct().select(
        "doc_id", F.when(d % 3 == 0, "he").when(d % 3 == 1, " ").otherwise("en").alias("lang"), F.lit("t").alias("title"), F.element_at(kinds, (d % 6 + 1).cast("int")).alias("doc_type"),
        (d % 2).cast("int").alias("heading_candidates"), (d % 3).cast("int").alias("list_candidates"), (d % 5).cast("int").alias("table_candidates"), (d % 7).cast("int").alias("kv_candidates"),
    )
    return S.features(rows, meta)


def item_gate(spark, sf_dir):
    f = item_features(spark, sf_dir)
    base = f.select("doc_id", (F.col("doc_id") % 60 + 41).cast("int").alias("base"))
    return R.gated(base, S.gate(S.findings(f)))


_TYPED = "['protocol','legal','workplan','form','newsletter','general'][doc_id % 6 + 1]"
ITEM_FINDINGS_SQL = ITEMS_SQL + f""",
stepped AS (
  SELECT *, CASE WHEN elem_type IN ('H1','H2','H3') THEN elem_type[2]::INT END AS level, lag(page_num) OVER w AS page_before,
         CASE WHEN elem_type IN ('TD','TH') AND ord % 2 = 0 THEN t END AS table_id FROM tree WINDOW w AS (PARTITION BY doc_id ORDER BY ord)
),
levels AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM stepped),
inside AS (
  SELECT x.doc_id, bool_or(NOT coalesce(c.cells, false)) AS no_cells, bool_or(NOT coalesce(c.th, false)) AS no_th FROM tree x
  LEFT JOIN (SELECT doc_id, table_id, true AS cells, bool_or(elem_type = 'TH') AS th FROM stepped WHERE table_id IS NOT NULL GROUP BY ALL) c ON c.doc_id = x.doc_id AND c.table_id = x.ord
  WHERE x.elem_type = 'Table' GROUP BY 1
),
f AS (
  SELECT doc_id, doc_id % 2 AS hc, doc_id % 3 AS lc, doc_id % 5 AS tc, doc_id % 7 AS kc, {_TYPED} AS kind, count(*) AS n, bool_or(elem_type <> 'P') AS other, bool_or(level IS NOT NULL) AS h, bool_or(elem_type = 'H2') AS h2,
         bool_or(elem_type = 'L') AS l, bool_or(elem_type = 'Table') AS t, coalesce(min_by(level, ord) FILTER (level IS NOT NULL) > 1, false) AS late, coalesce(bool_or(level > before + 1), false) AS skips,
         bool_or(elem_type = 'LI' AND text = '') AS empty_li, count(*) FILTER (parent_ord IS NULL AND page_num < page_before - 1) AS jumps,
         count(*) FILTER (mcid IS NULL AND text <> '' AND elem_type IN ('H1','H2','H3','P','TD','TH','LBody')) AS unbound, bool_or(i.no_cells) AS no_cells, bool_or(i.no_th) AS no_th
  FROM levels LEFT JOIN inside i USING (doc_id) GROUP BY doc_id
),
findings AS (
  SELECT doc_id, r.rule_no, r.test_id, r.severity, r.criterion FROM (SELECT doc_id, unnest([
    {{'on': doc_id % 3 = 1, 'rule_no': 0, 'test_id': 'LANG_MISSING', 'severity': 'hard_fail', 'criterion': 'WCAG 3.1.1'}},
    {{'on': n >= 5 AND NOT other, 'rule_no': 1, 'test_id': 'PARAGRAPH_ONLY', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'}},
    {{'on': hc > 0 AND NOT h, 'rule_no': 2, 'test_id': 'HEADINGS_LOST', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'}},
    {{'on': lc > 0 AND NOT l, 'rule_no': 3, 'test_id': 'LISTS_LOST', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'}},
    {{'on': tc > 0 AND NOT t, 'rule_no': 4, 'test_id': 'TABLES_LOST', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'}},
    {{'on': late, 'rule_no': 5, 'test_id': 'FIRST_HEADING_NOT_H1', 'severity': 'warning', 'criterion': 'PDF/UA §7.5'}},
    {{'on': skips, 'rule_no': 6, 'test_id': 'HEADING_LEVEL_SKIP', 'severity': 'hard_fail', 'criterion': 'PDF/UA §7.5'}},
    {{'on': hc > 0 AND NOT h, 'rule_no': 7, 'test_id': 'HEADING_CANDIDATES_LOST', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'}},
    {{'on': lc > 0 AND NOT l, 'rule_no': 8, 'test_id': 'LIST_NOT_EXPORTED', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'}},
    {{'on': empty_li, 'rule_no': 9, 'test_id': 'LI_EMPTY', 'severity': 'warning', 'criterion': 'WCAG 1.3.1'}},
    {{'on': tc > 0 AND NOT t, 'rule_no': 10, 'test_id': 'TABLE_NOT_EXPORTED', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'}},
    {{'on': coalesce(no_cells, false), 'rule_no': 11, 'test_id': 'TABLE_NO_CELLS', 'severity': 'hard_fail', 'criterion': 'IS 5568 §7.2'}},
    {{'on': coalesce(no_th, false), 'rule_no': 12, 'test_id': 'TABLE_NO_TH', 'severity': 'warning', 'criterion': 'IS 5568 §7.2'}},
    {{'on': kc >= 3 AND NOT t AND NOT l, 'rule_no': 13, 'test_id': 'KV_FLAT_PARAGRAPHS', 'severity': 'needs_review', 'criterion': 'WCAG 1.3.1'}},
    {{'on': unbound > 5, 'rule_no': 14, 'test_id': 'MCID_UNBOUND', 'severity': 'warning', 'criterion': 'PDF/UA §7.3'}},
    {{'on': jumps > 3, 'rule_no': 15, 'test_id': 'READING_ORDER_BROKEN', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.2'}},
    {{'on': jumps BETWEEN 1 AND 3, 'rule_no': 16, 'test_id': 'READING_ORDER_SUSPECT', 'severity': 'warning', 'criterion': 'WCAG 1.3.2'}},
    {{'on': kind = 'protocol' AND NOT h, 'rule_no': 17, 'test_id': 'PROTOCOL_NO_HEADING', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'}},
    {{'on': kind = 'protocol' AND h AND NOT h2, 'rule_no': 18, 'test_id': 'PROTOCOL_NO_H2', 'severity': 'warning', 'criterion': 'WCAG 1.3.1'}},
    {{'on': kind = 'protocol' AND NOT l, 'rule_no': 19, 'test_id': 'PROTOCOL_NO_LIST', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'}},
    {{'on': kind = 'legal' AND NOT h, 'rule_no': 20, 'test_id': 'LEGAL_NO_HEADING', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'}},
    {{'on': kind = 'workplan' AND NOT t, 'rule_no': 21, 'test_id': 'WORKPLAN_NO_TABLE', 'severity': 'hard_fail', 'criterion': 'WCAG 1.3.1'}},
    {{'on': kind = 'newsletter' AND NOT h, 'rule_no': 22, 'test_id': 'NEWSLETTER_NO_HEADING', 'severity': 'warning', 'criterion': 'WCAG 1.3.1'}},
    {{'on': kind = 'form', 'rule_no': 23, 'test_id': 'FORM_FIELDS_UNTAGGED', 'severity': 'needs_review', 'criterion': 'WCAG 1.3.1'}}]) AS r FROM f) WHERE r."on"
)"""


# --- recognised words, raw files and strings


def words(spark, sf_dir):
    """Line items as recognised words: three lines in two blocks a page, some words blank or doubtful."""
    b = bridge.blocks(spark, sf_dir)
    s = F.col("block_seq")
    return b.select(
        "doc_id", "page_num", s.alias("word_seq"), F.when(s % 11 == 0, 4).otherwise(5).alias("level"), (s % 2).alias("block_num"), F.lit(1).alias("par_num"), (s % 3).alias("line_num"),
        (F.col("x") * 2).alias("left"), F.col("y").alias("top"), F.col("width").alias("width"), F.col("height").alias("height"), (F.pmod(s * 37 + F.col("page_num"), F.lit(102)) - 1).alias("conf"),
        F.when(s % 7 == 0, " ").otherwise(F.col("text")).alias("text"), F.when(F.col("page_num") % 2 == 0, 300).otherwise(0).alias("dpi"),
    )


_WORDS = BLOCKS_SQL + """,
words AS (
  SELECT doc_id, page_num, block_seq AS s, CASE WHEN block_seq % 11 = 0 THEN 4 ELSE 5 END AS level, block_seq % 2 AS block_num, block_seq % 3 AS line_num, x * 2 AS l, y AS t, width AS w, height AS h,
         (block_seq * 37 + page_num) % 102 - 1 AS conf, CASE WHEN block_seq % 7 = 0 THEN '' ELSE text END AS word, CASE WHEN page_num % 2 = 0 THEN 72.0 / 300 ELSE 72.0 / 200 END::DOUBLE AS pt FROM blocks
)"""


def ocr_lines(spark, sf_dir):
    rows = bridge.ocr_lines(words(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("x", "y", "width", "height", "font_size")})


def ocr_confidences(spark, sf_dir):
    return bridge.ocr_confidences(words(spark, sf_dir)).withColumn("doc_confidence", F.round("doc_confidence", 9))




def scanned_files(docs):
    """Raw files of one page that show the first letters of a text, some with an image."""
    shown = F.left(F.translate(F.coalesce("text", F.lit("")), "()\\\n\r", ""), F.pmod("doc_id", F.lit(90)).cast("int"))
    raw = F.concat(F.lit("/Type /Page "), F.when(F.col("doc_id") % 3 == 0, "/Subtype /Image ").otherwise(""), F.lit("("), shown, F.lit(") Tj"))
    return docs.select("doc_id", T.scanned_pdf(raw).alias("scanned"))


def strings(docs):
    """Texts stored as bytes and read back, as a string literal, and as HTML."""
    t = F.coalesce("text", F.lit(""))
    stored = F.when(F.col("doc_id") % 2 == 0, F.encode(t, "UTF-16")).otherwise(F.encode(t, "UTF-8"))
    return docs.select("doc_id", F.md5(F.encode(content.decoded(stored), "UTF-8")).alias("decoded"), F.md5(F.encode(content.escaped(t), "UTF-8")).alias("literal"), F.md5(F.encode(R.html_escaped(t), "UTF-8")).alias("html"))


def content_marks(spark, sf_dir):
    """Content streams made of page elements, read back: tags and numbers, and pages without any."""
    e = elements(spark, sf_dir).withColumn("m", F.concat(F.lit("/"), "elem_type", F.lit(" <</MCID "), F.col("ord").cast("string"), F.lit(">> BDC (x) Tj EMC\n")))
    pages = e.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "m"))), lambda x: x["m"]), "").alias("s"))
    pages = pages.withColumn("s", F.when(F.col("doc_id") % 5 == 0, "BT (x) Tj ET").otherwise(F.col("s")))
    return pages.select("doc_id", content.unmarked(F.col("s")).alias("unmarked"), F.explode_outer(content.markers(F.col("s"))).alias("k")).select("doc_id", "unmarked", "k.tag", "k.mcid")


def shown_lines(spark, sf_dir):
    """Content streams that show the lines of a page, read back as lines with their places."""
    lines = bridge.text_lines(bridge.table(spark, sf_dir, "documents")).filter("line_index < 40")
    lit = F.regexp_replace(F.regexp_replace(F.col("text"), r"[^\x20-\x7E]", "?"), r"([\\()])", r"\\$1")
    shown = F.concat(F.lit("("), lit, F.lit(") Tj T*\n"))
    stream = lines.withColumn("m", shown).groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_index", "m"))), lambda x: x["m"]), "").alias("s"))
    head = F.when(F.col("page_num") % 2 == 0, "/Arial-Bold 10 Tf").otherwise("/Arial 10 Tf")
    page = F.concat(F.lit("/Type /Page \nstream\nBT "), head, F.lit(" 50 -20 Td\n"), "s", F.lit("ET\nendstream\n"))
    files = stream.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_num", page.alias("p")))), lambda x: x["p"]), "").alias("raw"))
    out = content.content_lines(files)
    return out.select("doc_id", "page_num", "line_index", "text", F.round("y", 6).alias("y"), "font_size", "font_name", "bold")


# --- replies and marks


def replies(spark, sf_dir):
    """Conversations as replies of a model: a JSON array in a fence, with words around it."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("h2", "li", "LI", "tr", "tr", "p", "code")]), (F.pmod(F.col("turn") + F.col("conv_id"), F.lit(7)) + 1).cast("int"))
    t = bridge.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", kind.alias("type"), "text")
    cell = F.when(F.lower("type") == "tr", F.array(F.struct(F.when(F.col("role") == "user", "th").otherwise("td").alias("type"), F.col("text").alias("text"))))
    item = F.struct("type", F.when(F.lower("type") != "tr", F.col("text")).alias("text"), cell.alias("cells"))
    rows = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("turn", item.alias("i")))).alias("l"))
    return rows.select("doc_id", F.lit(1).alias("page_num"), F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.col("l.i")), F.lit("\n```\nDone.")).alias("reply"))


_REPLIES = """
items AS (
  SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, role, text,
         ['h2','li','LI','tr','tr','p','code'][(turn + conv_id) % 7 + 1] AS type FROM conversations
),
grouped AS (SELECT *, CASE WHEN lower(type) = 'li' THEN 'L' WHEN type = 'tr' THEN 'Table' END AS g FROM items),
islands AS (SELECT *, CASE WHEN g = lag(g) OVER (PARTITION BY doc_id ORDER BY ord) THEN 0 ELSE 1 END AS fresh FROM grouped),
numbered_items AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM islands)"""


def marks_and_claims(spark, sf_dir):
    """Marks of page elements with their texts, and claims on two thirds of them, some by two."""
    e = elements(spark, sf_dir)
    marks = S.parent_tree(e).join(e.select("doc_id", F.col("ord").alias("owner"), "text"), ["doc_id", "owner"])
    claims = marks.filter("mcid % 3 <> 0").select("doc_id", "page_num", "mcid", F.explode(F.array(F.col("owner"), F.col("owner") + F.when(F.col("mcid") % 2 == 0, -1).otherwise(1))).alias("ord"))
    return marks, claims


_MARKS = ELEMENTS_SQL + """,
marks AS (
  SELECT doc_id, 1 AS page_num, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS mcid, ord AS owner, text FROM elements
  WHERE elem_type SIMILAR TO 'H[1-6]' OR elem_type IN ('P','TD','TH','LBody','Caption','Figure')
)"""


def page_lookup(spark, sf_dir):
    """Lines with the recognition of their page, known for two pages of three."""
    rows = bridge.text_lines(bridge.table(spark, sf_dir, "documents")).select("doc_id", "page_num", "line_index")
    pages = rows.select("doc_id", "page_num").distinct().filter("(doc_id + page_num) % 3 <> 0").withColumn("alt", F.concat(F.lit("page "), "page_num"))
    return R.with_pages(rows, pages)


# --- ledger


def _ids(spark, sf_dir, unknown: bool = True):
    """Every third job, and where asked for as many ids that aren't there."""
    some = bridge.jobs(spark, sf_dir).filter("id % 3 = 0").select("id")
    return some.unionByName(some.select((-1 - F.col("id")).alias("id"))) if unknown else some


def job_documents(spark, sf_dir):
    order = bridge.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.split("o_orderpriority", "[- ]")).alias("accessibility_features"))
    jobs = bridge.jobs(spark, sf_dir).join(order, "id").withColumn("accessibility_features", F.when(F.col("status") != "error", F.col("accessibility_features")))
    return R.documents_of(jobs, _ids(spark, sf_dir))


def job_reports(spark, sf_dir):
    jobs = bridge.jobs(spark, sf_dir).withColumn("validation_report", F.when(F.col("status") == "done", F.to_json(F.struct("pages", "status"))))
    return ledger.report(jobs, _ids(spark, sf_dir))


def job_deletes(spark, sf_dir):
    return ledger.delete(bridge.jobs(spark, sf_dir), _ids(spark, sf_dir)).select("id", "status")


def job_upserts(spark, sf_dir):
    jobs = bridge.jobs(spark, sf_dir).select("id", "status", "pages")
    return ledger.upsert(jobs, _ids(spark, sf_dir).select("id", F.lit("done").alias("status"), F.lit(7).cast("long").alias("pages")))


def job_transitions(spark, sf_dir):
    out = ledger.apply_transitions(bridge.jobs(spark, sf_dir), bridge.operation_logs(spark, sf_dir))
    return out.select("id", "status", "updated_at")


def audit_append(spark, sf_dir):
    logs = bridge.operation_logs(spark, sf_dir)
    at = F.col("o_orderdate").cast("timestamp_ntz")
    fresh = bridge.table(spark, sf_dir, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit("start").alias("operation"), F.lit("processing").alias("status"), F.col("o_orderpriority").alias("message"), at.alias("timestamp"))
    return R.appended(logs, fresh)


def submission_summaries(spark, sf_dir):
    counters = elements(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("elem_type") == "L").alias("lists"), F.count_if(F.col("elem_type").isin("H1", "H2", "H3")).alias("headings"))
    counters = counters.withColumns({c: F.lit(0).cast("long") for c in ("tables", "artifacts", "signatures")})
    rates = counters.select("doc_id", (F.col("doc_id") % 101).cast("int").alias("score"), (F.col("doc_id") % 101 == 100).alias("passed"))
    return edge.summary(counters, rates)


# --- scores


def file_scores(spark, sf_dir):
    """Facts of exported files, taken from pages and their numbers."""
    d = F.col("doc_id")
    rows = facts(spark, sf_dir).select("doc_id", F.when(d % 5 != 0, F.col("lang")).alias("lang"), "title", (d % 4 != 0).alias("has_struct_tree"), (d % 25).alias("chars"), (d % 2 == 0).alias("text_operators"), F.when(d % 3 != 0, "1").alias("pdfua_part"), (d % 7 != 0).alias("marked"))
    return S.file_score(rows)


def service_results(docs):
    """The service's verdict over gate signal, scan flag, score and the text's own class."""
    t = F.coalesce("text", F.lit(""))
    failed, scanned, score = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, (F.col("doc_id") % 101).cast("int")
    as_ = quality.scanned_class(t)
    return docs.select("doc_id", quality.has_text(F.length(T.strip(t))).alias("has_text"), quality.service_status(failed, scanned, quality.status_of(score), as_).alias("status"), quality.service_score(failed, scanned, score, as_).alias("score"))


def mean_confidences(spark, sf_dir):
    """Mean confidence of each page's words from an array of their values."""
    rows = words(spark, sf_dir).groupBy("doc_id", "page_num").agg(F.collect_list(F.when(F.col("level") == 5, F.col("conf").cast("double"))).alias("c"))
    return rows.select("doc_id", "page_num", F.round(quality.mean_confidence(F.col("c")), 9).alias("confidence"))


def bold_fonts(spark, sf_dir):
    """Parts as font names: brand and a style by size."""
    style = F.element_at(F.array(*[F.lit(x) for x in ("Bold", "-Light", "SEMIBOLD", "Demi", "Heavy", "Oblique", "black")]), (F.col("p_size") % 7 + 1).cast("int"))
    rows = bridge.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("-"), style).alias("font"))
    return rows.select("p_partkey", "font", F.col("font").rlike(T.BOLD_FONT).alias("bold"))


def line_key_values(spark, sf_dir):
    kv = R.key_and_value(F.col("text"))
    rows = bridge.text_lines(bridge.table(spark, sf_dir, "documents")).select("doc_id", "page_num", "line_index", "text")
    blocks = bridge.blocks(spark, sf_dir).select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.col("block_seq").alias("line_index"), "text")
    return rows.unionByName(blocks).withColumn("kv", kv).filter("kv is not null").select("doc_id", "page_num", "line_index", "kv.label", "kv.value")


def column_patterns(spark, sf_dir):
    """Whether following rows of block pages start their cells at the same places."""
    rows = edge.grouped_rows(_seen_from_below(spark, sf_dir)).select("doc_id", "page_num", "row_no", "cell_xs")
    follows = F.lead("cell_xs").over(S.W.partitionBy("doc_id", "page_num").orderBy("row_no"))
    return rows.select("doc_id", "page_num", "row_no", edge.same_columns(F.col("cell_xs"), follows).alias("same"))


def _seen_from_below(spark, sf_dir):
    b = bridge.blocks(spark, sf_dir)
    return b.select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.col("block_seq").alias("line_index"), "text", "x", (800.0 - F.col("y")).alias("y"), "width", "font_size", F.col("is_bold").alias("bold"))


def row_gaps(spark, sf_dir):
    rows = edge.row_lines(edge.grouped_rows(_seen_from_below(spark, sf_dir)))
    return rows.select("doc_id", "page_num", "line_index", F.round("gap_before", 6).alias("gap_before"), F.round("width", 6).alias("width"))


QUERIES = {
    "item_tree": lambda s, d: item_elements(s, d).select("doc_id", "ord", "parent_ord", "depth", "elem_type"),
    "structure_tree_round_trip": lambda s, d: R.from_tree_json(R.tree_json(nested(s, d))).withColumn("attrs", F.to_json("attrs")),
    "tree_warnings": lambda s, d: R.tree_warnings(item_elements(s, d)),
    "tree_inspection": lambda s, d: S.inspect(item_elements(s, d).withColumn("alt", F.when(F.col("ord") % 4 == 0, "alt"))),
    "tree_shape": lambda s, d: R.tree_shape(S.parent_tree(item_elements(s, d))),
    "findings_all_rules": lambda s, d: S.findings(item_features(s, d)),
    "gate_results": item_gate,
    "file_scores": file_scores,
    "service_results": _docs(service_results),
    "page_texts": _lines(R.page_texts),
    "line_key_values": line_key_values,
    "scanned_files": _docs(scanned_files),
    "stored_strings": _docs(strings),
    "content_marks": content_marks,
    "content_lines": shown_lines,
    "ocr_lines": ocr_lines,
    "ocr_confidences": ocr_confidences,
    "mean_confidences": mean_confidences,
    "bold_fonts": bold_fonts,
    "row_gaps": row_gaps,
    "column_patterns": column_patterns,
    "suggested_items": lambda s, d: S.suggested_items(replies(s, d)).select("doc_id", "page_num", "ord", "type", "text"),
    "suggested_cells": lambda s, d: S.suggested_cells(S.suggested_items(replies(s, d))),
    "suggested_wrapped": lambda s, d: S.wrapped(S.suggested_items(replies(s, d))),
    "mark_owners": lambda s, d: S.owners(*marks_and_claims(s, d)),
    "unclaimed_marks": lambda s, d: S.unclaimed(*marks_and_claims(s, d)),
    "page_lookup": page_lookup,
    "job_documents": job_documents,
    "job_reports": job_reports,
    "job_deletes": job_deletes,
    "job_upserts": job_upserts,
    "job_transitions": job_transitions,
    "audit_append": audit_append,
    "resource_alerts": _jobs(R.resource_alerts),
    "slow_responses": _logs(lambda logs: R.slow_responses(logs, 3600.0)),
    "submission_summaries": submission_summaries,
}

_I, _J = "WITH " + ITEMS_SQL, "WITH " + JOBS_SQL
_IDS = ", ids AS (SELECT id FROM jobs WHERE id % 3 = 0 UNION ALL SELECT -1 - id FROM jobs WHERE id % 3 = 0)"
_ROWS = f"""
WITH RECURSIVE {BLOCKS_SQL},
seen AS (SELECT doc_id, page_num, text, x, 800.0::DOUBLE - y AS y, width, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y, x, block_seq) AS i FROM blocks),
made AS (
  SELECT doc_id, page_num, i, [y] AS anchors, 1 AS home FROM seen WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.page_num, s.i, CASE WHEN len(list_filter(m.anchors, lambda a: abs(a - s.y) <= 3.5)) = 0 THEN list_append(m.anchors, s.y) ELSE m.anchors END,
         coalesce(nullif(coalesce(list_position(list_transform(m.anchors, lambda a: abs(a - s.y) <= 3.5), true), 0), 0), len(m.anchors) + 1)
  FROM made m JOIN seen s ON s.doc_id = m.doc_id AND s.page_num = m.page_num AND s.i = m.i + 1
),
placed AS (SELECT s.*, m.home FROM seen s JOIN made m USING (doc_id, page_num, i)),
joined AS (
  SELECT doc_id, page_num, home, list(y ORDER BY x, i)[1] AS anchor, min(x) AS left_x, string_agg(text, ' ' ORDER BY x, i) AS text, count(*) AS n, list(x ORDER BY x, i) AS xs, max(x + width) - min(x) AS width FROM placed GROUP BY ALL
),
rows_seen AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY anchor DESC, left_x, home) AS row_no FROM joined)"""
_KV_RUNS = f"""
WITH RECURSIVE {BLOCKS_SQL},
pairs AS (SELECT doc_id, page_num, block_seq, x, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y, x DESC, block_seq) - 1 AS i, {matches("text", T.KEY_VALUE)} AS kv,
  {stripped(f"regexp_extract(text, '{T.KEY_VALUE}', 1)")} AS label, {stripped(f"regexp_extract(text, '{T.KEY_VALUE}', 2)")} AS value FROM blocks),
ends AS (
  SELECT s.doc_id, s.page_num, s.i, coalesce(min(e.i) FILTER (NOT e.kv OR abs(e.x - s.x) > 24), max(e.i) + 1) AS stop
  FROM pairs s JOIN pairs e ON e.doc_id = s.doc_id AND e.page_num = s.page_num AND e.i >= s.i GROUP BY ALL
),
walk AS (
  SELECT DISTINCT doc_id, page_num, 0::BIGINT AS i FROM pairs
  UNION ALL
  SELECT w.doc_id, w.page_num, CASE WHEN e.stop - e.i >= 3 THEN e.stop ELSE e.i + 1 END FROM walk w JOIN ends e USING (doc_id, page_num, i)
),
runs AS (SELECT e.*, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY i) AS run_no FROM walk JOIN ends e USING (doc_id, page_num, i) WHERE e.stop - e.i >= 3)
SELECT p.doc_id, p.page_num, r.run_no, p.i - r.i + 1 AS row_no, p.block_seq, p.label, p.value
FROM runs r JOIN pairs p ON p.doc_id = r.doc_id AND p.page_num = r.page_num AND p.i >= r.i AND p.i < r.stop"""
SQL = {
    "item_tree": _I + " SELECT doc_id, ord, parent_ord, depth, elem_type FROM tree",
    "structure_tree_round_trip": "WITH " + ELEMENTS_SQL + """,
lists AS (SELECT *, last_value(CASE WHEN elem_type = 'L' THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM elements),
placed AS (SELECT *, CASE WHEN elem_type = 'LI' THEN l END AS up FROM lists),
pre AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(up, ord), (up IS NOT NULL)::INT, ord) - 1 AS n FROM placed)
SELECT p.doc_id, p.n AS ord, q.n AS parent_ord, CASE WHEN p.up IS NULL THEN 0 ELSE 1 END AS depth, p.elem_type, p.text, 1 AS page_num,
       CASE WHEN p.elem_type = 'L' THEN '{"ListNumbering":"None"}' END AS attrs
FROM pre p LEFT JOIN pre q ON q.doc_id = p.doc_id AND q.ord = p.up""",
    "tree_warnings": _I + """,
d AS (SELECT doc_id, bool_or(elem_type LIKE 'H_') AS h, bool_or(elem_type = 'Table') AS t, bool_or(elem_type = 'TH') AS th, bool_or(elem_type = 'L') AS l, bool_or(elem_type = 'LBody') AS b FROM tree GROUP BY 1)
SELECT doc_id, 'NO_HEADINGS' AS warning FROM d WHERE NOT h UNION ALL SELECT doc_id, 'TABLES_NO_TH' FROM d WHERE t AND NOT th UNION ALL SELECT doc_id, 'LISTS_NO_LBODY' FROM d WHERE l AND NOT b""",
    "tree_inspection": _I + """
SELECT doc_id, elem_type, count(*) AS n, max(depth) AS max_depth, count(*) FILTER (ord % 4 = 0 AND elem_type IN ('L','LI','Table','TR')) AS warnings FROM tree GROUP BY ALL""",
    "tree_shape": _I + """
SELECT doc_id, page_num, count(*) AS marks, true AS gapless, count(*) AS owners FROM tree WHERE elem_type IN ('H1','H2','H3','P','TD','TH','LBody') GROUP BY ALL""",
    "findings_all_rules": "WITH " + ITEM_FINDINGS_SQL + " SELECT * FROM findings",
    "gate_results": "WITH " + ITEM_FINDINGS_SQL + """,
g AS (SELECT d.doc_id, (d.doc_id % 60 + 41)::INT AS base, count(*) FILTER (severity = 'hard_fail') AS hard, count(*) FILTER (severity = 'needs_review') AS open_
      FROM (SELECT DISTINCT doc_id FROM tree) d LEFT JOIN findings USING (doc_id) GROUP BY ALL),
s AS (SELECT doc_id, hard, CASE WHEN hard > 0 THEN least(base, 45) WHEN open_ > 0 THEN least(base, 69) ELSE base END AS score FROM g)
SELECT doc_id, score, CASE WHEN hard > 0 THEN 'non_compliant' WHEN score >= 85 THEN 'compliant' WHEN score >= 60 THEN 'needs_review' ELSE 'non_compliant' END AS status FROM s""",
    "file_scores": "WITH " + FACTS_SQL + """,
s AS (
  SELECT doc_id, least(100, CASE WHEN doc_id % 4 <> 0 THEN 25 ELSE 0 END
    + CASE WHEN doc_id % 25 > 20 OR (doc_id % 25 <= 5 AND doc_id % 2 = 0) THEN 35 WHEN doc_id % 25 > 5 THEN 15 ELSE 0 END
    + CASE WHEN doc_id % 5 = 0 OR lang IS NULL THEN 0 WHEN lower(lang) IN ('he-il','he','iw') THEN 20 ELSE 10 END
    + CASE WHEN title IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN doc_id % 3 <> 0 THEN 5 ELSE 0 END + CASE WHEN doc_id % 7 <> 0 THEN 5 ELSE 0 END) AS score FROM facts
)
SELECT doc_id, score, CASE WHEN score >= 85 THEN 'compliant' WHEN score >= 60 THEN 'needs_review' ELSE 'non_compliant' END AS status FROM s""",
    "service_results": f"""
WITH d AS (SELECT doc_id, {stripped("coalesce(text, '')")} AS t, doc_id % 2 = 0 AS failed, doc_id % 3 = 0 AS scanned, (doc_id % 101)::INT AS score FROM documents),
c AS (SELECT *, CASE WHEN length(t) < 30 OR (length(t) - length(replace(t, '?', ''))) / length(t) > 0.20 THEN 'review_required' ELSE 'basic_accessible_scanned' END AS kind FROM d)
SELECT doc_id, length(t) >= 50 AS has_text,
       CASE WHEN NOT failed AND NOT scanned THEN CASE WHEN score >= 85 THEN 'full_accessible' WHEN score >= 60 THEN 'needs_review' ELSE 'non_compliant' END
            WHEN NOT failed THEN 'basic_accessible_scanned' WHEN scanned THEN kind ELSE 'review_required' END AS status,
       least(score, CASE WHEN NOT failed AND NOT scanned THEN 100 WHEN NOT failed THEN 75 WHEN scanned AND kind = 'basic_accessible_scanned' THEN 65 ELSE 45 END) AS score FROM c""",
    "page_texts": "WITH " + LINES_SQL + " SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY line_index) AS text FROM text_lines GROUP BY ALL",
    "line_key_values": "WITH " + LINES_SQL + "," + BLOCKS_SQL + f""",
lines_of AS (SELECT doc_id, page_num, line_index, text FROM text_lines UNION ALL SELECT doc_id, page_num::INT, block_seq::INT, text FROM blocks),
kv AS (SELECT doc_id, page_num, line_index, trim(regexp_extract(text, '{T.EDGE_KEY_AND_VALUE}', 1), ' ') AS label, trim(regexp_extract(text, '{T.EDGE_KEY_AND_VALUE}', 2), ' ') AS value, {matches("text", T.EDGE_KEY_VALUE)} AS kv FROM lines_of)
SELECT doc_id, page_num, line_index, label, value FROM kv WHERE kv AND label <> ''""",
    "scanned_files": f"""
WITH d AS (SELECT doc_id, length({stripped("left(translate(coalesce(text, ''), '()' || chr(92) || chr(10) || chr(13), ''), (doc_id % 90)::INT)")}) AS n FROM documents)
SELECT doc_id, (doc_id % 3 = 0 AND n < 50) OR n < 20 AS scanned FROM d""",
    "stored_strings": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, md5(t) AS decoded, md5(regexp_replace(regexp_replace(t, '[^\x00-\x{FF}]', '?', 'g'), '([\\()])', '\\\1', 'g')) AS literal,
       md5(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS html FROM d""",
    "content_marks": "WITH " + ELEMENTS_SQL + """
SELECT doc_id, false AS unmarked, elem_type AS tag, ord::BIGINT AS mcid FROM elements WHERE doc_id % 5 <> 0
UNION ALL SELECT DISTINCT doc_id, true, NULL, NULL::BIGINT FROM elements WHERE doc_id % 5 = 0""",
    "content_lines": "WITH " + LINES_SQL + r""",
plain AS (SELECT doc_id, page_num, line_index, trim(regexp_replace(regexp_replace(text, '[^\x20-\x7E]', '?', 'g'), ' +', ' ', 'g'), ' ') AS text FROM text_lines)
SELECT doc_id, page_num, line_index, text, round(780.0::DOUBLE - line_index * 12, 6) AS y, 10.0::DOUBLE AS font_size, CASE WHEN page_num % 2 = 0 THEN 'Arial-Bold' ELSE 'Arial' END AS font_name, page_num % 2 = 0 AS bold FROM plain""",
    "ocr_lines": "WITH " + _WORDS + """,
kept AS (SELECT * FROM words WHERE level = 5 AND conf >= 20 AND word <> ''),
l AS (SELECT doc_id, page_num, block_num, line_num, min(l) AS l, min(t) AS t, max(l + w) AS r, max(t + h) AS b, max(pt) AS pt, string_agg(word, ' ' ORDER BY s) AS text FROM kept GROUP BY ALL)
SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY block_num, line_num)::INT AS block_seq, text, round(l * pt, 6) AS x, round(t * pt, 6) AS y,
       round(greatest((r - l) * pt, 1), 6) AS width, round(greatest((b - t) * pt, 1), 6) AS height, round(greatest(greatest((b - t) * pt, 1) * 0.75::DOUBLE, 6), 6) AS font_size, false AS is_bold FROM l""",
    "ocr_confidences": "WITH " + _WORDS + """,
p AS (SELECT doc_id, page_num, round_even(avg(conf) / 100, 4) AS confidence FROM words WHERE level = 5 AND conf > 0 AND word <> '' GROUP BY ALL)
SELECT *, round(avg(confidence) OVER (PARTITION BY doc_id), 9) AS doc_confidence FROM p""",
    "mean_confidences": "WITH " + _WORDS + " SELECT doc_id, page_num, round(coalesce(avg(conf) FILTER (level = 5 AND conf >= 0), 100), 9) AS confidence FROM words GROUP BY ALL",
    "bold_fonts": """
WITH f AS (SELECT p_partkey, p_brand || '-' || ['Bold','-Light','SEMIBOLD','Demi','Heavy','Oblique','black'][p_size % 7 + 1] AS font FROM part)
SELECT p_partkey, font, regexp_matches(font, '(?i)bold|black|heavy|semibold|demi') AS bold FROM f""",
    "row_gaps": _ROWS + """
SELECT doc_id, page_num, row_no - 1 AS line_index, round(greatest(coalesce(lag(anchor) OVER (PARTITION BY doc_id, page_num ORDER BY row_no) - anchor, 0), 0), 6) AS gap_before, round(width, 6) AS width FROM rows_seen""",
    "column_patterns": _ROWS + """,
next_rows AS (SELECT *, CASE WHEN n > 1 THEN xs END AS a, lead(CASE WHEN n > 1 THEN xs END) OVER (PARTITION BY doc_id, page_num ORDER BY row_no) AS b FROM rows_seen)
SELECT doc_id, page_num, row_no, coalesce(least(len(a), len(b)) >= 2 AND abs(len(a) - len(b)) <= 1
  AND len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: abs(a[i] - b[i]) <= 16)) >= greatest(2, ceil(least(len(a), len(b)) * 0.65::DOUBLE)), false) AS same FROM next_rows""",
    "suggested_items": "WITH " + _REPLIES + " SELECT doc_id, 1 AS page_num, ord::INT AS ord, type, CASE WHEN type <> 'tr' THEN text END AS text FROM items",
    "suggested_cells": "WITH " + _REPLIES + " SELECT doc_id, 1 AS page_num, ord::INT AS ord, 1 AS col_no, CASE WHEN role = 'user' THEN 'TH' ELSE 'TD' END AS role, text FROM items WHERE type = 'tr'",
    "suggested_wrapped": "WITH " + _REPLIES + """
SELECT doc_id, 1 AS page_num, min(ord)::INT AS ord, coalesce(min(g), CASE WHEN min(type) = 'h2' THEN 'H2' ELSE 'P' END) AS elem_type, CASE WHEN min(g) IS NULL THEN coalesce(min(text), '') ELSE '' END AS text, count(g) AS n_items
FROM numbered_items GROUP BY doc_id, k""",
    "mark_owners": "WITH " + _MARKS + """
SELECT doc_id, page_num, mcid, CASE WHEN mcid % 3 <> 0 THEN CASE WHEN mcid % 2 = 0 THEN owner - 1 ELSE owner END END AS owner, mcid % 3 = 0 AS by_section FROM marks""",
    "unclaimed_marks": "WITH " + _MARKS + f" SELECT doc_id, page_num, mcid, 'P' AS elem_type, {stripped('text')} AS text FROM marks WHERE mcid % 3 = 0 AND {stripped('text')} <> ''",
    "page_lookup": "WITH " + LINES_SQL + " SELECT doc_id, page_num, line_index, CASE WHEN (doc_id + page_num) % 3 <> 0 THEN 'page ' || page_num END AS alt FROM text_lines",
    "job_documents": _J + _IDS + """
SELECT i.id, CASE WHEN j.id IS NULL THEN 'not_found' ELSE 'found' END AS state, j.status, j.pages,
       CASE WHEN j.status <> 'error' THEN len(regexp_split_to_array(o_orderpriority, '[- ]')) ELSE 0 END AS n_features,
       CASE WHEN j.status <> 'error' THEN array_to_string(regexp_split_to_array(o_orderpriority, '[- ]'), ',') ELSE '' END AS features
FROM ids i LEFT JOIN jobs j ON j.id = i.id LEFT JOIN orders ON o_orderkey = i.id""",
    "job_reports": _J + _IDS + """
SELECT i.id, CASE WHEN j.id IS NULL THEN 'not_found' WHEN j.status <> 'done' THEN 'pending' ELSE 'ready' END AS state,
       CASE WHEN j.status = 'done' THEN '{' || CASE WHEN j.pages IS NULL THEN '' ELSE '"pages":' || j.pages || ',' END || '"status":"done"}' END AS validation_report
FROM ids i LEFT JOIN jobs j ON j.id = i.id""",
    "job_deletes": _J + " SELECT id, status FROM jobs WHERE id % 3 <> 0",
    "job_upserts": _J + _IDS + " SELECT id, status, pages FROM jobs WHERE id % 3 <> 0 UNION ALL SELECT id, 'done', 7 FROM ids",
    "job_transitions": _J + "," + LOGS_SQL + """,
last AS (SELECT job_id, timestamp, status FROM logs WHERE status IN ('done', 'error') QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY timestamp DESC, id DESC) = 1)
SELECT j.id, coalesce(l.status, j.status) AS status, l.timestamp AS updated_at FROM jobs j LEFT JOIN last l ON l.job_id = j.id""",
    "audit_append": "WITH " + LOGS_SQL + """
SELECT id, job_id, operation, status, message, timestamp FROM logs
UNION ALL SELECT (SELECT max(id) FROM logs) + row_number() OVER (ORDER BY o_orderdate, o_orderkey), o_orderkey, 'start', 'processing', o_orderpriority, o_orderdate::TIMESTAMP FROM orders WHERE o_orderkey % 10 = 0""",
    "resource_alerts": _J + """,
d AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, avg(processing_time_seconds) FILTER (status = 'done') AS s, sum(file_size) AS b FROM jobs GROUP BY 1),
r AS (SELECT day, s, sum(b) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) / (1024 * 1024) AS mb FROM d)
SELECT day, round(s, 6) AS avg_seconds, round(mb, 6) AS stored_mb, coalesce(s > 300, false) AS slow, coalesce(mb > 500, false) AS full FROM r""",
    "slow_responses": "WITH " + LOGS_SQL + """,
w AS (SELECT job_id, epoch_us(timestamp) / 1e6::DOUBLE - lag(epoch_us(timestamp) / 1e6::DOUBLE) OVER (PARTITION BY job_id ORDER BY timestamp, id) AS wait FROM logs)
SELECT job_id, count(*) AS n, round(max(wait), 3) AS longest FROM w WHERE wait > 3600 GROUP BY 1""",
    "submission_summaries": "WITH " + ELEMENTS_SQL + """,
c AS (SELECT doc_id, count(*) FILTER (elem_type = 'L') AS l, count(*) FILTER (elem_type IN ('H1','H2','H3')) AS h FROM elements GROUP BY 1)
SELECT doc_id, '{"score":' || doc_id % 101 || ',"passed":' || CASE WHEN doc_id % 101 = 100 THEN 'true' ELSE 'false' END || ',"tables":0,"lists":' || l || ',"headings":' || h || ',"artifacts":0,"signatures":0}' AS scan_summary FROM c""",
    # queries that other modules register
    "mark_assignment": "WITH RECURSIVE " + _PAIRS + """,
leaves_of AS (SELECT doc_id, page_num, line_index AS ord, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY line_index) AS i FROM text_lines),
options AS (SELECT doc_id, page_num, ord, list(mcid ORDER BY score DESC, mcid) AS offered FROM scores WHERE score > 0.3 GROUP BY ALL),
asked AS MATERIALIZED (SELECT l.*, coalesce(o.offered, []) AS offered FROM leaves_of l LEFT JOIN options o USING (doc_id, page_num, ord)),
walk AS (
  SELECT DISTINCT doc_id, page_num, 0::BIGINT AS i, NULL::INT AS ord, []::INT[] AS taken, NULL::INT AS got FROM leaves_of
  UNION ALL
  SELECT a.doc_id, a.page_num, a.i, a.ord,
         CASE WHEN list_filter(a.offered, lambda m: NOT list_contains(w.taken, m))[1] IS NULL THEN w.taken ELSE list_append(w.taken, list_filter(a.offered, lambda m: NOT list_contains(w.taken, m))[1]) END,
         list_filter(a.offered, lambda m: NOT list_contains(w.taken, m))[1]
  FROM walk w JOIN asked a ON a.doc_id = w.doc_id AND a.page_num = w.page_num AND a.i = w.i + 1
),
matched AS (SELECT doc_id, page_num, ord, got AS mcid FROM walk WHERE got IS NOT NULL),
bare AS (SELECT doc_id, page_num, ord, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY ord) AS n FROM walk WHERE i > 0 AND got IS NULL),
spare AS (
  SELECT l.doc_id, l.page_num, l.ord AS mcid, row_number() OVER (PARTITION BY l.doc_id, l.page_num ORDER BY l.ord) AS n
  FROM leaves_of l LEFT JOIN matched m ON m.doc_id = l.doc_id AND m.page_num = l.page_num AND m.mcid = l.ord WHERE m.mcid IS NULL
)
SELECT doc_id, page_num, ord, mcid, true AS by_text FROM matched UNION ALL SELECT b.doc_id, b.page_num, b.ord, s.mcid, false FROM bare b JOIN spare s USING (doc_id, page_num, n)""",
    "kv_runs": _KV_RUNS,
    "edge_rows": _ROWS + " SELECT doc_id, page_num::INT AS page_num, row_no::INT AS row_no, text, CASE WHEN n > 1 THEN n END::INT AS n_cells FROM rows_seen",
}
