"""Bridges from generic tables to the engine's relations: jobs, logs, blocks, text lines.

The engine works on relations of extracted documents.  Where such relations aren't stored
themselves, these functions derive stand-ins with the same shape from the test tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions.text import NWS, WS, clean, cleaned, estimated_width

LINES_PER_PAGE = 40


#: Tables of long texts, on which expressions are dear.
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table.  Texts that come in fewer than two pieces a core are dealt out anew, as a
    small file's pieces may all but one be empty; large tables have many files or row groups."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXT_TABLES and df.rdd.getNumPartitions() < 2 * cores else df


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger: one row per order; pages, size and seconds from its lines, null without any."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.sum("l_quantity").alias("processing_time_seconds"),
    )
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "error").otherwise("processing")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    return orders.join(lines, "id", "left").select("id", F.concat(F.lit("doc-"), "id", F.lit("_v1.pdf")).alias("original_name"), F.floor(F.col("cents") / 100).cast("long").alias("file_size"), "pages", "status", "created_at", "processing_time_seconds")


JOBS_SQL = """
jobs AS (
  SELECT o_orderkey AS id, 'doc-' || o_orderkey || '_v1.pdf' AS original_name,
         l.cents // 100 AS file_size, l.pages,
         CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'error' ELSE 'processing' END AS status,
         o_orderdate AS created_at, l.seconds AS processing_time_seconds
  FROM orders LEFT JOIN (
    SELECT l_orderkey, count(*) AS pages, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, sum(l_quantity) AS seconds
    FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey
)"""


def operation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log: one row per event; error events failed, purchases completed, others started."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").otherwise("processing")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("operation"), status.alias("status"), F.col("props").alias("message"), F.col("ts").alias("timestamp"), "value")


LOGS_SQL = """
logs AS (
  SELECT event_id AS id, user_id AS job_id, event_type AS operation,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'processing' END AS status,
         props AS message, ts AS timestamp, value
  FROM events
)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned text blocks: a page per four orders, twenty pages a document, a block per line
    item, in five columns and sixty rows that are a little uneven."""
    li = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    page = F.floor(F.col("l_orderkey") / 4).cast("long")
    seq = F.row_number().over(W.partitionBy(page).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    kind = F.pmod("l_partkey", F.lit(6))
    text = (
        F.when(kind == 0, F.concat(F.lit("Section "), "l_linenumber", F.lit(":")))
        .when(kind == 1, F.concat("l_linenumber", F.lit(". item "), "l_partkey"))
        .when(kind == 2, F.concat(F.lit("Part: "), "l_partkey"))
        .when(kind == 3, F.concat(F.lit("short line "), "l_suppkey"))
        .when(kind == 4, F.concat(F.lit("signed by supplier "), "l_suppkey"))
        .otherwise(F.concat(F.lit("a paragraph of more words than a heading may have, so that it is taken for what it is and for nothing else in any rule of the detector about part "), "l_partkey"))
    )
    return li.select(
        F.floor(F.col("l_orderkey") / 80).cast("long").alias("doc_id"),
        page.alias("page_num"),
        seq.alias("block_seq"),
        text.alias("text"),
        (F.pmod(F.col("l_quantity").cast("long"), F.lit(5)) * 110.0).alias("x"),
        (F.pmod(cents, F.lit(60)) * 13.0 + F.pmod(F.floor(cents / 60), F.lit(5))).alias("y"),
        (F.length(text) * 5.0).alias("width"),
        F.lit(10.0).alias("height"),
        (F.round(F.col("l_discount") * 100) + 8).alias("font_size"),
        (F.col("l_returnflag") == "R").alias("is_bold"),
    )


BLOCKS_SQL = """
blocks AS (
  SELECT *, length(text) * 5.0::DOUBLE AS width, 10.0::DOUBLE AS height FROM (
    SELECT l_orderkey // 80 AS doc_id, l_orderkey // 4 AS page_num,
           row_number() OVER (PARTITION BY l_orderkey // 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS block_seq,
           CASE l_partkey % 6
             WHEN 0 THEN 'Section ' || l_linenumber || ':'
             WHEN 1 THEN l_linenumber || '. item ' || l_partkey
             WHEN 2 THEN 'Part: ' || l_partkey
             WHEN 3 THEN 'short line ' || l_suppkey
             WHEN 4 THEN 'signed by supplier ' || l_suppkey
             ELSE 'a paragraph of more words than a heading may have, so that it is taken for what it is and for nothing else in any rule of the detector about part ' || l_partkey END AS text,
           (l_quantity::BIGINT % 5) * 110.0::DOUBLE AS x,
           (round(l_extendedprice * 100)::BIGINT % 60) * 13.0::DOUBLE + round(l_extendedprice * 100)::BIGINT // 60 % 5 AS y,
           round(l_discount * 100) + 8 AS font_size, l_returnflag = 'R' AS is_bold
    FROM lineitem)
)"""


def text_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_per_page: int = LINES_PER_PAGE, keep: tuple[str, ...] = (), measured: int | None = None) -> DataFrame:
    """Plain text as layout lines: normalised, blanks dropped, with made-up geometry.

    Lines stand 14 points apart from 800 downwards on each page; pages of a fixed number of
    lines are this engine's own addition.  keep: further columns to carry along.  measured: lines
    of more characters are given no width, for readers that ask for none.
    """
    width = estimated_width(F.col("text"), 12.0)
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)  # one character is split at without a pattern; a \r before it is a blank
    lines = F.filter(F.transform(parts, cleaned), lambda t: t != "")
    rows = documents.select(F.col(id_col).alias("doc_id"), *keep, F.posexplode(lines).alias("line_no", "text"))
    index = F.pmod("line_no", F.lit(lines_per_page))
    return rows.select(
        "doc_id",
        (F.floor(F.col("line_no") / lines_per_page) + 1).cast("int").alias("page_num"),
        index.cast("int").alias("line_index"),
        "text",
        F.lit(0.0).alias("x"),
        (800.0 - index * 14).alias("y"),
        (width if measured is None else F.when(F.length("text") <= measured, width)).alias("width"),
        F.lit(12.0).alias("font_size"),
        F.when(index == 0, 0.0).otherwise(14.0).alias("gap_before"),
        *keep,
    )


def clean_sql(x: str) -> str:
    """Whitespace runs to one space, ends stripped; the SQL twin of functions.text.clean."""
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


LINES_SQL = rf"""
raw_lines AS (
  SELECT doc_id, {clean_sql("line")} AS text, pos
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS parts FROM documents))
),
numbered AS (
  SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no FROM raw_lines WHERE text <> ''
),
sized AS (
  SELECT *, length(regexp_replace(text, '[^\x{{590}}-\x{{5FF}}]', '', 'g')) AS rtl,
         length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS latin FROM numbered
),
text_lines AS (
  SELECT doc_id, (line_no // 40 + 1)::INT AS page_num, (line_no % 40)::INT AS line_index, text, 0.0::DOUBLE AS x,
         800.0::DOUBLE - (line_no % 40) * 14 AS y,
         rtl * 6.6::DOUBLE + latin * 6.0::DOUBLE + (length(text) - rtl - latin) * 4.2::DOUBLE AS width,
         12.0::DOUBLE AS font_size, CASE WHEN line_no % 40 = 0 THEN 0.0 ELSE 14.0 END::DOUBLE AS gap_before
  FROM sized
)"""


def html_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Element rows of HTML pages in document order: (doc_id, ord, elem_type, text).

    Covers what the scoring rules look at: headings, list items, list openings, paragraphs,
    tables and their cells.
    """
    body = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    found = F.regexp_extract_all(body, F.lit(ELEMENT), F.lit(0))
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("ord", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([A-Za-z]+[1-6]?)", 1))
    text = clean(F.regexp_replace("raw", r"(?s)<[^>]*>", ""))
    kinds = F.create_map(*[F.lit(x) for pair in TAG_TYPES.items() for x in pair])
    return rows.select("doc_id", "ord", F.element_at(kinds, tag).alias("elem_type"), text.alias("text"))


#: HTML tags and the structure types that they stand for.
TAG_TYPES = {"h1": "H1", "h2": "H2", "h3": "H3", "h4": "H4", "h5": "H5", "h6": "H6", "p": "P", "li": "LI", "ul": "L", "ol": "L", "table": "Table", "tr": "TR", "th": "TH", "td": "TD", "img": "Figure"}
ELEMENT = r"(?is)<h[1-6][^>]*>.*?</h[1-6]>|<(?:p|li|th|td)(?:\s[^>]*)?>.*?</(?:p|li|th|td)>|<(?:ul|ol|table|tr|img)(?:\s[^>]*)?>"

ELEMENTS_SQL = rf"""
found AS (
  SELECT page_id AS doc_id, regexp_extract_all(
    regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '{ELEMENT}') AS raws
  FROM pages
),
rows_of AS (SELECT doc_id, unnest(raws) AS raw, generate_subscripts(raws, 1) - 1 AS ord FROM found),
elements AS (
  SELECT doc_id, ord::INT AS ord,
         CASE lower(regexp_extract(raw, '^<([A-Za-z]+[1-6]?)', 1)) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAG_TYPES.items())} END AS elem_type,
         {clean_sql("regexp_replace(raw, '(?s)<[^>]*>', '', 'g')")} AS text
  FROM rows_of
)"""


def page_facts(pages: DataFrame) -> DataFrame:
    """Per page what document-level rules ask for: language and title, null where missing."""
    first = lambda pattern: F.nullif(clean(F.regexp_extract(F.coalesce("html", F.lit("")), pattern, 1)), F.lit(""))
    return pages.select(F.col("page_id").alias("doc_id"), first(LANG).alias("lang"), first(TITLE).alias("title"), "url")


LANG = r'(?i)<html[^>]*\slang="([^"]*)"'
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
FACTS_SQL = f"""
facts AS (
  SELECT page_id AS doc_id, nullif({clean_sql(f"regexp_extract(coalesce(html, ''), '{LANG}', 1)")}, '') AS lang,
         nullif({clean_sql(f"regexp_extract(coalesce(html, ''), '{TITLE}', 1)")}, '') AS title, url
  FROM pages
)"""


def ocr_lines(words: DataFrame) -> DataFrame:
    """OCR words as positioned lines (blocks).

    words: doc_id, page_num, word_seq, level, block_num, par_num, line_num, left, top, width,
    height, conf, text, dpi.  Words below confidence 20 and blanks are dropped.
    """
    kept = words.filter((F.col("level") == 5) & (F.col("conf") >= 20)).withColumn("word", F.regexp_replace(F.regexp_replace("text", f"^{WS}+", ""), f"{WS}+$", "")).filter("word <> ''")
    point = 72.0 / F.when(F.col("dpi") > 0, F.col("dpi")).otherwise(200)
    lines = kept.groupBy("doc_id", "page_num", "block_num", "par_num", "line_num").agg(
        F.min("left").alias("l"), F.min("top").alias("t"), F.max(F.col("left") + F.col("width")).alias("r"), F.max(F.col("top") + F.col("height")).alias("b"),
        F.max(point).alias("pt"), F.sort_array(F.collect_list(F.struct("word_seq", "word"))).alias("words"),
    )
    height = F.greatest((F.col("b") - F.col("t")) * F.col("pt"), F.lit(1.0))
    seq = F.row_number().over(W.partitionBy("doc_id", "page_num").orderBy("block_num", "par_num", "line_num"))
    return lines.select(
        "doc_id", "page_num", seq.alias("block_seq"), F.array_join("words.word", " ").alias("text"), (F.col("l") * F.col("pt")).alias("x"), (F.col("t") * F.col("pt")).alias("y"),
        F.greatest((F.col("r") - F.col("l")) * F.col("pt"), F.lit(1.0)).alias("width"), height.alias("height"), F.greatest(height * 0.75, F.lit(6.0)).alias("font_size"), F.lit(False).alias("is_bold"),
    )


def ocr_confidences(words: DataFrame) -> DataFrame:
    """Mean confidence per page (0 to 1, four places; words of positive confidence) and its mean per document."""
    good = words.filter((F.col("level") == 5) & (F.col("conf") > 0) & F.col("text").rlike(NWS))
    per_page = good.groupBy("doc_id", "page_num").agg(F.bround(F.avg("conf") / 100, 4).alias("confidence"))
    return per_page.withColumn("doc_confidence", F.avg("confidence").over(W.partitionBy("doc_id")))


def rectangles(rects: DataFrame) -> DataFrame:
    """The four edges of rectangles as ruling lines, normalised; only level or upright ones stay."""
    edge = lambda a, b, c, d: F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    edges = F.explode(F.array(edge(x0, y0, x1, y0), edge(x0, y1, x1, y1), edge(x0, y0, x0, y1), edge(x1, y0, x1, y1)))
    rows = rects.select("doc_id", "page_num", edges.alias("e")).select("doc_id", "page_num", "e.*")
    return rows.filter(is_level() | is_upright())


def is_level() -> Column:
    return (F.abs(F.col("y1") - F.col("y0")) <= 3) & (F.abs(F.col("x1") - F.col("x0")) >= 10)


def is_upright() -> Column:
    return (F.abs(F.col("x1") - F.col("x0")) <= 3) & (F.abs(F.col("y1") - F.col("y0")) >= 10)
