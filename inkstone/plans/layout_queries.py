"""Registered queries on positioned blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import layout
from inkstone.plans.text_queries import listed, matches
from inkstone.sources import bridge
from inkstone.sources.bridge import BLOCKS_SQL


def _blocks(f):
    return lambda spark, sf_dir: f(bridge.blocks(spark, sf_dir))


def _rules(blocks):
    """The boxes of blocks in large type as ruling lines."""
    blocks = blocks.filter("font_size >= 16")
    return bridge.rectangles(blocks.select("doc_id", "page_num", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1")))


QUERIES = {
    "block_order": _blocks(layout.scan_order),
    "header_footer_positions": _blocks(layout.running_blocks),
    "blocks_without_artifacts": _blocks(lambda b: layout.without_running(b).select(*layout.KEY)),
    "font_percentiles": _blocks(layout.font_sizes),
    "newsletter_score": _blocks(layout.newsletter_score),
    "page_gaps": _blocks(lambda b: layout.gaps(b).withColumns({"gap": F.round("gap", 6), "mean_gap": F.round("mean_gap", 6)})),
    "heading_levels": _blocks(layout.headings),
    "column_bands": _blocks(layout.column_bands),
    "line_clusters": _blocks(lambda b: layout.chain_clusters(b, "y", layout.PAGE).withColumn("centre", F.round("centre", 6))),
    "block_cell_assignment": _blocks(lambda b: layout.cell_blocks(b, layout.grid_cells(_rules(b)))),
    "border_tables": _blocks(lambda b: layout.border_tables(b, _rules(b))),
    "reading_order": _blocks(layout.reading_order),
    "row_groups": _blocks(layout.row_groups),
    "aligned_tables": _blocks(layout.aligned_tables),
    "kv_runs": _blocks(layout.key_value_runs),
    "implied_lists": _blocks(lambda b: layout.implied_lists(layout.list_candidates(b))),
}

_B = "WITH RECURSIVE " + BLOCKS_SQL
_RUNNING = BLOCKS_SQL + """,
edges AS (
  SELECT doc_id, page_num, block_seq, trunc(y / 10)::INT AS bucket FROM blocks
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y, block_seq) <= 3
       OR row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y DESC, block_seq DESC) <= 3
),
pages_of AS (SELECT doc_id, count(DISTINCT page_num) AS pages FROM blocks GROUP BY 1),
often AS (
  SELECT doc_id, bucket FROM edges JOIN pages_of USING (doc_id) GROUP BY doc_id, bucket
  HAVING count(DISTINCT page_num) >= greatest(3, trunc(max(pages) * 0.4::DOUBLE))
),
running AS (SELECT e.* FROM edges e JOIN often USING (doc_id, bucket))"""
_FONTS = """
sizes AS (SELECT doc_id, list_sort(list(font_size) FILTER (font_size > 0)) AS s, coalesce(median(font_size) FILTER (font_size > 0), 12) AS median FROM blocks GROUP BY 1),
fonts AS (
  SELECT doc_id, len(s) AS n, CASE WHEN len(s) < 4 THEN median ELSE s[trunc(len(s) * 0.10::DOUBLE)::INT + 1] END AS p10,
         CASE WHEN len(s) < 4 THEN median ELSE s[trunc(len(s) * 0.60::DOUBLE)::INT + 1] END AS p60,
         CASE WHEN len(s) < 4 THEN median ELSE s[trunc(len(s) * 0.75::DOUBLE)::INT + 1] END AS p75,
         CASE WHEN len(s) < 4 THEN median ELSE s[trunc(len(s) * 0.90::DOUBLE)::INT + 1] END AS p90, median
  FROM sizes
)"""
_GAPS = """
stepped AS (SELECT *, y - lag(y + height) OVER w AS g, row_number() OVER w AS nth FROM blocks WINDOW w AS (PARTITION BY doc_id, page_num ORDER BY y, block_seq)),
gaps AS (SELECT *, coalesce(g, y) AS gap, coalesce(avg(g) FILTER (g > 0) OVER (PARTITION BY doc_id, page_num), 0) AS mean_gap FROM stepped)"""
_ITEM = " OR ".join(matches("text", p) for p in (*T.LIST_ITEM, T.DEFINITION_ITEM))
_HEADINGS = BLOCKS_SQL + "," + _FONTS + "," + _GAPS + f""",
firsts AS (SELECT doc_id, min(page_num) AS first_page FROM blocks GROUP BY 1),
judged AS (
  SELECT g.*, f.p60, f.p75, f.p90, f.median, first_page, len({listed("text")}) AS n, mean_gap > 0 AND gap > mean_gap * 1.8::DOUBLE AS large
  FROM gaps g JOIN fonts f USING (doc_id) JOIN firsts USING (doc_id)
),
headings AS (
  SELECT doc_id, page_num, block_seq, CASE
    WHEN n > 25 OR {_ITEM} THEN NULL
    WHEN {matches("text", T.SECTION_COLON)} AND n <= 6 AND NOT contains(text, '.') AND NOT contains(text, ',')
      THEN CASE WHEN large AND gap > mean_gap * 2.5::DOUBLE THEN 1 ELSE 2 END
    WHEN page_num = first_page AND nth = 1 AND n <= 12 THEN 1
    WHEN p90 <= p60 * 1.05::DOUBLE THEN CASE
      WHEN NOT is_bold AND NOT large THEN NULL
      WHEN n <= 8 AND large AND gap > mean_gap * 3.0::DOUBLE THEN 1
      WHEN n <= 8 AND is_bold AND large THEN 2 WHEN n <= 8 AND is_bold THEN 3
      WHEN n <= 15 AND is_bold AND large THEN 3 END
    WHEN font_size >= p90 THEN 1 WHEN font_size >= p75 THEN 2
    WHEN (font_size >= p60 OR (is_bold AND font_size > median)) AND (is_bold OR large) THEN 3 END AS level
  FROM judged
)"""


def _chain(source: str, value: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT doc_id, page_num, cluster, avg(v) AS centre, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY doc_id, page_num ORDER BY v)::BIGINT AS cluster FROM (
      SELECT doc_id, page_num, v, (coalesce(v - lag(v) OVER (PARTITION BY doc_id, page_num ORDER BY v) > 4, true))::INT AS new
      FROM (SELECT DISTINCT doc_id, page_num, {value} AS v FROM {source}))) GROUP BY ALL
)"""


_GRID = BLOCKS_SQL + """,
rules AS (
  SELECT doc_id, page_num, e.x0, e.y0, e.x1, e.y1 FROM (
    SELECT doc_id, page_num, unnest([{'x0': x, 'y0': y, 'x1': x + width, 'y1': y}, {'x0': x, 'y0': y + height, 'x1': x + width, 'y1': y + height},
      {'x0': x, 'y0': y, 'x1': x, 'y1': y + height}, {'x0': x + width, 'y0': y, 'x1': x + width, 'y1': y + height}]) AS e FROM blocks WHERE font_size >= 16)
),
level AS (SELECT * FROM rules WHERE abs(y1 - y0) <= 3 AND abs(x1 - x0) >= 10),
upright AS (SELECT * FROM rules WHERE abs(x1 - x0) <= 3 AND abs(y1 - y0) >= 10),""" + _chain("level", "y0", "ys") + "," + _chain("upright", "x0", "xs") + """,
row_bands AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY top) AS row_no, count(*) OVER (PARTITION BY doc_id, page_num) AS n_rows FROM (
    SELECT doc_id, page_num, centre AS top, lead(centre) OVER (PARTITION BY doc_id, page_num ORDER BY cluster) AS bottom FROM ys) WHERE bottom - top >= 8
),
col_bands AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY l DESC) AS col_no FROM (
    SELECT doc_id, page_num, centre AS l, lead(centre) OVER (PARTITION BY doc_id, page_num ORDER BY cluster) AS r FROM xs) WHERE r - l >= 15
),
cells AS (SELECT * FROM row_bands JOIN col_bands USING (doc_id, page_num) WHERE n_rows >= 2),
held AS (
  SELECT b.doc_id, b.page_num, b.block_seq, b.text, c.row_no, c.col_no FROM blocks b JOIN cells c ON b.doc_id = c.doc_id AND b.page_num = c.page_num
    AND b.x >= c.l - 4 AND b.x + b.width <= c.r + 4 AND b.y >= c.top - 4 AND b.y + b.height <= c.bottom + 4
)"""


def _fold(tolerance: float) -> str:
    return BLOCKS_SQL + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y, block_seq) AS i FROM blocks),
folded AS (
  SELECT doc_id, page_num, block_seq, x, y, width, i, y AS anchor, 1 AS line FROM ranked WHERE i = 1
  UNION ALL
  SELECT r.doc_id, r.page_num, r.block_seq, r.x, r.y, r.width, r.i, CASE WHEN r.y - f.anchor > {tolerance} THEN r.y ELSE f.anchor END,
         f.line + CASE WHEN r.y - f.anchor > {tolerance} THEN 1 ELSE 0 END
  FROM folded f JOIN ranked r ON r.doc_id = f.doc_id AND r.page_num = f.page_num AND r.i = f.i + 1
)"""


SQL = {
    "block_order": _B + " SELECT doc_id, page_num, block_seq, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, y, x DESC, block_seq) AS place FROM blocks",
    "header_footer_positions": "WITH " + _RUNNING + " SELECT * FROM running",
    "blocks_without_artifacts": "WITH " + _RUNNING + """
SELECT doc_id, page_num, block_seq FROM blocks b WHERE NOT EXISTS (
  SELECT 1 FROM running r JOIN pages_of p USING (doc_id) WHERE p.pages >= 3 AND r.doc_id = b.doc_id AND r.page_num = b.page_num AND r.block_seq = b.block_seq)""",
    "font_percentiles": _B + "," + _FONTS + " SELECT * FROM fonts",
    "newsletter_score": _B + "," + _FONTS + " SELECT doc_id, CASE WHEN n >= 8 AND p10 > 0 AND p90 / p10 > 2.5 THEN 4.0 ELSE 0.0 END::DOUBLE AS score FROM fonts",
    "page_gaps": _B + "," + _GAPS + " SELECT doc_id, page_num, block_seq, round(gap, 6) AS gap, round(mean_gap, 6) AS mean_gap, nth FROM gaps",
    "heading_levels": "WITH " + _HEADINGS + " SELECT * FROM headings",
    "column_bands": _B + """,
p AS (SELECT doc_id, page_num, count(DISTINCT round_even(x / 60, 0)) AS bands FROM blocks GROUP BY ALL),
d AS (SELECT doc_id, count(*) FILTER (bands >= 3) AS table_pages FROM p GROUP BY 1)
SELECT doc_id, table_pages, CASE WHEN table_pages >= 3 THEN 3 WHEN table_pages >= 1 THEN 1 ELSE 0 END AS bonus FROM d""",
    "line_clusters": _B + "," + _chain("blocks", "y", "clusters") + " SELECT doc_id, page_num, cluster, round(centre, 6) AS centre, n FROM clusters",
    "block_cell_assignment": "WITH " + _GRID + " SELECT doc_id, page_num, block_seq, row_no, col_no FROM held",
    "border_tables": "WITH " + _GRID + """
SELECT c.doc_id, c.page_num, c.row_no, c.col_no, CASE WHEN c.row_no = 1 THEN 'TH' ELSE 'TD' END AS role,
       coalesce(string_agg(h.text, ' ' ORDER BY h.block_seq), '') AS text
FROM cells c LEFT JOIN held h USING (doc_id, page_num, row_no, col_no) GROUP BY ALL""",
    "reading_order": "WITH RECURSIVE " + _fold(8.0) + " SELECT doc_id, page_num, block_seq, line, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, line, x DESC, y, block_seq) AS place FROM folded",
    "row_groups": "WITH RECURSIVE " + _fold(6.0) + " SELECT doc_id, page_num, block_seq, line AS row_no, row_number() OVER (PARTITION BY doc_id, page_num, line ORDER BY x DESC, y, block_seq) AS col_no FROM folded",
    "aligned_tables": "WITH RECURSIVE " + _fold(6.0) + """,
placed AS (SELECT *, x + width / 2 AS centre, row_number() OVER (PARTITION BY doc_id, page_num, line ORDER BY x DESC, y, block_seq) AS col_no FROM folded),
rows_of AS (SELECT doc_id, page_num, line, list(centre ORDER BY col_no) AS c FROM placed GROUP BY ALL HAVING count(*) >= 2),
lagged AS (SELECT *, lag(c) OVER (PARTITION BY doc_id, page_num ORDER BY line) AS b FROM rows_of),
grouped AS (
  SELECT *, sum(CASE WHEN abs(len(c) - len(b)) <= 1 AND len(list_filter(range(1, least(len(c), len(b)) + 1), lambda i: abs(c[i] - b[i]) <= 22)) >= least(len(c), len(b)) * 0.7::DOUBLE THEN 0 ELSE 1 END)
    OVER (PARTITION BY doc_id, page_num ORDER BY line)::BIGINT AS table_no FROM lagged
),
kept AS (
  SELECT doc_id, page_num, line, table_no, row_number() OVER (PARTITION BY doc_id, page_num, table_no ORDER BY line) AS row_no
  FROM grouped QUALIFY count(*) OVER (PARTITION BY doc_id, page_num, table_no) >= 2
)
SELECT p.doc_id, p.page_num, k.table_no, k.row_no, p.col_no, p.block_seq FROM placed p JOIN kept k USING (doc_id, page_num, line)""",
}
