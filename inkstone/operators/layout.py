"""Operators on positioned blocks: order, running blocks, fonts, gaps, headings, rows, tables.

blocks: doc_id, page_num, block_seq, text, x, y (from the top), width, height, font_size,
is_bold.  (doc_id, page_num, block_seq) is unique; block_seq breaks ties of position.
"""

from __future__ import annotations

from bisect import insort
from itertools import groupby
from operator import attrgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators.walk import by_document
from inkstone.sources.bridge import is_level, is_upright

KEY = ["doc_id", "page_num", "block_seq"]
PAGE = ["doc_id", "page_num"]

# fixed values: distances in points, and shares
LINE_TOLERANCE, ROW_TOLERANCE, COLUMN_TOLERANCE, COLUMN_SHARE = 8.0, 6.0, 22.0, 0.7
CHAIN, MIN_CELL_WIDTH, MIN_CELL_HEIGHT, CELL_MARGIN = 4.0, 15.0, 8.0, 4.0
BUCKET, EDGE_BLOCKS, ARTIFACT_SHARE, ARTIFACT_PAGES = 10.0, 3, 0.40, 3
BAND = 60.0


def scan_order(blocks: DataFrame) -> DataFrame:
    """Blocks with their place by page, height, and right before left."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("page_num", "y", F.desc("x"), "block_seq"))
    return blocks.select(*KEY, place.alias("place"))


def _folded(blocks: DataFrame, tolerance: float) -> DataFrame:
    """The line of each block: a line takes blocks within tolerance of its first one.

    A fold per page over blocks sorted by height; a new line starts where the first block of
    the current one is too far, which no window over neighbours can tell.
    """
    item = F.struct("y", "block_seq", "x")
    first = F.struct(F.lit(-1e300).alias("anchor"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(state: Column, b: Column) -> Column:
        new = b["y"] - state["anchor"] > tolerance
        line = state["line"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, b["y"]).otherwise(state["anchor"]).alias("anchor"), line.alias("line"), F.concat(state["lines"], F.array(line)).alias("lines"))

    pages = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("b"))
    lines = F.aggregate("b", first, step, lambda s: s["lines"])
    both = pages.select(*PAGE, F.explode(F.arrays_zip(F.col("b"), lines.alias("l"))).alias("e"))
    return both.select(*PAGE, F.col("e.b.block_seq").alias("block_seq"), F.col("e.l").alias("line"), F.col("e.b.x").alias("x"), F.col("e.b.y").alias("y"))


def reading_order(blocks: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Blocks with line and place: pages and lines downwards, right to left inside a line."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("page_num", "line", F.desc("x"), "y", "block_seq"))
    return _folded(blocks, tolerance).select(*KEY, "line", place.alias("place"))


def row_groups(blocks: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Blocks with their table row and column (right to left)."""
    column = F.row_number().over(W.partitionBy(*PAGE, "line").orderBy(F.desc("x"), "y", "block_seq"))
    return _folded(blocks, tolerance).select(*KEY, F.col("line").alias("row_no"), column.alias("col_no"))


def aligned_tables(blocks: DataFrame) -> DataFrame:
    """Cells of tables found by aligned columns: (doc, page, table_no, row_no, col_no, block_seq).

    Rows of one block are passed over; following rows belong together if their counts differ
    by one at most and enough of their centres, paired from the right, are close.
    """
    placed = row_groups(blocks).join(blocks.select(*KEY, (F.col("x") + F.col("width") / 2).alias("centre")), KEY)
    rows = placed.groupBy(*PAGE, "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", "centre"))).alias("c")).filter(F.size("c") >= 2)
    by_row = W.partitionBy(*PAGE).orderBy("row_no")
    rows = rows.withColumn("before", F.lag("c").over(by_row))
    n, m = F.size("c"), F.size("before")
    close = F.size(F.filter(F.zip_with(F.col("c"), F.col("before"), lambda a, b: F.abs(a["centre"] - b["centre"]) <= COLUMN_TOLERANCE), lambda x: F.coalesce(x, F.lit(False))))
    fits = F.coalesce((F.abs(n - m) <= 1) & (close >= F.least(n, m) * COLUMN_SHARE), F.lit(False))
    rows = rows.withColumn("table_no", F.sum(F.when(fits, 0).otherwise(1)).over(by_row.rowsBetween(W.unboundedPreceding, 0)))
    table = W.partitionBy(*PAGE, "table_no")
    rows = rows.withColumn("n_rows", F.count(F.lit(1)).over(table)).filter("n_rows >= 2").withColumn("table_row", F.row_number().over(table.orderBy("row_no")))
    kept = rows.select(*PAGE, "row_no", "table_no", "table_row")
    return placed.join(kept, [*PAGE, "row_no"]).select(*PAGE, "table_no", F.col("table_row").alias("row_no"), "col_no", "block_seq")


def running_blocks(blocks: DataFrame, share: float = ARTIFACT_SHARE) -> DataFrame:
    """Keys of running headers and footers: blocks among the first or last three of their page
    whose height bucket recurs on enough pages of the document."""
    page = W.partitionBy(*PAGE)
    edges = blocks.select(*KEY, "y", F.row_number().over(page.orderBy("y", "block_seq")).alias("up"), F.row_number().over(page.orderBy(F.desc("y"), F.desc("block_seq"))).alias("down"))
    edges = edges.filter((F.col("up") <= EDGE_BLOCKS) | (F.col("down") <= EDGE_BLOCKS)).select(*KEY, (F.col("y") / BUCKET).cast("int").alias("bucket"))
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page_num").alias("pages"))
    counts = edges.groupBy("doc_id", "bucket").agg(F.countDistinct("page_num").alias("n")).join(pages, "doc_id")
    often = counts.filter(F.col("n") >= F.greatest(F.lit(ARTIFACT_PAGES), (F.col("pages") * share).cast("int")))
    return edges.join(often.select("doc_id", "bucket"), ["doc_id", "bucket"], "left_semi").select(*KEY, "bucket")


def without_running(blocks: DataFrame) -> DataFrame:
    """Blocks that aren't running headers or footers; documents of one or two pages have none."""
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page_num").alias("pages")).filter("pages >= 3").select("doc_id")
    return blocks.join(running_blocks(blocks).join(pages, "doc_id", "left_semi"), KEY, "left_anti")


def font_sizes(blocks: DataFrame) -> DataFrame:
    """Per document the 10th, 60th, 75th, 90th percentile by index, and the median, of sizes.

    With fewer than four sizes all are the median, 12 without any.
    """
    return _sizes(blocks).drop("first_page")


def _sizes(blocks: DataFrame) -> DataFrame:
    """font_sizes, and the document's first page, by one aggregate."""
    s = F.sort_array(F.collect_list(F.when(F.col("font_size") > 0, F.col("font_size"))))
    median = F.percentile(F.when(F.col("font_size") > 0, F.col("font_size")), 0.5)
    d = blocks.groupBy("doc_id").agg(s.alias("s"), F.coalesce(median, F.lit(12.0)).alias("median"), F.min("page_num").alias("first_page"))
    n = F.size("s")
    at = lambda q: F.when(n < 4, F.col("median")).otherwise(F.try_element_at("s", (n * F.lit(q)).cast("int") + 1))
    return d.select("doc_id", n.alias("n"), at(0.10).alias("p10"), at(0.60).alias("p60"), at(0.75).alias("p75"), at(0.90).alias("p90"), "median", "first_page")


def newsletter_score(blocks: DataFrame) -> DataFrame:
    f = font_sizes(blocks)
    return f.select("doc_id", F.when((F.col("n") >= 8) & (F.col("p10") > 0) & (F.col("p90") / F.col("p10") > 2.5), 4.0).otherwise(0.0).alias("score"))


def gaps(blocks: DataFrame) -> DataFrame:
    """The gap above each block (the first of a page: its height), and the page's mean gap."""
    return _with_gaps(blocks).select(*KEY, "gap", "mean_gap", "nth")


def _with_gaps(blocks: DataFrame) -> DataFrame:
    """blocks with gap, mean_gap and nth, by windows over one exchange."""
    by_y = W.partitionBy(*PAGE).orderBy("y", "block_seq")
    rows = blocks.withColumns({"__gap": F.col("y") - F.lag(F.col("y") + F.col("height")).over(by_y), "nth": F.row_number().over(by_y)})
    mean = F.coalesce(F.avg(F.when(F.col("__gap") > 0, F.col("__gap"))).over(W.partitionBy(*PAGE)), F.lit(0.0))
    return rows.withColumns({"gap": F.coalesce("__gap", "y"), "mean_gap": mean}).drop("__gap")


def headings(blocks: DataFrame) -> DataFrame:
    """The heading level of each block, null for none."""
    rows = _with_gaps(blocks).join(_sizes(blocks), "doc_id")
    t = T.strip(F.col("text"))
    n, gap, mean, size, bold = T.n_words(t), F.col("gap"), F.col("mean_gap"), F.col("font_size"), F.col("is_bold")
    large = (mean > 0) & (gap > mean * 1.8)
    uniform = (
        F.when(~bold & ~large, None)
        .when((n <= 8) & large & (gap > mean * 3.0), 1)
        .when((n <= 8) & bold & large, 2)
        .when((n <= 8) & bold, 3)
        .when((n <= 15) & bold & large, 3)
    )
    varied = F.when(size >= F.col("p90"), 1).when(size >= F.col("p75"), 2).when(((size >= F.col("p60")) | (bold & (size > F.col("median")))) & (bold | large), 3)
    section = T.is_section(t) & (n <= 6) & ~t.contains(".") & ~t.contains(",")
    level = (
        F.when((n > 25) | T.is_list_item(t), None)
        .when(section, F.when(large & (gap > mean * 2.5), 1).otherwise(2))
        .when((F.col("page_num") == F.col("first_page")) & (F.col("nth") == 1) & (n <= 12), 1)
        .otherwise(F.when(F.col("p90") <= F.col("p60") * 1.05, uniform).otherwise(varied))
    )
    return rows.select(*KEY, level.cast("int").alias("level"))


def column_bands(blocks: DataFrame) -> DataFrame:
    """Pages with three column bands or more, per document, and the bonus they give."""
    pages = blocks.groupBy(*PAGE).agg(F.countDistinct(F.bround(F.col("x") / BAND)).alias("bands"))
    d = pages.groupBy("doc_id").agg(F.count_if(F.col("bands") >= 3).alias("table_pages"))
    return d.select("doc_id", "table_pages", F.when(F.col("table_pages") >= 3, 3).when(F.col("table_pages") >= 1, 1).otherwise(0).alias("bonus"))


def chain_clusters(values: DataFrame, value: str, keys: list[str], step: float = CHAIN) -> DataFrame:
    """Clusters of distinct values in which each is within step of the one before; their means."""
    rows = values.select(*keys, value).distinct()
    by_value = W.partitionBy(*keys).orderBy(value)
    new = F.coalesce(F.col(value) - F.lag(value).over(by_value) > step, F.lit(True))
    rows = rows.withColumn("__new", new.cast("int")).withColumn("cluster", F.sum("__new").over(by_value.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "cluster").agg(F.avg(value).alias("centre"), F.count(F.lit(1)).alias("n"))


def grid_cells(rules: DataFrame) -> DataFrame:
    """Cells between ruling lines: (doc, page, row_no, col_no, left, top, right, bottom).

    Pages need two level and two upright lines, in two places each; all rules of a page are
    one grid; narrow columns and low rows are left out; columns count from the right.
    """
    level, upright = rules.filter(is_level()), rules.filter(is_upright())
    enough = level.groupBy(*PAGE).count().filter("count >= 2").join(upright.groupBy(*PAGE).count().filter("count >= 2"), PAGE, "left_semi").select(*PAGE)

    def bands(lines: DataFrame, at: str, lo: str, hi: str, least: float) -> DataFrame:
        places = chain_clusters(lines.join(enough, PAGE, "left_semi"), at, PAGE)
        return places.select(*PAGE, F.col("centre").alias(lo), F.lead("centre").over(W.partitionBy(*PAGE).orderBy("cluster")).alias(hi)).filter(F.col(hi) - F.col(lo) >= least)

    rows = bands(level, "y0", "top", "bottom", MIN_CELL_HEIGHT).withColumn("row_no", F.row_number().over(W.partitionBy(*PAGE).orderBy("top")))
    rows = rows.withColumn("n_rows", F.count(F.lit(1)).over(W.partitionBy(*PAGE))).filter("n_rows >= 2").drop("n_rows")
    columns = bands(upright, "x0", "left", "right", MIN_CELL_WIDTH).withColumn("col_no", F.row_number().over(W.partitionBy(*PAGE).orderBy(F.desc("left"))))
    return rows.join(columns, PAGE)


def cell_blocks(blocks: DataFrame, cells: DataFrame, margin: float = CELL_MARGIN) -> DataFrame:
    """Blocks inside cells, give or take the margin; a block may lie in two neighbours."""
    b = blocks.select(*KEY, "x", "y", (F.col("x") + F.col("width")).alias("x_right"), (F.col("y") + F.col("height")).alias("y_bottom"))
    inside = (F.col("x") >= F.col("left") - margin) & (F.col("x_right") <= F.col("right") + margin) & (F.col("y") >= F.col("top") - margin) & (F.col("y_bottom") <= F.col("bottom") + margin)
    return b.join(cells, PAGE).filter(inside).select(*KEY, "row_no", "col_no")


def border_tables(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells with their texts: (doc, page, row_no, col_no, role, text); the first row is the header."""
    cells = grid_cells(rules)
    held = cell_blocks(blocks, cells).join(blocks.select(*KEY, T.strip(F.col("text")).alias("t")), KEY).filter("t <> ''")
    texts = held.groupBy(*PAGE, "row_no", "col_no").agg(F.sort_array(F.collect_list(F.struct("block_seq", "t"))).alias("ts"))
    return cells.join(texts, [*PAGE, "row_no", "col_no"], "left").select(*PAGE, "row_no", "col_no", F.when(F.col("row_no") == 1, "TH").otherwise("TD").alias("role"), F.coalesce(F.array_join("ts.t", " "), F.lit("")).alias("text"))


# --- rules that depend on their own earlier output: a document at a time

# fixed values
KV_SHIFT, KV_ROWS = 24.0, 3
LIST_ITEMS, LIST_WORDS, LIST_CHARS, LIST_SHIFT, LIST_DRIFT, LIST_LENGTH = 3, 8, 70, 18.0, 8.0, 45


def key_value_runs(blocks: DataFrame) -> DataFrame:
    """Key/value tables: (doc, page, run_no, row_no, block_seq, label, value).

    From a start, rows follow while they split into label and value and stay under the start;
    three rows or more make a table, else the next block is the next start.
    """
    by_page = W.partitionBy(*PAGE).orderBy(F.asc_nulls_last("y"), F.desc_nulls_last("x"), "block_seq")
    rows = blocks.select(*KEY, "x", "y", "text").repartition("doc_id").withColumn("place", F.row_number().over(by_page)).withColumn("kv", T.key_value(F.col("text")))
    # blocks that don't split part runs, as the places between them show
    rows = rows.filter("kv is not null").select(*KEY, "place", F.col("x").cast("double").alias("x"), F.col("kv.label").alias("label"), F.col("kv.value").alias("value"))

    def run(document: list) -> list[tuple]:
        out = []
        for page, part in groupby(document, key=attrgetter("page_num")):
            items = list(part)
            start = runs = 0
            while start < len(items):
                end = start
                while end < len(items) and items[end].place - items[start].place == end - start and abs(items[end].x - items[start].x) <= KV_SHIFT:
                    end += 1
                if end - start < KV_ROWS:
                    start += 1
                    continue
                runs += 1
                out += [(page, runs, i + 1, b.block_seq, b.label, b.value) for i, b in enumerate(items[start:end])]
                start = end
        return out

    return by_document(rows, ["page_num", "place"], run, "doc_id long, page_num long, run_no int, row_no int, block_seq int, label string, value string", dealt=True)


def list_candidates(blocks: DataFrame) -> DataFrame:
    """Blocks with place in reading order, heading level, and whether they may be unmarked list items."""
    t = T.strip(F.col("text"))
    rows = blocks.join(reading_order(blocks).drop("line"), KEY).join(headings(blocks), KEY)
    brief = F.col("level").isNull() & (t != "") & (F.length(t) <= LIST_CHARS) & (T.n_words(t) <= LIST_WORDS)  # before what takes longer
    may = brief & ~T.is_list_item(t) & ~T.is_section(t) & T.clause_level(t).isNull() & ~T.is_key_value(t)
    return rows.withColumn("candidate", may).withColumn("n_chars", F.length(t))


def implied_lists(candidates: DataFrame) -> DataFrame:
    """Runs of unmarked list items: (doc, page, block_seq, list_no, item_no).

    Items follow while they are candidates on one page, under the first, with gaps close to
    the median of the gaps so far and lengths close to the first one's.  Only candidates are
    walked; their places show what lies between.
    """

    def run(items: list) -> list[tuple]:
        out, start, lists = [], 0, 0
        while start < len(items):
            end, seen = start, []
            first = items[start]
            while end < len(items) and items[end].page_num == first.page_num and items[end].place - first.place == end - start:
                b = items[end]
                if end > start:
                    last = items[end - 1]
                    gap = b.y - (last.y + last.height)
                    middle = median(seen) if seen else gap
                    if abs(b.x - first.x) > LIST_SHIFT or not -2.0 <= gap <= max(28.0, 2.6 * last.height) or abs(gap - middle) > LIST_DRIFT or abs(b.n_chars - first.n_chars) > LIST_LENGTH:
                        break
                    insort(seen, gap)
                end += 1
            if end - start < LIST_ITEMS:
                start += 1
                continue
            lists += 1
            out += [(b.page_num, b.block_seq, lists, i + 1) for i, b in enumerate(items[start:end])]
            start = end
        return out

    rows = candidates.select(*KEY, "place", "candidate", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "height")), "n_chars")
    rows = rows.repartition("doc_id").withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("place"))).filter("candidate").drop("candidate")
    return by_document(rows, ["place"], run, "doc_id long, page_num long, block_seq int, list_no int, item_no int", dealt=True)


def median(ordered: list[float]) -> float:
    """Of numbers in order."""
    half = len(ordered) // 2
    return ordered[half] if len(ordered) % 2 else (ordered[half - 1] + ordered[half]) / 2
