"""Operators on text lines: running lines, line rules, heading scores, quality of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import quality, text as T


def edge_lines(lines: DataFrame, n: int = 3) -> DataFrame:
    """The first n and last n lines of each page."""
    page = W.partitionBy("doc_id", "page_num")
    up, down = F.row_number().over(page.orderBy("line_index")), F.row_number().over(page.orderBy(F.desc("line_index")))
    return lines.withColumn("__up", up).withColumn("__down", down).filter((F.col("__up") <= n) | (F.col("__down") <= n)).drop("__up", "__down")


def repeated_lines(lines: DataFrame, ratio: float = 0.5, group: str = "doc_id", least: int = 2) -> DataFrame:
    """Masked lines that stand at the top or bottom of enough pages of their group.

    Pages are (doc_id, page_num); group is the column over which pages are counted.
    """
    edges = edge_lines(lines).select(group, "doc_id", "page_num", T.repeat_key(F.col("text")).alias("key"))
    edges = edges.filter(F.length("key").between(4, 120)).distinct()
    pages = lines.select(group, "doc_id", "page_num").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("pages"))
    counts = edges.groupBy(group, "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(pages, group).filter(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * ratio))).select(group, "key", "n", "pages")


def without_repeated(lines: DataFrame, ratio: float = 0.5, group: str = "doc_id", least: int = 2) -> DataFrame:
    """Lines that aren't running lines; only the first and last three of a page can be."""
    found = repeated_lines(lines, ratio, group, least).select(group, "key")
    keyed = edge_lines(lines).withColumn("key", T.repeat_key(F.col("text"))).join(found, [group, "key"], "left_semi")
    return lines.join(keyed.select("doc_id", "page_num", "line_index"), ["doc_id", "page_num", "line_index"], "left_anti")


def line_rules(lines: DataFrame) -> DataFrame:
    """What each line is by the rules of both profiles."""
    t = F.col("text")
    return lines.select(
        "doc_id", "page_num", "line_index", T.is_list_item(t).alias("list_item"), T.is_section(t).alias("section"), T.clause_level(t).alias("clause_level"), T.is_key_value(t).alias("key_value"),
        T.is_signature(t).alias("signature"), T.is_hebrew(t).alias("hebrew"), T.strip_mark(t).alias("unmarked"), F.size(T.tokens(t)).alias("n_tokens"), T.edge_is_numbered(t).alias("edge_numbered"),
        T.edge_depth(t).alias("edge_depth"), T.edge_is_key_value(t).alias("edge_key_value"), T.edge_is_row(t).alias("edge_row"), T.edge_is_signature(t).alias("edge_signature"), T.repeat_key(t).alias("repeat_key"),
    )


def heading_scores(lines: DataFrame) -> DataFrame:
    """The additive heading score of the edge profile, and the level for lines over the threshold.

    lines: doc_id, page_num, line_index, text, width, font_size, gap_before and optionally bold.
    """
    return with_scores(lines).select("doc_id", "page_num", "line_index", "score", "level")


def with_scores(lines: DataFrame) -> DataFrame:
    """lines with score and level, by windows over one exchange, and what these are made from: clean,
    found_cells, text_row, numbered, key_value, body (the page's median size) and up (place on the page)."""
    return placed(told(lines)).drop("__n", "__length", "__points")


#: Lines of more characters get no points for their width.
NARROW = 80


def told(lines: DataFrame, clean: bool = False) -> DataFrame:
    """lines with what each is by its text: clean, found_cells, text_row, numbered, key_value, and
    what placed() asks for: __length, __n (of the clean text) and __points, the text's own part of
    the score, null where a line cannot be a heading.

    Tests of a text stand behind those of its length.  clean: texts are clean already.
    """
    if "bold" not in lines.columns:
        lines = lines.withColumn("bold", F.lit(False))
    text, t, n = F.col("text"), F.col("clean"), F.col("__n")
    rows = lines.withColumn("clean", text if clean else T.cleaned(text))
    rows = rows.withColumns({"__n": F.length(t), "__length": F.length(text), "found_cells": T.edge_cells(text, t), "numbered": T.edge_is_numbered(text), "key_value": T.edge_is_key_value(text, t)})
    rows = rows.withColumn("text_row", T.edge_is_row(text, F.col("found_cells")))
    points = _add(1, n <= 70) + _add(1, ~t.rlike(r"[.!?]$")) + _add(1, t.rlike(r"^[0-9]+(?:\.[0-9]+){0,2}" + T.WS + "+" + T.NWS)) + _add(0.5, t.rlike(r"[:\x{FF1A}]$"))
    out = (n == 0) | (n > 95) | F.col("numbered") | F.col("key_value") | F.col("text_row")
    return rows.withColumn("__points", F.when(out, F.lit(None).cast("double")).otherwise(points))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of told() with up, body, score and level.  No text is looked at: neighbours are by their
    lengths, so texts need not be there."""
    by_line = W.partitionBy("doc_id", "page_num").orderBy("line_index")
    page = W.partitionBy("doc_id", "page_num")
    n, blank = F.col("__n"), F.coalesce(F.col("__n") == 0, F.lit(True))
    rows = rows.withColumns({"up": F.row_number().over(by_line), "__first": F.coalesce(F.lag(blank).over(by_line), F.lit(True)), "__last": F.coalesce(F.lead(blank).over(by_line), F.lit(True)), "__next": F.lead("__length").over(by_line), "__next_gap": F.lead("gap_before").over(by_line)})
    rows = rows.withColumn("body", F.percentile("font_size", 0.5).over(page))
    score = (
        F.col("__points")
        + _add(1, F.col("line_index") <= 4)
        + _add(1, F.col("__first"))
        + _add(1, F.col("__last") | (F.col("__next") > n + 20))
        + _add(2, F.col("font_size") >= F.col("body") + 1.5)
        + _add(1, F.col("font_size") >= F.col("body") + 3)
        + _add(1.5, F.col("bold"))
        + _add(1.5, (F.col("gap_before") > 0) & (F.col("gap_before") >= F.col("body") * 1.35))
        + _add(0.75, F.col("__next_gap") >= F.col("body") * 1.05)
        + _add(0.75, (F.col("width") > 0) & (F.col("width") < 430) & (n <= NARROW))
    )
    threshold = F.when((F.col("font_size") > F.col("body")) | F.col("bold"), 3.5).otherwise(4.25)
    level = F.when((F.col("line_index") <= 4) | (F.col("font_size") >= F.col("body") + 4), 1).when((F.col("font_size") >= F.col("body") + 2) | F.col("bold"), 2).otherwise(3)
    rows = rows.withColumn("score", F.coalesce(score, F.lit(0.0)))
    return rows.withColumn("level", F.when(F.col("score") >= threshold, level)).drop("__first", "__last", "__next", "__next_gap")


def _add(points: float, test: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), float(points)).otherwise(0.0)


def document_quality(documents: DataFrame) -> DataFrame:
    """Recognition quality of each document's text (both profiles' measures)."""
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    rows, t, ws = rows.withColumn("ws", T.words(F.col("t"))), F.col("t"), F.col("ws")  # words are split once
    return rows.select(
        "doc_id", F.round(quality.bad_char_ratio(t), 9).alias("bad_char_ratio"), F.round(quality.gibberish_ratio(t, ws), 9).alias("gibberish_ratio"), F.length(T.strip(t)).cast("double").alias("avg_chars_per_page"),
        F.round(quality.foreign_ratio(t), 9).alias("foreign_ratio"), F.round(quality.edge_bad_ratio(t), 9).alias("edge_bad_ratio"), F.round(quality.edge_gibberish_ratio(t, ws), 9).alias("edge_gibberish_ratio"),
    )


def quality_verdict(documents: DataFrame, confidence: Column | float = 1.0) -> DataFrame:
    """Whether each document passes the recognition gate, and why not (edge profile's reasons)."""
    q = document_quality(documents)
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    ok = quality.quality_ok(c, F.col("bad_char_ratio"), F.col("gibberish_ratio"), F.col("avg_chars_per_page"))
    why = F.array_compact(F.array(F.when(c < quality.MIN_CONFIDENCE, "confidence"), F.when(F.col("edge_bad_ratio") > quality.MAX_BAD, "bad_chars"), F.when(F.col("edge_gibberish_ratio") > quality.MAX_GIBBERISH, "gibberish"), F.when(F.col("avg_chars_per_page") < quality.MIN_CHARS_PER_PAGE, "short")))
    return q.select("doc_id", ok.alias("passed"), (F.size(why) == 0).alias("edge_passed"), F.array_join(why, ",").alias("reasons"))


def ocr_findings(pages: DataFrame) -> DataFrame:
    """Findings on recognised pages: (doc_id, page_num, text, confidence 0 to 100 or null)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = pages.groupBy("doc_id").agg(
        F.sum(T.count(t, quality.FOREIGN)).alias("foreign"), F.sum(F.length(t)).alias("chars"), F.count(F.lit(1)).alias("pages"), F.count_if(T.strip(t) == "").alias("empty"),
        F.count("confidence").alias("measured"), F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))).alias("mean"),
    )
    ratio = F.when(F.col("chars") > 0, F.col("foreign") / F.col("chars")).otherwise(0.0)
    empty, mean = F.col("empty") / F.col("pages"), F.when(F.col("measured") > 0, F.coalesce("mean", F.lit(100.0)))
    found = lambda test, name, severity, criterion: F.when(test, F.struct(F.lit(name).alias("test_id"), F.lit(severity).alias("severity"), F.lit(criterion).alias("criterion")))
    rules = F.array_compact(F.array(
        found(ratio >= 0.30, "OCR_GIBBERISH", "hard_fail", "WCAG 1.1.1"), found((ratio >= 0.15) & (ratio < 0.30), "OCR_POOR_QUALITY", "needs_review", "WCAG 1.1.1"),
        found(empty >= 0.5, "OCR_EMPTY_PAGES", "hard_fail", "WCAG 1.4.5"), found((empty > 0) & (empty < 0.5), "OCR_PARTIAL_EMPTY", "warning", "WCAG 1.4.5"),
        found(mean < 40, "OCR_LOW_CONFIDENCE", "hard_fail", "WCAG 1.1.1"), found((mean >= 40) & (mean < 60), "OCR_MEDIUM_CONFIDENCE", "needs_review", "WCAG 1.1.1"),
    ))
    return d.select("doc_id", F.explode(rules).alias("f")).select("doc_id", "f.*")


def digital_or_scanned(pages: DataFrame) -> DataFrame:
    """Digital if pages of more than ten characters hold more than fifty together."""
    n = F.length(T.strip(F.coalesce(F.col("text"), F.lit(""))))
    return pages.groupBy("doc_id").agg(F.sum(F.when(n > 10, n).otherwise(0)).alias("chars")).select("doc_id", F.when(F.col("chars") > 50, "digital").otherwise("scanned").alias("kind"))
