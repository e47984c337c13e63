"""Operators on element rows: trees, lists, classification, findings, scores, export checks.

elements: doc_id, ord (document order), elem_type, text; optionally page_num, mcid, table_id
(the table an element lies in), parent_ord.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import quality, text as T

# fixed values: structure types
HEADINGS = ("H1", "H2", "H3", "H4", "H5", "H6")
GROUPING = ("Artifact", "Document", "Sect", "Div", "Part", "Art")
INLINE = ("Span", "Link")
LEAVES = (*HEADINGS, "P", "TD", "TH", "LBody", "Caption", "Figure")
# fixed values: document types and weights
TYPES = ("protocol", "legal", "workplan", "form", "newsletter")
WEIGHTS = {"has_struct_tree": 25, "has_text_layer": 35, "has_lang": 20, "has_title": 10, "has_pdfua_xmp": 5, "has_markinfo": 5}
MAIN_LANGUAGES = ("he-il", "he", "iw")
HARD_CAP, REVIEW_CAP = 45, 69

# fixed values: keywords of document types; the bonuses look for the phrases in the first page
KEYWORDS = {
    "protocol": ("פרוטוקול", "נוכחים", "חסרים", "משתתפים", "החלטה", "הצבעה", "בעד", "נגד", "נמנע", "ועדה", "ישיבה", 'יו"ר'),
    "legal": ("תקנות", "חוק", "סעיף", "פרק", "אגרה", "תוספת", "הגדרות", "ביטול", "תחילה", "תקנה", "צו", "קנס", "פרסום", "חייב", "רשות", "עירייה"),
    "workplan": ("תקציב", "תוכנית", 'דו"ח', "רבעון", "יעד", "מדד", "ביצוע", "תחזית", "אחראי", "משימה", "פרויקט"),
    "form": ("שם", "תאריך", "זהות", "חתימה", "כתובת", "טלפון", "בקשה", "טופס", "פקס"),
}
BONUSES = {
    "protocol": ((4, ("פרוטוקול",)), (2, ("נוכחים",)), (2, ("על סדר היום",)), (1, ("הצבעה", "החלטה"))),
    "legal": ((3, ("תקנות", "חוק")), (2, ("אגרה", "תוספת"))),
    "form": ((3, ("טופס",)), (2, ("חתימה",))),
}
PREFIX = 800


def _missing(df: DataFrame, **columns: str) -> DataFrame:
    """df with null columns added where they aren't there."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def _level(column: str = "elem_type") -> Column:
    return F.when(F.col(column).isin(*HEADINGS), F.substring(column, 2, 1).cast("int"))


# --- classification


def type_scores(texts: DataFrame, extra: DataFrame | None = None, keywords: dict = KEYWORDS, bonuses: dict = BONUSES) -> DataFrame:
    """Scores of document types and the best: (doc_id, one column per type, doc_type).

    texts: doc_id, page_num, seq, text (blocks or lines).  extra: doc_id with optional columns
    table_pages (pages with three column bands) and newsletter (its score), and blocks, pages
    for the test whether a document is scanned.  Ties go to the type named first; under two
    points a document is general.
    """
    tokens = F.array_distinct(F.flatten(F.collect_list(T.tokens(F.col("text")))))
    # clauses count by block; the first page's text is cut after PREFIX characters
    first = F.min("page_num").over(W.partitionBy("doc_id"))
    rows = texts.withColumn("__first", F.col("page_num") == first)
    page = F.sort_array(F.collect_list(F.when(F.col("__first"), F.struct("seq", "text"))))
    d = rows.groupBy("doc_id").agg(tokens.alias("tokens"), page.alias("page"), F.count(T.clause_level(F.col("text"))).alias("clauses"), F.count(F.lit(1)).alias("blocks"), F.countDistinct("page_num").alias("pages"))
    d = d.withColumn("prefix", F.lower(F.left(F.array_join("page.text", " "), F.lit(PREFIX))))
    d = _missing(d.join(extra, "doc_id", "left") if extra is not None else d, table_pages="int", newsletter="double")

    def points(kind: str) -> Column:
        score = F.size(F.array_intersect("tokens", F.array(*[F.lit(w) for w in keywords[kind]]))).cast("double") if keywords.get(kind) else F.lit(0.0)
        for n, phrases in bonuses.get(kind, ()):
            test = F.lit(False)
            for phrase in phrases:
                test = test | F.contains("prefix", F.lit(phrase))
            score = score + F.when(test, float(n)).otherwise(0.0)
        return score

    steps = lambda c, *at: F.coalesce(F.when(c >= at[0][0], at[0][1]).when(c >= at[1][0], at[1][1]) if len(at) == 2 else F.when(c >= at[0][0], at[0][1]).when(c >= at[1][0], at[1][1]).when(c >= at[2][0], at[2][1]), F.lit(0.0))
    d = d.select(
        "doc_id", "blocks", "pages",
        points("protocol").alias("protocol"), (points("legal") + steps(F.col("clauses"), (5, 4.0), (2, 2.0), (1, 1.0))).alias("legal"),
        (points("workplan") + steps(F.col("table_pages"), (3, 3.0), (1, 1.0))).alias("workplan"), points("form").alias("form"), F.coalesce("newsletter", F.lit(0.0)).alias("newsletter"),
    )
    best = F.array_max(F.array(*[F.struct(F.col(t).alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("type")) for i, t in enumerate(TYPES)]))
    kind = F.when(F.col("blocks") < F.greatest(F.lit(4.0), F.col("pages") * 1.5), "scanned").when(best["score"] < 2, "general").otherwise(best["type"])
    return d.select("doc_id", *TYPES, kind.alias("doc_type"))


def type_warnings(features: DataFrame) -> DataFrame:
    """Warnings by document type: (doc_id, warning); features has doc_type and has_* columns."""
    t, h, lists, tables = F.col("doc_type"), F.col("has_heading"), F.col("has_list"), F.col("has_table")
    w = F.array_compact(F.array(
        F.when(t.isin("protocol", "legal", "newsletter") & ~h, F.concat(t, F.lit("_no_headings"))), F.when(t.isin("protocol", "legal") & ~lists, F.concat(t, F.lit("_no_lists"))),
        F.when((t == "workplan") & ~tables, "workplan_no_tables"), F.when(t == "form", "form_fields_untagged"),
    ))
    return features.select("doc_id", F.explode(w).alias("warning"))


# --- trees and lists


def list_runs(elements: DataFrame, item: str = "LI") -> DataFrame:
    """Runs of list items that nothing parts: (doc_id, run_no, first_ord, n)."""
    by_ord = W.partitionBy("doc_id").orderBy("ord")
    rows = elements.withColumn("__other", (F.col("elem_type") != item).cast("int"))
    rows = rows.withColumn("__island", F.sum("__other").over(by_ord.rowsBetween(W.unboundedPreceding, 0))).filter("__other = 0")
    runs = rows.groupBy("doc_id", "__island").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n"))
    return runs.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("first_ord")).alias("run_no"), "first_ord", "n")


def name_lists(elements: DataFrame, belongs=T.is_hebrew, most_words: int = 10, least: int = 2) -> DataFrame:
    """Short paragraphs right behind a heading that make a list: (doc_id, list_no, ord)."""
    by_ord = W.partitionBy("doc_id").orderBy("ord")
    ok = (F.col("elem_type") == "P") & (T.n_words(F.col("text")) <= most_words) & belongs(F.col("text"))
    rows = elements.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    rows = rows.withColumn("__island", F.sum((~F.col("__ok")).cast("int")).over(by_ord.rowsBetween(W.unboundedPreceding, 0)))
    opener = F.max(F.when(~F.col("__ok"), F.col("elem_type"))).over(W.partitionBy("doc_id", "__island"))
    rows = rows.withColumn("__opener", opener).filter(F.col("__ok") & F.col("__opener").isin("H1", "H2", "H3"))
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("doc_id", "__island"))).filter(F.col("__n") >= least)
    return rows.select("doc_id", F.dense_rank().over(W.partitionBy("doc_id").orderBy("__island")).alias("list_no"), "ord")


def clamped_headings(elements: DataFrame) -> DataFrame:
    """Heading levels that never skip: the first is 1, others at most one deeper than before, 3 at most."""
    d = elements.filter(F.col("elem_type").isin("H1", "H2", "H3")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", _level().alias("level")))).alias("h"))
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("levels"))

    def step(s: Column, h: Column) -> Column:
        level = F.least(h["level"], s["last"] + 1, F.lit(3))
        return F.struct(level.alias("last"), F.concat(s["levels"], F.array(level)).alias("levels"))

    levels = F.aggregate("h", start, step, lambda s: s["levels"])
    rows = d.select("doc_id", F.explode(F.arrays_zip(F.col("h"), levels.alias("l"))).alias("e"))
    return rows.select("doc_id", F.col("e.h.ord").alias("ord"), F.col("e.h.level").alias("level"), F.col("e.l").alias("clamped"))


def bookmarks(elements: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Outline entries from H1 to H3 with links to their neighbours.

    Documents without such headings get entries from lines (doc_id, ord, text: the first line
    of each page), cut after 60 characters instead of 80.
    """
    rows = elements.filter(F.col("elem_type").isin("H1", "H2", "H3")).select("doc_id", "ord", _level().alias("level"), F.left(T.strip(F.col("text")), F.lit(80)).alias("title"))
    if lines is not None:
        others = lines.join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
        rows = rows.unionByName(others.select("doc_id", "ord", F.lit(1).alias("level"), F.left(T.strip(F.col("text")), F.lit(60)).alias("title")))
    by_ord = W.partitionBy("doc_id").orderBy("ord")
    return rows.select("doc_id", "ord", "level", "title", F.lag("ord").over(by_ord).alias("prev_ord"), F.lead("ord").over(by_ord).alias("next_ord"))


def parent_tree(elements: DataFrame) -> DataFrame:
    """Marks numbered in document order per page, with their owners: (doc_id, page_num, mcid, owner)."""
    rows = _missing(elements, page_num="int").withColumn("page_num", F.coalesce("page_num", F.lit(1))).filter(F.col("elem_type").isin(*LEAVES))
    return rows.select("doc_id", "page_num", (F.row_number().over(W.partitionBy("doc_id", "page_num").orderBy("ord")) - 1).alias("mcid"), F.col("ord").alias("owner"))


def owners(marks: DataFrame, claims: DataFrame) -> DataFrame:
    """The element that owns each mark: the first that claims it, else the page's section."""
    first = claims.groupBy("doc_id", "page_num", "mcid").agg(F.min("ord").alias("owner"))
    return marks.select("doc_id", "page_num", "mcid").join(first, ["doc_id", "page_num", "mcid"], "left").select("doc_id", "page_num", "mcid", "owner", F.col("owner").isNull().alias("by_section"))


def unclaimed(marks: DataFrame, claims: DataFrame) -> DataFrame:
    """Marks with text that no element claims, as paragraphs."""
    rest = marks.filter(T.strip(F.col("text")) != "").join(claims, ["doc_id", "page_num", "mcid"], "left_anti")
    return rest.select("doc_id", "page_num", "mcid", F.lit("P").alias("elem_type"), T.strip(F.col("text")).alias("text"))


def nfkc(column: Column) -> Column:
    """Compatibility normal form, which has no built-in function."""

    @F.pandas_udf("string")
    def normalised(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return normalised(column)


def mark_scores(leaves: DataFrame, marks: DataFrame) -> DataFrame:
    """How well leaves and marks of a page match: (doc_id, page_num, ord, mcid, score).

    The share of distinct characters, spaces aside, that the two have in common, and half a
    point more if one contains the other.
    """
    plain = lambda c: F.replace(T.clean(nfkc(F.coalesce(F.col(c), F.lit("")))), F.lit(" "))
    a = leaves.select("doc_id", "page_num", "ord", plain("text").alias("a"))
    b = marks.select("doc_id", "page_num", "mcid", plain("text").alias("b"))
    chars = lambda c: F.array_distinct(F.split(c, ""))
    pairs = a.filter("a <> ''").withColumn("as", chars("a")).join(b.filter("b <> ''").withColumn("bs", chars("b")), ["doc_id", "page_num"])
    share = F.size(F.array_intersect("as", "bs")) / F.greatest(F.size("as"), F.size("bs"))
    bonus = F.when(F.contains("a", F.col("b")) | F.contains("b", F.col("a")), 0.5).otherwise(0.0)
    return pairs.select("doc_id", "page_num", "ord", "mcid", (share + bonus).alias("score"))


def assign_marks(scores: DataFrame, leaves: DataFrame, marks: DataFrame, least: float = 0.3) -> DataFrame:
    """One mark per leaf: in order, each leaf takes the best mark that is left and scores over
    least (the lowest of equals); leaves without one then take the marks that are left in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for page, part in pdf.groupby("page_num", sort=True):
            taken: dict[int, int] = {}
            for leaf, options in part[part["score"] > least].sort_values(["ord", "score", "mcid"], ascending=[True, False, True]).groupby("ord", sort=True):
                free = options[~options["mcid"].isin(set(taken.values()))]
                if len(free):
                    taken[leaf] = int(free["mcid"].iloc[0])
            left = [m for m in sorted(part["mcid"].dropna().astype(int).unique()) if m not in set(taken.values())]
            by_text = set(taken)
            for leaf in sorted(part["ord"].dropna().astype(int).unique()):
                if leaf not in taken and left:
                    taken[leaf] = left.pop(0)
            out += [(pdf["doc_id"].iloc[0], page, leaf, mark, leaf in by_text) for leaf, mark in taken.items()]
        return pd.DataFrame(out, columns=["doc_id", "page_num", "ord", "mcid", "by_text"])

    none = F.lit(None)
    rows = scores.select("doc_id", "page_num", "ord", "mcid", "score")
    rows = rows.unionByName(leaves.select("doc_id", "page_num", "ord", none.cast("int").alias("mcid"), none.cast("double").alias("score")))
    rows = rows.unionByName(marks.select("doc_id", "page_num", none.cast("int").alias("ord"), "mcid", none.cast("double").alias("score")))
    return rows.groupBy("doc_id").applyInPandas(run, "doc_id long, page_num int, ord int, mcid int, by_text boolean")


def merge_suggestions(elements: DataFrame, suggested: DataFrame) -> DataFrame:
    """Per page the detected elements if they have a heading, table or list or nothing is
    suggested, else the suggested ones: (doc_id, page_num, ord, elem_type, text, origin)."""
    rich = F.count_if(F.col("elem_type").isin("H1", "H2", "H3", "Table", "L")) > 0
    pages = elements.groupBy("doc_id", "page_num").agg(rich.alias("rich"))
    other = suggested.groupBy("doc_id", "page_num").agg(F.lit(True).alias("offered"))
    chosen = pages.join(other, ["doc_id", "page_num"], "full_outer").select("doc_id", "page_num", (F.coalesce("rich", F.lit(False)) | F.col("offered").isNull()).alias("own"))
    columns = ["doc_id", "page_num", "ord", "elem_type", "text"]
    own = elements.join(chosen.filter("own"), ["doc_id", "page_num"], "left_semi").select(*columns, F.lit("rules").alias("origin"))
    return own.unionByName(suggested.join(chosen.filter("not own"), ["doc_id", "page_num"], "left_semi").select(*columns, F.lit("suggested").alias("origin")))


def merge_tables(free: DataFrame, tables: DataFrame) -> DataFrame:
    """Top-level elements in final order: a page's tables come behind its other elements.

    free: doc_id, page_num, place, elem_type, text; tables: doc_id, page_num, place.
    """
    rows = free.select("doc_id", "page_num", F.lit(0).alias("late"), "place", "elem_type", "text").unionByName(tables.select("doc_id", "page_num", F.lit(1).alias("late"), "place", F.lit("Table").alias("elem_type"), F.lit("").alias("text")))
    return rows.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("page_num", "late", "place")).alias("ord"), "page_num", "elem_type", "text")


def structure_json(elements: DataFrame) -> DataFrame:
    """Top-level elements of each document as one JSON text, in order."""
    node = F.struct("ord", F.struct(F.col("elem_type").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(_missing_column(elements, "page_num"), F.lit(1)).alias("page")).alias("node"))
    return elements.groupBy("doc_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(node)), lambda n: n["node"])).alias("structure_json"))


def _missing_column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("int")


NODE = "array<struct<type: string, text: string, page: int>>"


def from_json(stored: DataFrame) -> DataFrame:
    """Elements from stored JSON; the inverse of structure_json."""
    rows = stored.select("doc_id", F.posexplode(F.from_json("structure_json", NODE)).alias("ord", "n"))
    return rows.select("doc_id", "ord", F.col("n.type").alias("elem_type"), F.col("n.text").alias("text"), F.col("n.page").alias("page_num"))


def element_counts(elements: DataFrame) -> DataFrame:
    """Elements, headings, lists, tables, and the share of semantic ones with the fallback verdict."""
    n = F.count(F.lit(1))
    of = lambda *types: F.count_if(F.col("elem_type").isin(*types))
    ratio = of("H1", "H2", "H3", "Table", "L") / n
    return elements.groupBy("doc_id").agg(n.alias("n"), of(*HEADINGS).alias("headings"), of("L").alias("lists"), of("Table").alias("tables"), F.round(ratio, 9).alias("semantic_ratio"), ((ratio >= 0.08) | (n < 8)).alias("ratio_ok"))


# --- findings and scores


def features(elements: DataFrame, facts: DataFrame) -> DataFrame:
    """One row of what the rules ask for per document of facts (doc_id, lang, title; optionally
    doc_type and *_candidates)."""
    rows = _missing(elements, page_num="int", mcid="int", table_id="int", parent_ord="int")
    by_ord = W.partitionBy("doc_id").orderBy("ord")
    rows = rows.withColumn("__level", _level())
    rows = rows.withColumn("__last", F.last("__level", ignorenulls=True).over(by_ord.rowsBetween(W.unboundedPreceding, -1))).withColumn("__page", F.lag(F.when(F.col("page_num") > 0, F.col("page_num"))).over(by_ord))
    top = F.col("parent_ord").isNull()
    kind, has_text = F.col("elem_type"), F.coalesce(T.strip(F.col("text")) != "", F.lit(False))
    real = ~kind.isin(*GROUPING, *INLINE)
    has = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    d = rows.groupBy("doc_id").agg(
        F.count_if(real).alias("n_real"), has(real & (kind != "P")).alias("has_other"), has(kind.isin(*HEADINGS)).alias("has_heading"), has(kind == "H2").alias("has_h2"), has(kind == "L").alias("has_list"),
        has(kind == "Table").alias("has_table"), has(has_text).alias("has_text"), F.min_by("__level", F.when(F.col("__level").isNotNull(), F.col("ord"))).alias("first_level"),
        has(F.col("__level") > F.col("__last") + 1).alias("skips"), has((kind == "LI") & ~has_text & ~F.coalesce(_missing_flag(rows, "has_body"), F.lit(False))).alias("empty_item"),
        F.count_if(top & (F.col("page_num") > 0) & (F.col("page_num") < F.col("__page") - 1)).alias("jumps"), F.count_if(kind.isin(*LEAVES) & F.col("mcid").isNull() & has_text).alias("unbound"),
        has(kind == "LBody").alias("has_body_elem"), has(kind == "TH").alias("has_th"),
    )
    t = rows.filter(F.col("elem_type") == "Table").select("doc_id", F.col("ord").alias("table_id"))
    inside = rows.filter(F.col("table_id").isNotNull()).groupBy("doc_id", "table_id").agg(has(F.col("elem_type").isin("TD", "TH")).alias("cells"), has(F.col("elem_type") == "TH").alias("th"))
    t = t.join(inside, ["doc_id", "table_id"], "left").groupBy("doc_id").agg(has(~F.coalesce("cells", F.lit(False))).alias("table_no_cells"), has(~F.coalesce("th", F.lit(False))).alias("table_no_th"))
    flags = ("has_other", "has_heading", "has_h2", "has_list", "has_table", "has_text", "skips", "empty_item", "table_no_cells", "table_no_th", "has_body_elem", "has_th")
    facts = _missing(facts, doc_type="string", heading_candidates="int", list_candidates="int", table_candidates="int", kv_candidates="int")
    out = facts.join(d, "doc_id", "left").join(t, "doc_id", "left")
    numbers = ("n_real", "jumps", "unbound", "heading_candidates", "list_candidates", "table_candidates", "kv_candidates")
    return out.fillna(False, list(flags)).fillna(0, list(numbers))


def _missing_flag(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(False)


#: The catalog below holds fixed values: names, severities, criteria and thresholds.
def rules() -> list[tuple[str, str, str, Column]]:
    """The catalog over features: (test_id, severity, criterion, condition), in reporting order."""
    c = F.col
    kind = c("doc_type")
    return [
        ("LANG_MISSING", "hard_fail", "WCAG 3.1.1", F.coalesce(T.strip(c("lang")) == "", F.lit(True))),
        ("PARAGRAPH_ONLY", "hard_fail", "WCAG 1.3.1", (c("n_real") >= 5) & ~c("has_other")),
        ("HEADINGS_LOST", "hard_fail", "WCAG 1.3.1", (c("heading_candidates") > 0) & ~c("has_heading")),
        ("LISTS_LOST", "hard_fail", "WCAG 1.3.1", (c("list_candidates") > 0) & ~c("has_list")),
        ("TABLES_LOST", "hard_fail", "WCAG 1.3.1", (c("table_candidates") > 0) & ~c("has_table")),
        ("FIRST_HEADING_NOT_H1", "warning", "PDF/UA §7.5", c("first_level") > 1),
        ("HEADING_LEVEL_SKIP", "hard_fail", "PDF/UA §7.5", c("skips")),
        ("HEADING_CANDIDATES_LOST", "hard_fail", "WCAG 1.3.1", (c("heading_candidates") > 0) & ~c("has_heading")),
        ("LIST_NOT_EXPORTED", "hard_fail", "WCAG 1.3.1", (c("list_candidates") > 0) & ~c("has_list")),
        ("LI_EMPTY", "warning", "WCAG 1.3.1", c("empty_item")),
        ("TABLE_NOT_EXPORTED", "hard_fail", "WCAG 1.3.1", (c("table_candidates") > 0) & ~c("has_table")),
        ("TABLE_NO_CELLS", "hard_fail", "IS 5568 §7.2", c("table_no_cells")),
        ("TABLE_NO_TH", "warning", "IS 5568 §7.2", c("table_no_th")),
        ("KV_FLAT_PARAGRAPHS", "needs_review", "WCAG 1.3.1", (c("kv_candidates") >= 3) & ~c("has_table") & ~c("has_list")),
        ("MCID_UNBOUND", "warning", "PDF/UA §7.3", c("unbound") > 5),
        ("READING_ORDER_BROKEN", "hard_fail", "WCAG 1.3.2", c("jumps") > 3),
        ("READING_ORDER_SUSPECT", "warning", "WCAG 1.3.2", (c("jumps") > 0) & (c("jumps") <= 3)),
        ("PROTOCOL_NO_HEADING", "hard_fail", "WCAG 1.3.1", (kind == "protocol") & ~c("has_heading")),
        ("PROTOCOL_NO_H2", "warning", "WCAG 1.3.1", (kind == "protocol") & c("has_heading") & ~c("has_h2")),
        ("PROTOCOL_NO_LIST", "hard_fail", "WCAG 1.3.1", (kind == "protocol") & ~c("has_list")),
        ("LEGAL_NO_HEADING", "hard_fail", "WCAG 1.3.1", (kind == "legal") & ~c("has_heading")),
        ("WORKPLAN_NO_TABLE", "hard_fail", "WCAG 1.3.1", (kind == "workplan") & ~c("has_table")),
        ("NEWSLETTER_NO_HEADING", "warning", "WCAG 1.3.1", (kind == "newsletter") & ~c("has_heading")),
        ("FORM_FIELDS_UNTAGGED", "needs_review", "WCAG 1.3.1", kind == "form"),
    ]


def findings(features: DataFrame) -> DataFrame:
    """(doc_id, rule_no, test_id, severity, criterion) of every rule that a document breaks."""
    broken = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(i).alias("rule_no"), F.lit(name).alias("test_id"), F.lit(severity).alias("severity"), F.lit(criterion).alias("criterion"))) for i, (name, severity, criterion, test) in enumerate(rules())]))
    return features.select("doc_id", F.explode(broken).alias("f")).select("doc_id", "f.*")


def gate(findings: DataFrame) -> DataFrame:
    """Counts by severity and the verdict of each document with findings."""
    of = lambda s: F.count_if(F.col("severity") == s)
    d = findings.groupBy("doc_id").agg(of("hard_fail").alias("hard_fails"), of("needs_review").alias("reviews"), of("warning").alias("warnings"))
    return d.withColumn("passed", F.col("hard_fails") == 0).withColumn("override", F.when(F.col("hard_fails") > 0, "non_compliant").when(F.col("reviews") > 0, "needs_review"))


def compliance_score(features: DataFrame, findings: DataFrame) -> DataFrame:
    """Weighted score before export, capped by hard failures, with components and status."""
    lang = F.coalesce(F.col("lang"), F.lit(""))
    parts = {
        "has_struct_tree": F.lit(WEIGHTS["has_struct_tree"]), "has_text_layer": F.when(F.col("has_text"), WEIGHTS["has_text_layer"]).otherwise(0),
        "has_lang": F.when(F.lower(lang).isin(*MAIN_LANGUAGES), WEIGHTS["has_lang"]).when(lang != "", WEIGHTS["has_lang"] // 2).otherwise(0),
        "has_title": F.when(F.coalesce(T.strip(F.col("title")) != "", F.lit(False)), WEIGHTS["has_title"]).otherwise(0), "has_pdfua_xmp": F.lit(WEIGHTS["has_pdfua_xmp"]), "has_markinfo": F.lit(WEIGHTS["has_markinfo"]),
    }
    total = F.lit(0)
    for part in parts.values():
        total = total + part
    g = gate(findings).select("doc_id", "hard_fails", "override")
    rows = features.join(g, "doc_id", "left").withColumn("score", F.when(F.coalesce("hard_fails", F.lit(0)) > 0, F.least(F.lit(HARD_CAP), total)).otherwise(F.least(F.lit(100), total)))
    return rows.select("doc_id", *[p.alias(n) for n, p in parts.items()], "score", F.coalesce(F.when(F.col("override") == "needs_review", F.lit("needs_review")), quality.status_of(F.col("score"))).alias("status"))


def file_score(facts: DataFrame) -> DataFrame:
    """Score measured after export: the same weights on facts of the file.

    facts: doc_id, has_struct_tree, chars (text in the first three pages), text_operators,
    lang, title, pdfua_part, marked.
    """
    w = WEIGHTS
    text = F.when((F.col("chars") > 20) | ((F.col("chars") <= 5) & F.col("text_operators")), w["has_text_layer"]).when(F.col("chars") > 5, 15).otherwise(0)
    lang = F.lower(F.coalesce("lang", F.lit("")))
    total = (
        F.when(F.col("has_struct_tree"), w["has_struct_tree"]).otherwise(0) + text + F.when(lang.isin(*MAIN_LANGUAGES), w["has_lang"]).when(lang != "", w["has_lang"] // 2).otherwise(0)
        + F.when(F.coalesce(T.strip(F.col("title")) != "", F.lit(False)), w["has_title"]).otherwise(0) + F.when(F.col("pdfua_part") == "1", w["has_pdfua_xmp"]).otherwise(0) + F.when(F.col("marked"), w["has_markinfo"]).otherwise(0)
    )
    return facts.select("doc_id", F.least(F.lit(100), total).alias("score")).withColumn("status", quality.status_of(F.col("score")))


# fixed values: names of the export checks, in order
EXPORT_CHECKS = ("PDF/UA identifier", "Tagged PDF", "Document title", "Display document title", "Language", "Structure tree", "Structure tree children", "Parent tree", "Tab order", "StructParents", "Marked content (BDC/EMC)", "XMP Metadata", "Alt text")


def export_checks(facts: DataFrame) -> DataFrame:
    """(doc_id, check_no, name, passed) from facts: pdfua, marked, title, display_title, lang,
    tree, kids, parent_tree, tabs, struct_parents, marks, xmp, images, figures, alts."""
    c = F.col
    tagged = c("marks") | (c("tree") & c("struct_parents"))
    tests = (
        c("pdfua"), c("marked"), F.coalesce(T.strip(c("title")) != "", F.lit(False)), c("display_title"), F.coalesce(F.length("lang") >= 2, F.lit(False)), c("tree"), c("tree") & c("kids"), c("tree") & c("parent_tree"),
        c("tabs"), c("struct_parents"), tagged, c("xmp"), (c("images") == 0) | ((c("figures") > 0) & (c("alts") >= c("figures"))) | tagged,
    )
    checks = F.array(*[F.struct(F.lit(i + 1).alias("check_no"), F.lit(name).alias("name"), test.alias("passed")) for i, (name, test) in enumerate(zip(EXPORT_CHECKS, tests, strict=True))])
    return facts.select("doc_id", F.explode(checks).alias("k")).select("doc_id", "k.*")


# fixed values: export gate of the layout profile
PROXY_CHECKS = (("PAC_NO_STRUCT", "hard_fail", "tree"), ("PAC_NO_LANG", "hard_fail", "has_lang"), ("PAC_NO_MARKINFO", "hard_fail", "marked"), ("PAC_NO_BDC", "hard_fail", "marks"), ("PAC_NO_PARENT_TREE", "hard_fail", "parent_tree"), ("PAC_NO_TITLE", "warning", "has_title"), ("PAC_NO_PDFUA_XMP", "warning", "pdfua"))


def proxy_gate(facts: DataFrame) -> DataFrame:
    """Findings of the stand-in for an external checker: what each fact's absence gives."""
    rows = facts.withColumn("has_lang", F.coalesce(F.col("lang") != "", F.lit(False))).withColumn("has_title", F.coalesce(T.strip(F.col("title")) != "", F.lit(False)))
    missing = F.array_compact(F.array(*[F.when(~F.col(c), F.struct(F.lit(t).alias("test_id"), F.lit(s).alias("severity"))) for t, s, c in PROXY_CHECKS]))
    return rows.select("doc_id", F.explode(missing).alias("f")).select("doc_id", "f.*")


def pass_rate(checks: DataFrame, alts: Column | None = None, tables: Column | None = None) -> DataFrame:
    """Score from export checks: rounded share of passed ones (halves up), with capped bonuses."""
    d = checks.groupBy("doc_id").agg(F.floor(F.count_if("passed") / F.count(F.lit(1)) * 100 + 0.5).cast("int").alias("score"), F.bool_and("passed").alias("passed"))
    for bonus, test in ((3, alts), (2, tables)):
        if test is not None:
            d = d.withColumn("score", F.when(test, F.least(F.col("score") + bonus, F.lit(100))).otherwise(F.col("score")))
    return d


def wrapped(items: DataFrame, each_row: bool = False) -> DataFrame:
    """Suggested items with runs of li wrapped in a list and runs of tr in a table.

    items: doc_id, page_num, ord, type, text.  each_row: every tr is a table of its own, as
    where suggestions are merged with detected elements.  Gives (doc_id, page_num, ord,
    elem_type, text, n_items) of the top-level elements.
    """
    by_ord = W.partitionBy("doc_id", "page_num").orderBy("ord")
    kind = F.lower("type")
    group = F.when(kind == "li", "L").when(kind == "tr", "Table")
    rows = items.withColumn("g", group)
    joins = F.coalesce(F.col("g") == F.lag("g").over(by_ord), F.lit(False)) & ~((F.col("g") == "Table") & F.lit(each_row))
    rows = rows.withColumn("k", F.sum((~joins).cast("int")).over(by_ord.rowsBetween(W.unboundedPreceding, 0)))
    named = F.coalesce("g", F.when(kind.isin("h1", "h2", "h3", "p"), F.upper("type")).otherwise("P"))
    return rows.groupBy("doc_id", "page_num", "k").agg(F.min("ord").alias("ord"), F.min_by(named, "ord").alias("elem_type"), F.min_by(F.when(F.col("g").isNull(), F.coalesce("text", F.lit(""))).otherwise(""), "ord").alias("text"), F.count("g").alias("n_items")).drop("k")


def inspect(elements: DataFrame, deepest: int = 50) -> DataFrame:
    """What a structure tree holds: (doc_id, elem_type, n, max_depth, warnings).

    elements: doc_id, elem_type, depth, alt.  Warns of alternative text on grouping elements.
    """
    rows = elements.filter(F.col("depth") <= deepest)
    grouped = F.col("elem_type").isin(*GROUPING, "L", "LI", "Table", "TR") & (F.coalesce(F.col("alt"), F.lit("")) != "")
    return rows.groupBy("doc_id", "elem_type").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("max_depth"), F.count_if(grouped).alias("warnings"))


REPLY = "array<struct<type: string, text: string, cells: array<struct<type: string, text: string>>>>"


def suggested_items(replies: DataFrame) -> DataFrame:
    """Items from a model's replies (doc_id, page_num, reply): the JSON array in the text, fences
    and words around it left out; replies without one give no rows."""
    found = F.from_json(F.regexp_extract("reply", r"(?s)\[.*\]", 0), REPLY)
    rows = replies.select("doc_id", "page_num", F.posexplode(found).alias("ord", "i"))
    return rows.select("doc_id", "page_num", "ord", "i.type", "i.text", "i.cells")


def suggested_cells(items: DataFrame) -> DataFrame:
    """Cells of suggested rows: (doc_id, page_num, ord, col_no, role, text)."""
    rows = items.filter(F.lower("type") == "tr").select("doc_id", "page_num", "ord", F.posexplode("cells").alias("c", "cell"))
    return rows.select("doc_id", "page_num", "ord", (F.col("c") + 1).alias("col_no"), F.when(F.lower("cell.type") == "th", "TH").otherwise("TD").alias("role"), F.col("cell.text").alias("text"))
