"""The edge profile: rows of layout lines, and documents built line by line.

layout lines: doc_id, page_num, line_index, text, x, y (from the bottom), width, font_size,
bold, gap_before, and where rows were grouped cell_texts and cell_xs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import attrgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import lines as L
from inkstone.operators.walk import by_document

# fixed values
ROW_TOLERANCE = 3.5
COLUMN_TOLERANCE, COLUMN_SHARE = 16.0, 0.65
INDENT, DEEPEST = 22.0, 3


def grouped_rows(lines: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Lines of one row joined: (doc, page, row_no, text, x, x_right, font_size, bold, cell_texts, cell_xs, y).

    Lines are taken from the top down, left to right; one goes to the first row, in order of
    making, whose first line is within tolerance.  A row stands where its leftmost line does.
    """
    schema = "doc_id long, page_num int, row_no int, text string, x double, x_right double, font_size double, bold boolean, cell_texts array<string>, cell_xs array<double>, y double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for page, part in pdf.sort_values(["page_num", "y", "x", "line_index"], ascending=[True, False, True, True]).groupby("page_num", sort=True):
            rows: list[tuple[float, list]] = []
            for b in part.itertuples(index=False):
                home = next((members for anchor, members in rows if abs(anchor - b.y) <= tolerance), None)
                if home is None:
                    rows.append((b.y, home := []))
                home.append(b)
            parted = [sorted(members, key=lambda b: b.x) for _, members in rows]
            for n, members in enumerate(sorted(parted, key=lambda m: (-m[0].y, m[0].x)), 1):
                many = len(members) > 1
                out.append((pdf["doc_id"].iloc[0], page, n, " ".join(b.text for b in members), min(b.x for b in members), max(b.x + b.width for b in members), sum(b.font_size for b in members) / len(members), any(b.bold for b in members), [b.text for b in members] if many else None, [b.x for b in members] if many else None, members[0].y))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return lines.groupBy("doc_id").applyInPandas(run, schema)


def gaps_before(lines: DataFrame) -> DataFrame:
    """Distance to the line before, from the bottom upwards; 0 for the first of a page."""
    return lines.withColumn("gap_before", F.greatest(F.coalesce(F.lag("y").over(W.partitionBy("doc_id", "page_num").orderBy("line_index")) - F.col("y"), F.lit(0.0)), F.lit(0.0)))


def row_lines(rows: DataFrame) -> DataFrame:
    """Grouped rows as layout lines, with their cells."""
    lines = rows.select("doc_id", "page_num", (F.col("row_no") - 1).alias("line_index"), T.clean(F.col("text")).alias("text"), "x", "y", (F.col("x_right") - F.col("x")).alias("width"), "font_size", "bold", "cell_texts", "cell_xs")
    return gaps_before(lines)


def same_columns(a: Column, b: Column) -> Column:
    """Whether cells of two rows start at the same places: two or more each, one more or less,
    and all but 35 % of them (two at least) within 16 points."""
    n = F.least(F.size(a), F.size(b))
    near = F.size(F.filter(F.zip_with(a, b, lambda p, q: F.abs(p - q) <= COLUMN_TOLERANCE), lambda hit: F.coalesce(hit, F.lit(False))))
    return F.coalesce((n >= 2) & (F.abs(F.size(a) - F.size(b)) <= 1) & (near >= F.greatest(F.lit(2), F.ceil(n * COLUMN_SHARE))), F.lit(False))


def has_header(rows: list[list[str]]) -> bool:
    """Whether the first row of a table is its header: words, over rows that hold no fewer numbers."""
    if len(rows) < 2:
        return False
    numeric = lambda cells: sum(any("0" <= x <= "9" for x in c) for c in cells) / max(len(cells), 1)
    first = numeric(rows[0])
    return first <= 0.35 and numeric([c for row in rows[1:5] for c in row]) >= first and all(len(c) <= 50 for c in rows[0])


ELEMENTS = (
    "doc_id long, ord int, page_num int, elem_type string, text string, n_items int, cells array<struct<row_no:int,col_no:int,type:string,text:string>>, "
    "items array<struct<text:string,depth:int>>, of_pairs boolean"
)
COUNTERS = "doc_id long, tables long, lists long, headings long, artifacts long, signatures long, pair_tables long"


PLACE = ("doc_id", "page_num", "line_index")

#: What the walk asks of each line but for texts, and what that is made from once lines are dealt out.
WALKED = ("signature", "text_row", "row", "n_cells", "pair", "numbered", "level", "body", "short")
HANDED_ON = (*PLACE, "running", "x", "gap_before", "width", "font_size", "bold", "cell_xs", "signature", "text_row", "alone", "many", "n_cells", "pair", "numbered", "__n", "__length", "__points")


def documents(lines: DataFrame, ratio: float = 0.5, group: str = "doc_id", clean: bool = False) -> DataFrame:
    """Top-level elements of the edge profile's documents, heading levels clamped.

    What a line is by itself comes from column rules; runs of rows, pairs and items, which
    depend on where the last run ended, are walked a document at a time, in one pass over lines
    that are dealt out by document once.  Tables carry their cells, TH or TD, and whether pairs
    made them; lists their items without marks, and how deep these lie: by their number or by
    how far they are set in, 3 at most.  Lines without a document, page or place are left out.
    clean: texts are clean already.
    """
    t, c = F.col("text"), F.col("clean")
    own = group == "doc_id"
    rows = _placed(_told(_taken(lines, ratio, group).repartition("doc_id"), clean), _may_run(c), own)
    left, right = (F.regexp_extract(c, T.EDGE_KEY_AND_VALUE, i) for i in (1, 2))
    halves = F.when(F.col("two"), F.transform("cell_texts", T.clean)).when(left != "", F.array(F.btrim(left), F.btrim(right))).otherwise(F.array(c, F.lit("")))
    rows = rows.select(
        *_walked(), "text", F.when(F.col("row"), F.col("cells")).alias("cells"), F.when(F.col("pair"), halves).alias("halves"),
        F.when(F.col("numbered") | (F.length(t) <= 45), T.edge_unmarked(t, c)).alias("unmarked"), F.when(F.col("numbered"), T.edge_depth(t)).alias("depth"),
    )
    return by_document(rows, list(PLACE[1:]), lambda document: _build(document, ratio), _typed(ELEMENTS, rows), dealt=True)


def document_counters(lines: DataFrame, ratio: float = 0.5, group: str = "doc_id", clean: bool = False) -> DataFrame:
    """counters() of documents() by the same walk, without making the elements: lines are told
    before they are dealt out, and no text goes along but of lines that may be running ones."""
    own = group == "doc_id"
    rows = _told(_taken(lines, ratio, group), clean).withColumn("held", _may_run(F.col("clean")) if own else F.lit(None).cast("string"))
    rows = _placed(rows.select(*HANDED_ON, "held").repartition("doc_id"), F.col("held"), own).select(*_walked())
    return by_document(rows, list(PLACE[1:]), lambda document: [_counted(document, ratio)], _typed(COUNTERS, rows), dealt=True)


def _typed(schema: str, rows: DataFrame) -> str:
    """The schema with the types that rows have."""
    kinds = dict(rows.dtypes)
    return schema.replace("doc_id long", f"doc_id {kinds['doc_id']}").replace("page_num int", f"page_num {kinds['page_num']}")


def _taken(lines: DataFrame, ratio: float, group: str) -> DataFrame:
    """Lines that have a place, with all columns; running: whether they are by the pages of a group
    of documents.  Those by their own document are told in the walk, which has the whole of it."""
    if "bold" not in lines.columns:
        lines = lines.withColumn("bold", F.lit(False))
    for name, kind in (("cell_texts", "array<string>"), ("cell_xs", "array<double>")):
        if name not in lines.columns:
            lines = lines.withColumn(name, F.lit(None).cast(kind))
    lines = lines.filter(" and ".join(f"{c} is not null" for c in PLACE))
    if group == "doc_id":
        return lines.withColumn("running", F.lit(False))
    running = L.edge_lines(lines).withColumn("key", T.repeat_key(F.col("text"))).join(L.repeated_lines(lines, ratio, group).select(group, "key"), [group, "key"], "left_semi").select(*PLACE, F.lit(True).alias("running"))
    return lines.join(running, list(PLACE), "left").withColumn("running", F.coalesce("running", F.lit(False)))


def _may_run(c: Column) -> Column:
    """The clean text where its key may be short enough, else null."""
    return F.when((F.length(c) <= 120) | c.rlike("[0-9]"), c)


def _told(lines: DataFrame, clean: bool) -> DataFrame:
    """What a line is by itself."""
    given = F.coalesce(F.size("cell_texts"), F.lit(0))
    pair = (F.col("two") & (F.length(F.get("cell_texts", F.lit(0))) <= 42) & (F.length(F.get("cell_texts", F.lit(1))) > 0)) | F.col("key_value")
    cells = F.when(given >= 2, F.filter(F.transform("cell_texts", T.clean), lambda x: x != "")).otherwise(F.col("found_cells"))
    rows = L.told(lines, clean).withColumns({"two": given == 2, "many": given > 1, "cells": cells, "signature": T.edge_is_signature(F.col("text"), F.col("clean"))})
    alone = (F.size("cells") >= 3) | ((F.size("cells") >= 2) & F.forall("cells", lambda x: F.length(x) <= 50)) | F.col("text_row")
    return rows.withColumns({"pair": pair, "n_cells": F.size("cells"), "alone": alone})


def _placed(rows: DataFrame, may_run: Column, own: bool) -> DataFrame:
    """What a line is by its place and its neighbours, of lines dealt out by document."""
    page, doc = W.partitionBy("doc_id", "page_num"), W.partitionBy("doc_id")
    rows = L.placed(rows)
    rows = rows.withColumn("follows", F.lead("cell_xs").over(page.orderBy("line_index"))).withColumn("on_page", F.count(F.lit(1)).over(page)).withColumn("pages", F.when(F.min("page_num").over(doc) == F.max("page_num").over(doc), 1).otherwise(2))
    edge = (F.col("up") <= 3) | (F.col("on_page") - F.col("up") < 3)
    key = F.when(F.lit(own) & (F.col("pages") > 1) & edge, T.repeat_key(may_run, may_run))
    n = F.col("__length")
    short = (n.between(2, 55)) & ~F.col("numbered") & ~F.col("pair") & ~F.col("alone") & ~F.col("many") & (F.col("font_size") < F.col("body") + 1.5) & ~(F.col("bold") & (F.col("gap_before") >= F.col("body") * 1.25))
    return rows.withColumns({"key": key, "row": F.col("alone") | same_columns(F.col("cell_xs"), F.col("follows")), "short": short})


def _walked() -> list[Column]:
    """Columns that the walk asks for, of rows that are placed."""
    key = F.when(F.length("key").between(4, 120), F.col("key")).alias("key")
    return [*map(F.col, PLACE), F.col("x").cast("double").alias("x"), F.col("gap_before").cast("double").alias("gap_before"), F.col("running"), key, F.col("__length").cast("double").alias("n"), *map(F.col, WALKED)]


def _stretch(b: list, i: int, test) -> int:
    """End of the run from i on in which test holds."""
    j = i
    while j < len(b) and test(j):
        j += 1
    return j


def _running(document: list, ratio: float) -> set[str]:
    """Keys at the edges of enough pages of a document, as lines.repeated_lines has them."""
    found = {(line.page_num, line.key) for line in document if line.key is not None}
    if not found:
        return set()
    least = max(2, math.ceil(len({line.page_num for line in document}) * ratio))
    return {key for key, pages in Counter(key for _, key in found).items() if pages >= least}


def _parts(document: list, ratio: float) -> Iterator[tuple]:
    """(elem_type, lines, rows with cells, list items bear marks) of a document's elements in order;
    tables without such rows are made of pairs."""
    repeated = _running(document, ratio)
    for _, part in groupby(document, key=attrgetter("page_num")):
        b, i = list(part), 0
        while i < len(b):
            line, kind, rows, marked, end = b[i], None, None, False, i + 1
            if line.running or line.key in repeated:
                kind = "Artifact"
            elif line.signature:
                kind = "Figure"
                end += end < len(b) and b[end].n <= 80 and not b[end].text_row
            elif line.row:
                stop = _stretch(b, i, lambda j: b[j].row)
                table = [x for x in b[i:stop] if x.n_cells >= 2]
                if len(table) >= 2 and sum(abs(x.n_cells - table[0].n_cells) <= 1 for x in table) >= math.ceil(0.6 * len(table)):
                    kind, rows, end = "Table", table, stop
            if kind is None and line.pair:
                stop = _stretch(b, i, lambda j: b[j].pair)
                if stop - i >= 3:
                    kind, end = "Table", stop
            if kind is None and (line.short or line.numbered):  # else no list starts here
                stop, marked = _items(b, i)
                if stop - i >= 2:
                    kind, end = "L", stop
            if kind is None:
                kind = "P" if line.level is None else f"H{line.level}"
            yield kind, b[i:end], rows, marked
            i = end


def _build(document: list, ratio: float) -> list[tuple]:
    """(ord, page_num, elem_type, text, n_items, cells, items, of_pairs) of a document's lines."""
    out = []
    cell = lambda r, c, head, text: {"row_no": r, "col_no": c, "type": "TH" if head else "TD", "text": text}
    for kind, part, rows, marked in _parts(document, ratio):
        line, n, text, cells, items, pairs = part[0], 0, "", None, None, False
        if kind == "Table" and rows:
            table = [x.cells for x in rows]
            n, head = len(table), has_header(table)
            cells = [cell(r, c, head and r == 0, x) for r, row in enumerate(table) for c, x in enumerate(row)]
        elif kind == "Table":
            n, pairs = len(part), True
            cells = [cell(r, c, c == 0, x) for r, x in enumerate(part) for c, x in enumerate(x.halves)]
        elif kind == "L":
            n = len(part)
            items = [{"text": x.unmarked, "depth": _depth(x, line.x)} if marked else {"text": x.text, "depth": 1} for x in part]
        else:
            text = line.text
        out.append((line.page_num, kind, text, n, cells, items, pairs))
    return [(i, *x) for i, x in enumerate(_headed(out))]


def _counted(document: list, ratio: float) -> tuple:
    """The counters of a document's lines; as in _headed, a short paragraph may stand in for headings."""
    found, stands_in = Counter(), False
    for kind, part, rows, _ in _parts(document, ratio):
        found[kind] += 1
        if kind == "Table" and not rows:
            found["pairs"] += 1
        elif kind == "P" and 0 < part[0].n <= 100:
            stands_in = True
    headings = found["H1"] + found["H2"] + found["H3"] or int(stands_in)
    return found["Table"], found["L"], headings, found["Artifact"], found["Figure"], found["pairs"]


def _headed(elements: list[tuple]) -> list[tuple]:
    """Heading levels as structure.clamped_headings has them; in documents without a heading the
    first paragraph of at most 100 characters becomes one."""
    out, last = [], 0
    for page, kind, *rest in elements:
        if kind in ("H1", "H2", "H3"):
            last = min(int(kind[1]), last + 1, 3)
            kind = f"H{last}"
        out.append((page, kind, *rest))
    if not last:
        first = next((i for i, x in enumerate(out) if x[1] == "P" and x[2] and len(x[2]) <= 100), None)
        if first is not None:
            out[first] = (out[first][0], "H1", *out[first][2:])
    return out


def _depth(line, x: float) -> int:
    """How deep an item lies whose list starts at x."""
    inset = min(max(math.floor((line.x - x) / INDENT + 0.5) + 1, 1), DEEPEST)
    return max(inset, int(line.depth)) if line.numbered else inset


def _items(b: list, i: int) -> tuple[int, bool]:
    """End of the list that starts at i, and whether its items bear marks: short lines in one
    column, else numbered items with tails."""
    first = b[i]
    expected = max(first.gap_before or first.body * 1.2, first.body * 0.9)
    near = lambda j: b[j].short and (j == i or (abs(b[j].x - first.x) <= 18 and abs(b[j].n - first.n) <= 28 and not (b[j].gap_before and abs(b[j].gap_before - expected) > first.body * 0.9)))
    end = _stretch(b, i, near)
    if end - i >= 3:
        return end, False
    return _stretch(b, i, lambda j: b[j].numbered or (j - i >= 2 and b[j].n <= 45 and abs(b[j].x - first.x) <= 18 and abs(b[j].n - first.n) <= 25)), True


def counters(elements: DataFrame) -> DataFrame:
    """Elements by kind per document, as the summary reports them."""
    of = lambda *kinds: F.count_if(F.col("elem_type").isin(*kinds))
    return elements.groupBy("doc_id").agg(of("Table").alias("tables"), of("L").alias("lists"), of("H1", "H2", "H3").alias("headings"), of("Artifact").alias("artifacts"), of("Figure").alias("signatures"), F.count_if("of_pairs").alias("pair_tables"))


def summary(counters: DataFrame, rates: DataFrame) -> DataFrame:
    """The stored scan summary of each document as JSON: counters and the score of its checks."""
    return counters.join(rates, "doc_id").select("doc_id", F.to_json(F.struct("score", "passed", "tables", "lists", "headings", "artifacts", "signatures")).alias("scan_summary"))
