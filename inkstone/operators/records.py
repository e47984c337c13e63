"""Operators on stored records: trees of elements and their JSON, gate results, ledger changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.functions import quality, text as T
from inkstone.operators import structure

# --- trees of elements


def tree(elements: DataFrame) -> DataFrame:
    """Elements in pre-order with parent_ord and depth.

    Items and rows lie in the last list or table before them, cells in the last row of that
    table, bodies in the last item; other elements are at the top.
    """
    by_ord = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    kind = F.col("elem_type")
    last = lambda *types: F.last(F.when(kind.isin(*types), F.col("ord")), ignorenulls=True).over(by_ord)
    rows = elements.withColumns({"__l": last("L"), "__t": last("Table"), "__r": last("TR"), "__i": last("LI")})
    row = F.when(F.col("__r") > F.col("__t"), F.col("__r"))
    parent = F.when(kind == "LI", F.col("__l")).when(kind == "TR", F.col("__t")).when(kind.isin("TH", "TD"), F.coalesce(row, F.col("__t"))).when(kind == "LBody", F.col("__i"))
    inner = kind.isin("TH", "TD") & row.isNotNull() | (kind == "LBody") & (F.col("__i") > F.col("__l"))
    depth = F.when(parent.isNull(), 0).when(inner, 2).otherwise(1)
    return rows.withColumns({"parent_ord": parent, "depth": depth}).drop("__l", "__t", "__r", "__i")


def _node(children: str | None) -> str:
    inner = f", children: array<{children}>" if children else ""
    return f"struct<type: string, text: string, page: int, attrs: map<string, string>{inner}>"


#: Elements, their children and their children's children.
TREE_JSON = f"array<{_node(_node(_node(None)))}>"


def tree_json(elements: DataFrame) -> DataFrame:
    """Each document's elements as one JSON text of nested nodes.

    elements: doc_id, ord, parent_ord, depth (2 at most), elem_type, text, page_num, attrs (a
    map, null for none).  Nodes without attributes or children leave these out.
    """
    node = [F.col("elem_type").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("page_num", F.lit(0)).alias("page"), "attrs"]

    def in_order(value: Column) -> Column:
        # nodes hold maps, which have no order, so only ord is compared
        found = F.array_sort(F.collect_list(F.struct("ord", value.alias("v"))), lambda a, b: F.sign(a["ord"] - b["ord"]).cast("int"))
        return F.transform(found, lambda x: x["v"])

    def under(rows: DataFrame, below: DataFrame | None) -> DataFrame:
        """(doc_id, parent_ord, children) of the rows of a depth, with what lies below them."""
        if below is None:
            rows = rows.select("doc_id", "parent_ord", "ord", F.struct(*node).alias("n"))
        else:
            rows = rows.join(below.withColumnRenamed("parent_ord", "ord"), ["doc_id", "ord"], "left")
            rows = rows.select("doc_id", "parent_ord", "ord", F.struct(*node, "children").alias("n"))
        return rows.groupBy("doc_id", "parent_ord").agg(in_order(F.col("n")).alias("children"))

    level = lambda d: elements.filter(F.col("depth") == d)
    middle = under(level(1), under(level(2), None))
    top = level(0).join(middle.withColumnRenamed("parent_ord", "ord"), ["doc_id", "ord"], "left")
    return top.groupBy("doc_id").agg(F.to_json(in_order(F.struct(*node, "children"))).alias("structure_json"))


def from_tree_json(stored: DataFrame) -> DataFrame:
    """Elements of nested JSON in pre-order: (doc_id, ord, parent_ord, depth, elem_type, text, page_num, attrs).

    Types that are missing are P, texts and pages empty and 0.
    """
    top = stored.select("doc_id", F.posexplode(F.from_json("structure_json", TREE_JSON)).alias("a", "x"))
    rows = top.select("doc_id", "a", F.lit(-1).alias("b"), F.lit(-1).alias("c"), F.col("x").dropFields("children").alias("n"))
    inner = top.select("doc_id", "a", F.posexplode("x.children").alias("b", "y"))
    rows = rows.unionByName(inner.select("doc_id", "a", "b", F.lit(-1).alias("c"), F.col("y").dropFields("children").alias("n")))
    rows = rows.unionByName(inner.select("doc_id", "a", "b", F.posexplode("y.children").alias("c", "n")))
    place = W.partitionBy("doc_id").orderBy("a", "b", "c")
    rows = rows.withColumn("ord", F.row_number().over(place) - 1).withColumn("depth", (F.col("b") >= 0).cast("int") + (F.col("c") >= 0).cast("int"))
    upto = place.rowsBetween(W.unboundedPreceding, 0)
    last = lambda d: F.last(F.when(F.col("depth") == d, F.col("ord")), ignorenulls=True).over(upto)
    parent = F.when(F.col("depth") == 1, last(0)).when(F.col("depth") == 2, last(1))
    return rows.select("doc_id", "ord", parent.alias("parent_ord"), "depth", F.coalesce("n.type", F.lit("P")).alias("elem_type"), F.coalesce("n.text", F.lit("")).alias("text"), F.coalesce("n.page", F.lit(0)).alias("page_num"), F.col("n.attrs").alias("attrs"))


# fixed values: kinds that the inspection of a tree asks for
TREE_WARNINGS = (("NO_HEADINGS", None, ("H", *structure.HEADINGS)), ("TABLES_NO_TH", "Table", ("TH",)), ("LISTS_NO_LBODY", "L", ("LBody",)))


def tree_warnings(elements: DataFrame, deepest: int = 50) -> DataFrame:
    """(doc_id, warning) of trees down to a depth: no heading, tables without a header cell,
    lists without a body."""
    has = lambda types: F.bool_or(F.col("elem_type").isin(*types))
    tests = [F.when((has((asks,)) if asks else F.lit(True)) & ~has(types), name) for name, asks, types in TREE_WARNINGS]
    rows = elements.filter(F.col("depth") <= deepest).groupBy("doc_id").agg(F.array_compact(F.array(*tests)).alias("w"))
    return rows.select("doc_id", F.explode("w").alias("warning"))


def tree_shape(parents: DataFrame) -> DataFrame:
    """Per document and page the entries of the parent tree: how many marks, whether their
    numbers run from 0 without gaps, and how many elements own them."""
    rows = parents.groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("marks"), F.max("mcid").alias("m"), F.countDistinct("mcid").alias("d"), F.countDistinct("owner").alias("owners"))
    return rows.select("doc_id", "page_num", "marks", ((F.col("m") == F.col("marks") - 1) & (F.col("d") == F.col("marks"))).alias("gapless"), "owners")


# --- scores


def gated(scores: DataFrame, gate: DataFrame) -> DataFrame:
    """Scores (doc_id, base) with what the gate makes of them: hard failures cap at 45, open
    reviews at 69, and hard failures are never compliant."""
    rows = scores.join(gate.select("doc_id", "hard_fails", "reviews"), "doc_id", "left").fillna(0, ["hard_fails", "reviews"])
    hard, open_ = F.col("hard_fails") > 0, F.col("reviews") > 0
    score = F.when(hard, F.least("base", F.lit(structure.HARD_CAP))).when(open_, F.least("base", F.lit(structure.REVIEW_CAP))).otherwise(F.col("base"))
    return rows.select("doc_id", score.alias("score"), F.when(hard, "non_compliant").otherwise(quality.status_of(score)).alias("status"))


# --- lines


def page_texts(lines: DataFrame) -> DataFrame:
    """The lines of each page as one text."""
    rows = lines.groupBy("doc_id", "page_num").agg(F.sort_array(F.collect_list(F.struct("line_index", "text"))).alias("l"))
    return rows.select("doc_id", "page_num", F.array_join("l.text", "\n").alias("text"))


def html_escaped(text: Column) -> Column:
    """Text as it stands in HTML, quotes included."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):  # fixed values
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def with_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows with what is known of their page; rows of other pages keep nulls."""
    return rows.join(pages, ["doc_id", "page_num"], "left")


def key_and_value(text: Column) -> Column:
    """struct(label, value) of an edge key/value line, null for others."""
    label, value = (F.btrim(F.regexp_extract(T.clean(text), T.EDGE_KEY_AND_VALUE, i)) for i in (1, 2))
    return F.when(T.edge_is_key_value(text) & (label != ""), F.struct(label.alias("label"), value.alias("value")))


# --- ledger


def documents_of(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The ledger's row of each id with its features decoded; state says whether it is there."""
    rows = ids.join(jobs.withColumn("known", F.lit(True)), "id", "left")
    features = F.coalesce(F.from_json("accessibility_features", "array<string>"), F.array().cast("array<string>"))
    return rows.select("id", F.when(F.col("known"), "found").otherwise("not_found").alias("state"), "status", "pages", F.size(features).alias("n_features"), F.array_join(features, ",").alias("features"))


def appended(logs: DataFrame, fresh: DataFrame) -> DataFrame:
    """The audit log with further rows, numbered on from its largest id in order of time.

    fresh: job_id, operation, status, message, timestamp; a batch of one call, so it is small.
    """
    top = logs.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    nth = F.row_number().over(W.orderBy("timestamp", "job_id", "operation"))
    rows = fresh.select((top + nth).cast("long").alias("id"), *fresh.columns)
    return logs.select("id", *fresh.columns).unionByName(rows)


# fixed values: limits of resources
SLOW_AVERAGE, MAX_STORE_MB, SLOW_RESPONSE = 300.0, 500.0, 5.0


def resource_alerts(jobs: DataFrame) -> DataFrame:
    """Per day the mean time of finished jobs, the megabytes stored up to then, and the alerts."""
    days = jobs.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.avg(F.when(F.col("status") == "done", F.col("processing_time_seconds"))).alias("avg_seconds"), F.sum("file_size").alias("bytes"))
    stored = F.sum("bytes").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)) / (1024 * 1024)  # a row a day
    rows = days.select("day", "avg_seconds", stored.alias("stored_mb"))
    return rows.select("day", F.round("avg_seconds", 6).alias("avg_seconds"), F.round("stored_mb", 6).alias("stored_mb"), F.coalesce(F.col("avg_seconds") > SLOW_AVERAGE, F.lit(False)).alias("slow"), F.coalesce(F.col("stored_mb") > MAX_STORE_MB, F.lit(False)).alias("full"))


def slow_responses(logs: DataFrame, seconds: float = SLOW_RESPONSE) -> DataFrame:
    """Jobs whose steps follow each other after more than so many seconds: (job_id, n, longest)."""
    by_time = W.partitionBy("job_id").orderBy("timestamp", "id")
    t = F.col("timestamp").cast("timestamp").cast("double")
    rows = logs.select("job_id", (t - F.lag(t).over(by_time)).alias("wait")).filter(F.col("wait") > seconds)
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("wait"), 3).alias("longest"))
