"""Removal of lines that many documents share (DataFrame functions only).

Explode each document's distinct normalised lines, hash them, count distinct documents per
hash, drop the lines over the threshold, and reassemble each text from its other lines by
position.

Only hashes and ids move for the count: they are first made distinct by hash and document,
which spreads a line that a third of all documents holds over all tasks, and then counted with
partial sums.  Positions come back through a join in which each hash is unique on one side, so
Spark can split a hot hash, and text moves once, cut into lines and keyed by document.  What
stays of a text is found by one pass over its positions, so a text of very many lines costs in
proportion.

Defined results: null and empty texts are one empty line; rows of one id are one document when
documents are counted, and each is cleaned by itself; rows without an id are one document for
each text; equal rows get equal results; columns of the input other than the text are carried
along, internal names start with __ld_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import common

MIN_DOCS = 10
MIN_CHARS = 1


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return common.ascii_lower(F.btrim(line, F.lit(common.BLANKS)))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text cleaned; __ld_lines and __ld_dropped hold the line counts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2 = lambda c: F.xxhash64(c), lambda c: F.xxhash64(F.lit("second"), c)
    whole = docs.withColumn("__ld_text", text).withColumn("__ld_id", F.col(id_col).cast("long"))
    keyed = whole.select("__ld_id", h1("__ld_text").alias("__ld_h"), F.transform(F.split("__ld_text", "\n", -1), line_key).alias("keys"))
    long_enough = F.filter("keys", lambda k: F.length(k) >= min_chars)
    document = F.struct("__ld_id", F.when(F.col("__ld_id").isNull(), F.col("__ld_h")).alias("h"))
    per_doc = keyed.select(document.alias("d"), F.explode(F.array_distinct(long_enough)).alias("k")).select("d", h1("k").alias("h1"), h2("k").alias("h2"))
    frequent = per_doc.groupBy("h1", "h2").agg(F.count_distinct("d").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    # there is always a line, and for the plain form Spark would cut each text once more to test that
    placed = keyed.select("__ld_id", "__ld_h", F.posexplode_outer("keys").alias("at", "k")).filter(F.length("k") >= min_chars)
    placed = placed.select("__ld_id", "__ld_h", "at", h1("k").alias("h1"), h2("k").alias("h2"))
    # left_semi keeps the frequent side unique, so only the exploded side can be hot, and that is split
    lost = placed.join(frequent, ["h1", "h2"], "left_semi").groupBy("__ld_id", "__ld_h").agg(F.collect_set("at").alias("__ld_lost"))
    lost = lost.withColumnsRenamed({"__ld_id": "__ld_id2", "__ld_h": "__ld_h2"})
    # cut below the join, so that the lines are a column there and not cut again for each use
    parted = whole.withColumn("__ld_h", h1("__ld_text")).withColumn("__ld_parts", F.split("__ld_text", "\n", -1)).drop("__ld_text", text_col)
    both = parted.join(lost, F.col("__ld_id").eqNullSafe(F.col("__ld_id2")) & (F.col("__ld_h") == F.col("__ld_h2")), "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("__ld_parts") - 1), "__ld_lost")
    kept = F.transform(stays, lambda at: F.get("__ld_parts", at))
    return both.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text_col],
        F.array_join(F.when(F.col("__ld_lost").isNull(), F.col("__ld_parts")).otherwise(kept), "\n").alias(text_col),
        F.size("__ld_parts").cast("long").alias("__ld_lines"),
        F.coalesce(F.size("__ld_lost"), F.lit(0)).cast("long").alias("__ld_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_common_lines(docs)
    return out.select("doc_id", F.col("__ld_lines").alias("n_lines"), F.col("__ld_dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


LINES_SQL = r"""
lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {docs}))
),
frequent AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
"""

QUERIES = {"op8_line_dedup": op8_line_dedup}
SQL = {
    "op8_line_dedup": "WITH "
    + LINES_SQL.format(docs="documents")
    + """
SELECT doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (f.k IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.k = f.k
GROUP BY doc_id
"""
}
