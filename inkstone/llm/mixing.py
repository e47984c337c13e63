"""Mixing sources to target weights over a curriculum (DataFrame functions only).

A source's weight may change over training: its schedule gives the weight at evenly spaced
knots, linear in between.  The integral of the schedule is the source's share of all words,
so targets follow from the integrals; no source is repeated more than max_repeats times, and
what that leaves over is shared again by weight until none is above (solved in one pass by
sorting sources by cap over weight).  The share of a target that is due at time t is the
integral up to t over the whole integral; inverting it at the middle of a document's span of
cumulative words gives the time at which the document is trained on, and the mix is range-
sorted by that time.

Within a source documents are ordered by a hash of their id.  Running sums are taken in two
levels, first over hash buckets and then inside each, so a source that holds a third of all
rows is spread over as many tasks as others.

Defined results: a null source is a source, last in order; null or empty texts have size 0
and are never taken; rows without an id are ordered by their text; equal rows follow each
other; an empty table gives no rows; other columns are carried, internal names start with __m_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.llm import common
from inkstone.plans.staging import stage

MAX_REPEATS = 3
BUCKET_BITS = 12
ORDER_DIGITS = 10  # hex digits, 40 bits
#: Shapes of the schedules in turn, as factors of the mean weight: fading out, fading in.
SHAPES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5))


def schedules(sources: DataFrame, shapes: tuple[tuple[float, ...], ...] = SHAPES) -> DataFrame:
    """Weights 1, 2, 3, repeating, by the code-point order of sources, null last."""
    rank = F.row_number().over(W.orderBy(F.col("__m_source").asc_nulls_last())) - 1
    weight = (F.pmod(rank, F.lit(3)) + 1).cast("double")
    shape = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in shapes]), (F.pmod(rank, F.lit(len(shapes))) + 1).cast("int"))
    return sources.withColumn("__m_rank", rank).withColumn("__m_knots", F.transform(shape, lambda x: x * weight))


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds __m_integral and __m_target to rows of (source, words, knots); one row per source.

    Sources in order of cap over weight: those before the first whose cap is not reached are
    held at their caps.  The rate for each prefix of held sources rises up to that point and
    falls after it, so the right rate is the largest.
    """
    steps = F.size("__m_knots") - 1
    pieces = F.zip_with(F.slice("__m_knots", 1, steps), F.slice("__m_knots", 2, steps), lambda a, b: (a + b) / 2)
    integral = F.aggregate(pieces, F.lit(0.0), lambda s, x: s + x) / steps
    rows = sources.withColumn("__m_integral", integral).withColumn("__m_cap", F.col("__m_words") * max_repeats)
    before = W.orderBy(F.col("__m_cap") / F.col("__m_integral"), "__m_rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    rows = rows.select("*", F.coalesce(F.sum("__m_cap").over(before), F.lit(0)).alias("__m_held"), F.coalesce(F.sum("__m_integral").over(before), F.lit(0.0)).alias("__m_gone"), F.sum("__m_words").over(everything).alias("__m_all"), F.sum("__m_integral").over(everything).alias("__m_sum"))
    rate = (F.col("__m_all") - F.col("__m_held")) / (F.col("__m_sum") - F.col("__m_gone"))
    rows = rows.withColumn("__m_rate", F.max(rate).over(everything))
    return rows.withColumn("__m_target", F.least(F.col("__m_cap").cast("double"), F.col("__m_rate") * F.col("__m_integral")))


def time_of(share: Column, knots: str = "__m_knots") -> Column:
    """The time in 0..1 by which a schedule has asked for the given share of its integral."""
    steps = F.size(knots) - 1
    areas = F.zip_with(F.slice(knots, 1, steps), F.slice(knots, 2, steps), lambda a, b: (a + b) / 2)
    goal = share * F.aggregate(areas, F.lit(0.0), lambda s, x: s + x)
    # walk the steps: the last one that starts below the goal, and what is asked for before it
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("before"))
    walked = F.aggregate(areas, start, lambda s, x: F.struct((s.i + 1).alias("i"), F.when(s["sum"] < goal, s.i).otherwise(s["at"]).alias("at"), (s["sum"] + x).alias("sum"), F.when(s["sum"] < goal, s["sum"]).otherwise(s["before"]).alias("before")))
    left, right = F.element_at(knots, walked["at"] + 1), F.element_at(knots, walked["at"] + 2)
    rest, slope = goal - walked["before"], right - left
    root = F.sqrt(F.greatest(left * left + 2 * slope * rest, F.lit(0.0)))
    inside = F.when((left + root) > 0, 2 * rest / (left + root)).otherwise(F.lit(0.0))  # the stable form of the quadratic's root
    return F.least(F.greatest((walked["at"] + inside) / steps, F.lit(0.0)), F.lit(1.0))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: int = MAX_REPEATS, make_schedules=schedules, cut: bool = True) -> DataFrame:
    """One row per document, without its text: sizes, target, words taken, first position.

    cut: the one document at which a source's last, partial pass ends is taken in part, so
    that targets are met to the word; otherwise it is taken whole if its middle lies inside.
    """
    digits = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    thin = stage(
        docs.select(
            F.col(id_col).cast("long").alias("__m_id"),
            F.xxhash64(F.col(text_col)).alias("__m_hash"),
            F.col(source_col).cast("string").alias("__m_source"),
            common.n_words(F.col(text_col)).alias("__m_size"),
            F.conv(F.substring(digits, 1, ORDER_DIGITS), 16, 10).cast("long").alias("__m_order"),
        ),
        "sizes",
    )
    bucket = F.shiftright("__m_order", 4 * ORDER_DIGITS - BUCKET_BITS)
    thin = thin.withColumn("__m_bucket", bucket).withColumn("__m_key", F.coalesce(F.concat(F.lit("="), "__m_source"), F.lit("")))
    sums = thin.groupBy("__m_key", "__m_bucket").agg(F.sum("__m_size").alias("__m_part"), F.first("__m_source").alias("__m_source"))
    ahead = W.partitionBy("__m_key").orderBy("__m_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = stage(sums.withColumn("__m_base", F.coalesce(F.sum("__m_part").over(ahead), F.lit(0))), "bucket_sums")
    sources = sums.groupBy("__m_key").agg(F.first("__m_source").alias("__m_source"), F.sum("__m_part").alias("__m_words"))
    sources = targets(make_schedules(sources), max_repeats).select("__m_key", "__m_words", "__m_target", "__m_knots")
    sums = sums.join(sources, "__m_key").select("__m_key", "__m_bucket", "__m_base", "__m_words", "__m_target", "__m_knots")
    upto = W.partitionBy("__m_key", "__m_bucket").orderBy("__m_order", F.col("__m_id").asc_nulls_last(), "__m_hash").rowsBetween(W.unboundedPreceding, 0)
    rows = thin.withColumn("__m_run", F.sum("__m_size").over(upto)).join(sums, ["__m_key", "__m_bucket"])
    first = F.col("__m_base") + F.col("__m_run") - F.col("__m_size")  # words of the source ahead of the document
    goal = F.round("__m_target").cast("long")
    passes = F.when(F.col("__m_words") > 0, F.floor(goal / F.col("__m_words"))).otherwise(F.lit(0)).cast("long")
    over = goal - passes * F.col("__m_words")  # words of the last, partial pass
    part = F.greatest(F.least(over - first, F.col("__m_size")), F.lit(0))
    if not cut:
        part = F.when(2 * part >= F.col("__m_size"), F.col("__m_size")).otherwise(F.lit(0))
    middle = first + F.col("__m_size") / 2
    share = F.when(goal > 0, F.least(middle / goal, F.lit(1.0))).otherwise(F.lit(1.0))
    rows = rows.select("*", first.alias("__m_first"), goal.alias("__m_goal"), passes.alias("__m_passes"), part.alias("__m_over"))
    return rows.withColumn("__m_taken", F.col("__m_passes") * F.col("__m_size") + F.col("__m_over")).withColumn("__m_time", time_of(share))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents in training order: a row for each pass over a document, with the
    columns of docs.  Documents are taken whole.
    """
    plan = plan_mix(docs, id_col, text_col, source_col, cut=False, **options)
    copies = F.col("__m_passes") + F.when(F.col("__m_over") > 0, 1).otherwise(0)
    plan = plan.filter((copies > 0) & (F.col("__m_size") > 0)).dropDuplicates(["__m_id", "__m_hash", "__m_key"])
    plan = plan.select(F.col("__m_id").alias("__m_id2"), F.col("__m_hash").alias("__m_hash2"), F.col("__m_source").alias("__m_source2"), "__m_knots", "__m_first", "__m_size", "__m_goal", "__m_words", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("__m_pass"))
    middle = (F.col("__m_pass") - 1) * F.col("__m_words") + F.col("__m_first") + F.col("__m_size") / 2
    plan = plan.withColumn("__m_time", time_of(F.least(middle / F.col("__m_goal"), F.lit(1.0)))).drop("__m_knots")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__m_id2")) & (F.xxhash64(F.col(text_col)) == F.col("__m_hash2")) & F.col(source_col).cast("string").eqNullSafe(F.col("__m_source2"))
    mixed = docs.join(plan, same).repartitionByRange("__m_time", id_col).sortWithinPartitions("__m_time", id_col, "__m_pass")
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = plan_mix(docs)
    out = plan.select(F.col("__m_id").alias("doc_id"), F.col("__m_size").alias("size"), F.col("__m_words").alias("source_size"), F.col("__m_target").alias("target"), F.col("__m_taken").alias("taken"), F.col("__m_time").alias("position"))
    return out.orderBy("position", "doc_id")


QUERIES = {"op1_mix_sources": op1_mix_sources}
SQL = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 10) AS BIGINT) AS o
  FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
),
weighted AS (
  SELECT source, words, rank, (rank % 3 + 1)::DOUBLE AS w, words * 3 AS cap,
         (SELECT sum(words) FROM sources) AS total, (SELECT sum(rank % 3 + 1) FROM sources)::DOUBLE AS w_total
  FROM sources
),
rated AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0))::DOUBLE / (w_total - coalesce(sum(w) OVER b, 0)) AS r
  FROM weighted
  WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
goals AS (
  SELECT source, rank, words, least(cap::DOUBLE, (SELECT max(r) FROM rated) * w) AS target FROM rated
),
placed AS (
  SELECT s.doc_id, s.size, g.words, g.target, g.rank, round(g.target)::BIGINT AS goal,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY o, s.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS ahead
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
),
taken AS (
  SELECT doc_id, size, words AS source_size, target, rank,
         CASE WHEN words > 0 THEN goal // words ELSE 0 END * size
           + greatest(least(goal - CASE WHEN words > 0 THEN goal // words ELSE 0 END * words - ahead, size), 0) AS taken,
         CASE WHEN goal > 0 THEN least((ahead + size / 2.0::DOUBLE) / goal, 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS share
  FROM placed
),
-- schedules of three knots: 1.5, 1, 0.5 times the weight for even ranks, 0.5, 1, 1.5 for odd ones
knots AS (
  SELECT *, (rank % 3 + 1)::DOUBLE AS w, CASE WHEN rank % 2 = 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS k1,
         CASE WHEN rank % 2 = 0 THEN 0.5 ELSE 1.5 END::DOUBLE AS k3 FROM taken
),
goal_area AS (
  SELECT *, share * ((0.0::DOUBLE + (k1 * w + w) / 2) + (w + k3 * w) / 2) AS goal_at, (k1 * w + w) / 2 AS first_area FROM knots
),
stepped AS (
  SELECT *, CASE WHEN first_area < goal_at THEN 1 ELSE 0 END AS step_no,
         CASE WHEN first_area < goal_at THEN first_area ELSE 0 END AS before,
         CASE WHEN first_area < goal_at THEN w ELSE k1 * w END AS l,
         CASE WHEN first_area < goal_at THEN k3 * w ELSE w END AS r
  FROM goal_area
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       least(greatest((step_no + 2 * (goal_at - before) / (l + sqrt(greatest(l * l + 2 * (r - l) * (goal_at - before), 0)))) / 2, 0), 1) AS position
FROM stepped
"""
}
