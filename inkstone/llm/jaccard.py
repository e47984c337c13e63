"""Similarity join on word n-grams (shingles) with a tree of count vectors.

The result is classes: documents that chains of links join, where two documents link when
their sets share at least the given percentage of their union.  No link is lost.

1. Every shingle counts towards one of 2^24 counters; the counters' sums over all documents
   (one byte each, on a logarithmic scale) put frequent shingles last in one common order.
2. Equal sets form a class with one representative, so exact copies cost nothing further.
3. Two sets that link must share one of the first n - ceil(p n) + 1 shingles of that order.
   Documents that share such a shingle form a cell of the index; cells with the same members
   are one.
4. In each cell a tree of count vectors (rtree.py) links members whose bound, the sum of the
   coordinate minima, allows a link.  Only links that join new members leave the cell, so a
   cell of m near copies gives m - 1 rows and not m squared.
5. Connected components of these give clusters.  A cluster's texts meet, and the same tree,
   now verifying on the exact sets, finds the true links.
   Large cells and clusters are dealt to blocks of bounded size (group_links): the blocks'
   largest classes are compared by representatives, and then whatever is not in the group's
   largest class is compared with every block.
6. Components of the true links, joined back through the representatives.

Defined results: null and empty texts have no shingles and link with nothing; a text with
fewer words than a shingle is one shingle; rows that repeat an id are one document for
links; rows without an id link with nothing and have no component; extra columns are ignored
by near_duplicates and carried by keep_one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import common, rtree
from inkstone.llm.components import components
from inkstone.plans.staging import stage

WIDTH, PERCENT = 5, 80
COUNTER_BITS = 24
#: A counter enters the sums if a task counts this many; the order may be any, so this only saves rows.
TASK_LEAST = 3
FREQUENT = 24
#: Members of a cell that a task holds at once; a larger cell is dealt to blocks.
CELL_SETS = 4096
#: Shingles of the sets that a task holds at once when it verifies a cluster.
BLOCK_SHINGLES = 1_000_000


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [t.lower().split() for t in texts]  # bytes.lower and bytes.split know ASCII only
    flat = common.WORD_HASHES.of([w for ws in words for w in ws])
    rolled, out, at = common.rolling(flat, width), [], 0
    for ws in words:
        n = len(ws)
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            out.append(common.rolling(flat[at : at + n], n, 0xD6E8FEB86659FD93 + 2 * n))
        else:
            out.append(flat[:0])
        at += n
    return out


def sets_of(batches: Iterator[pa.RecordBatch], width: int, column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            yield part, shingle_sets(common.as_bytes(part.column(column)), width)


def counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """The counters' levels: 0 for rare, else about 4 log2 of the count.  Always 2^24 bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        for _, sets in sets_of(batches, width, 0):
            np.add.at(counts, counter(np.concatenate(sets)), 1)
        found = np.flatnonzero(counts >= TASK_LEAST)
        yield from common.batches_of(pa.schema([("counter", pa.int32()), ("n", pa.int64())]), {"counter": found, "n": counts[found]})

    chunk = 1 << 16

    def levels(part: pa.Table) -> pa.Table:
        out = np.zeros(chunk, np.uint8)
        out[part["counter"].to_numpy() % chunk] = np.minimum(255, 4 * np.log2(part["n"].to_numpy())).astype(np.uint8)
        return pa.table({"chunk": pa.array([part["counter"][0].as_py() // chunk], pa.int32()), "levels": pa.array([out.tobytes()], pa.binary())})

    sums = docs.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    chunks = sums.groupBy(F.shiftright("counter", 16).alias("chunk")).applyInArrow(lambda t: levels(t), "chunk int, levels binary")
    out = np.zeros(1 << COUNTER_BITS, np.uint8)
    for row in chunks.collect():  # at most 256 rows of 64 KB, whatever the input
        out[row.chunk * chunk : (row.chunk + 1) * chunk] = np.frombuffer(row.levels, np.uint8)
    return out


SETS = "doc_id long, n long, c1 long, c2 long, prefix array<long>, point binary"


def indexed(docs: DataFrame, width: int, percent: int, order: Broadcast) -> DataFrame:
    """Per document: size and digest of its set, its prefix in the common order, its point."""
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n", "c1", "c2")), ("prefix", pa.list_(pa.int64())), ("point", pa.binary())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = order.value
        for part, sets in sets_of(batches, width, 1):
            c1, c2, prefixes, points = [], [], [], []
            for s in sets:
                n = len(s)
                c1.append(int(common.mixed(s).sum(dtype=np.uint64).astype(np.int64)))
                c2.append(int(common.mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                length = n - -(-percent * n // 100) + 1 if n else 0
                prefixes.append(s[np.argsort(level[counter(s)], kind="stable")[:length]].view(np.int64))
                points.append(rtree.point(s) if n else b"")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(prefixes, schema.field("prefix").type), pa.array(points, pa.binary())], schema=schema)

    return docs.mapInArrow(describe, SETS)


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Cut a sorted stream so that no run of equal keys is parted."""
    held: list[pa.RecordBatch] = []
    last = lambda b, i: tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in keys)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, lo = last(batch, batch.num_rows - 1), 0
        if last(batch, 0) != key:
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            lo = int(np.flatnonzero(np.any([c != c[-1] for c in columns], axis=0)).max()) + 1
        elif held and last(held[-1], held[-1].num_rows - 1) == key:
            held.append(batch)
            continue
        if held or lo:
            yield pa.Table.from_batches([*held, *([batch.slice(0, lo)] if lo else [])])
        held = [batch.slice(lo)]
    if held:
        yield pa.Table.from_batches(held)


def bounds_of(key: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


def groups_of(part: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where the runs of equal keys start, and the end."""
    changes = np.zeros(part.num_rows, np.int64)
    for k in keys:
        column = part[k].to_numpy()
        changes[1:] |= column[1:] != column[:-1]
    return bounds_of(np.cumsum(changes))


def cells(reps: DataFrame) -> DataFrame:
    """(label, node, weight, blocks, block) for the prefix shingles that several sets hold; equal cells are one.

    A cell is named by the sum of its members' hashes, which is taken before the exchange, so
    the holders of a shingle never meet as a group.  Two cells that share a name by chance are
    one, which adds members and loses none.  Members of a cell are dealt to blocks.
    """
    keyed = reps.select(F.col("doc_id").alias("node"), F.explode("prefix").alias("key"))
    held = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("node")).alias("sign")).filter("members > 1")
    held = held.select("key", F.xxhash64("members", "sign").alias("label"), F.ceil(F.col("members") / CELL_SETS).cast("long").alias("blocks"))
    placed = keyed.join(held, "key").groupBy("label", "node").agg(F.max("blocks").alias("blocks"))
    return placed.select("label", "node", F.lit(1).cast("long").alias("weight"), "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"))


def dealt(rows: DataFrame, most: int, at_most_half: bool = False) -> DataFrame:
    """rows (label, node, weight) with blocks, a label's number of them, and block, by a hash of node."""
    count = F.ceil(F.sum("weight") / most)
    if at_most_half:
        count = F.least(count, F.ceil(F.count(F.lit(1)) / 2))
    total = rows.groupBy("label").agg(F.greatest(count, F.lit(1)).cast("long").alias("blocks"))
    return rows.join(total, "label").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
Compare = Callable[[DataFrame, tuple[str, ...]], DataFrame]


def bounded(percent: int) -> Compare:
    """Links within the groups that keys name, as the bound allows; rows have node, known (class so far), n, point."""

    def compare(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in runs(batches, keys):
                at = groups_of(part, keys)
                node, sizes, known = part["node"].to_numpy(), part["n"].to_numpy(), part["known"].to_numpy()
                points, a, b = part["point"].combine_chunks(), [], []
                lengths = pc.binary_length(points).to_numpy(zero_copy_only=False)
                members = np.diff(at)
                # groups of two sets whose points are of one shape are compared many at a time
                first = at[:-1][members == 2]
                own = np.array(rtree.GROUPS)[np.searchsorted(rtree.SIZES, sizes, side="right") - 1]
                alike = (lengths[first] == own[first]) & (lengths[first + 1] == own[first]) & (own[first + 1] == own[first])
                for length in np.unique(lengths[first[alike]]):
                    pairs = first[alike & (lengths[first] == length)]
                    for lo in range(0, len(pairs), 1000):
                        i = pairs[lo : lo + 1000]
                        p, q = (np.frombuffer(b"".join(points.take(pa.array(r)).to_pylist()), np.uint8).reshape(len(i), -1) for r in (i, i + 1))
                        ok = np.minimum(p, q).sum(axis=1, dtype=np.int64) >= rtree.needed(sizes[i], sizes[i + 1], percent)
                        a.append(node[i[ok]])
                        b.append(node[i[ok] + 1])
                for start, n in [(i, 2) for i in first[~alike]] + list(zip(at[:-1][members > 2], members[members > 2], strict=True)):
                    classes = joined(known[start : start + n])
                    found = np.array(rtree.link_sets(points.slice(start, n).to_pylist(), sizes[start : start + n], percent, classes), np.int64).reshape(-1, 2)
                    a.append(node[start + found[:, 0]])
                    b.append(node[start + found[:, 1]])
                if a:
                    yield from common.batches_of(LINKS, {"a": np.concatenate(a), "b": np.concatenate(b)})

        return rows.repartition(*keys).sortWithinPartitions(*keys, "n", "node").select(*keys, "node", "known", "n", "point").mapInArrow(in_groups, "a long, b long")

    return compare


def joined(known: np.ndarray) -> rtree.Classes:
    """Positions in the classes that are known."""
    classes, first = rtree.Classes(len(known)), {}
    for i, k in enumerate(known.tolist()):
        classes.union(first.setdefault(k, i), i)
    return classes


def verified(width: int, percent: int) -> Compare:
    """True links within the groups that keys name; rows have node, known (class so far), text."""

    def compare(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        def in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in runs(batches, keys):
                at, a, b = groups_of(part, keys), [], []
                for lo, hi in zip(at[:-1], at[1:], strict=True):
                    if hi - lo < 2:
                        continue
                    here = part.slice(lo, hi - lo).combine_chunks()
                    sets = [x for lo_ in range(0, len(here), 250) for x in shingle_sets(common.as_bytes(here["text"].slice(lo_, 250).combine_chunks()), width)]
                    node, sizes = here["node"].to_numpy(), np.array([len(s) for s in sets], np.int64)

                    def enough(p: int, q: int, sets=sets) -> bool:
                        both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                        return 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both)

                    for p, q in rtree.link_sets([rtree.point(s) for s in sets], sizes, percent, joined(here["known"].to_numpy()), enough):
                        a.append(node[p])
                        b.append(node[q])
                if a:
                    yield from common.batches_of(LINKS, {"a": a, "b": b})

        return rows.repartition(*keys).sortWithinPartitions(*keys, "node").select(*keys, "node", "known", "text").mapInArrow(in_groups, "a long, b long")

    return compare


def largest(rows: DataFrame) -> DataFrame:
    """(label, known, node, weight): of each block the largest class and one of its nodes."""
    size = rows.groupBy("label", "block", "known").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("node"), F.min_by("weight", "node").alias("weight"))
    return size.groupBy("label", "block").agg(F.max(F.struct("size", "known", "node", "weight")).alias("most")).select("label", "most.known", "most.node", "most.weight")


def group_links(placed: DataFrame, payload: DataFrame, compare: Compare, most: int) -> DataFrame:
    """Links (a, b) that join all nodes of a label which compare's links join.

    placed: label, node, weight, blocks, block; payload: node and what compare reads.  No task
    holds more than a block and a chunk.  Within its block a node meets all others.  Then the
    largest classes of the blocks meet through one node each, in rounds that at least halve
    them, and whatever is not in the label's largest class afterwards meets every block.
    """
    known = placed.withColumn("known", F.col("node"))
    links = stage(compare(known.join(payload, "node"), ("label", "block")), "links")
    spread = placed.filter("blocks > 1")
    if not spread.take(1):
        return links
    spread = stage(spread, "spread")

    def classed(rows: DataFrame) -> DataFrame:
        found = components(links).withColumnRenamed("label", "known")
        return stage(rows.drop("known").join(found, "node", "left").withColumn("known", F.coalesce("known", "node")), "known")

    known = classed(spread)
    heads = largest(known)
    while True:
        heads = stage(dealt(heads, most, at_most_half=True), "heads")
        links = stage(links.unionByName(compare(heads.join(payload, "node"), ("label", "block"))), "links")
        if not heads.filter("blocks > 1").take(1):
            break
        heads = largest(classed(heads))
    known = classed(spread)
    giant = known.groupBy("label", "known").agg(F.count(F.lit(1)).alias("size")).groupBy("label").agg(F.max(F.struct("size", "known")).alias("most")).select("label", F.col("most.known").alias("giant"))
    rest = known.join(giant, "label").filter("known <> giant").select("label", "node", "known", "weight")
    rest = stage(dealt(rest, most).select("label", "node", "known", F.col("block").alias("chunk")), "rest")
    blocks = known.join(rest.select("label", "chunk").distinct(), "label").select("label", "block", "chunk", "node", "known")
    others = rest.join(spread.select("label", "blocks").distinct(), "label").select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "chunk", "node", "known")
    pairs = blocks.unionByName(others).distinct()
    return links.unionByName(compare(pairs.join(payload, "node"), ("label", "block", "chunk")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = spark.sparkContext.broadcast(frequencies(docs, width))
    sets = stage(indexed(docs, width, percent, order), "sets")
    order.destroy()
    thin = sets.select("doc_id", "n", "c1", "c2")
    named = thin.filter("doc_id is not null and n > 0")
    first = stage(named.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("rep")), "representatives")
    reps = sets.join(first.select("n", "c1", "c2", F.col("rep").alias("doc_id")), ["doc_id", "n", "c1", "c2"], "left_semi").dropDuplicates(["doc_id", "c1", "c2"])
    points = reps.select(F.col("doc_id").alias("node"), "n", "point")
    clusters = components(group_links(stage(cells(reps), "cells"), points, bounded(percent), CELL_SETS))
    sizes = reps.groupBy(F.col("doc_id").alias("node")).agg(F.max("n").alias("weight"))
    placed = stage(dealt(clusters.join(sizes, "node"), block_shingles), "clusters")
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    found = components(group_links(placed, texts, verified(width, percent), block_shingles))
    labelled = first.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "c1", "c2", F.coalesce("label", "rep").alias("component"))
    out = thin.join(labelled, ["n", "c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one document of each class, that with the smallest id; rows without an id stay."""
    keep = near_duplicates(docs, id_col, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("__nd_id")).distinct()
    same = F.col(id_col).cast("long") == F.col("__nd_id")
    return docs.filter(F.col(id_col).isNull()).unionByName(docs.join(keep, same, "left_semi"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=4, percent=85)


QUERIES = {"op9_ngram_jaccard": op9_ngram_jaccard}
SQL = {
    "op9_ngram_jaccard": r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
           WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM tokens
),
sets AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM shingles) GROUP BY s),
items AS (SELECT rep, n, unnest(s) AS k FROM sets),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.k = b.k AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT rep AS node, rep AS label FROM sets
  UNION
  SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node WHERE r.label < l.b
),
labels_of AS (SELECT node, min(label) AS label FROM reach GROUP BY node)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles,
       CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE o.label END AS component_id
FROM (SELECT doc_id, list_sort(s) AS s FROM shingles) d
LEFT JOIN sets x ON x.s = d.s
LEFT JOIN labels_of o ON o.node = x.rep
"""
}
