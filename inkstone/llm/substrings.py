"""Removal of repeated word sequences by compaction of a De Bruijn graph.

Every window of SPAN consecutive words is an edge (from its first SPAN - 1 words to its last
SPAN - 1).  An edge that starts at several places is repeated; all its places but the first
are to go.  Following edges of a document that no other document parts from each other are a
nonbranching path, and it is paths that move through the cluster:

1. The anchor of an edge is the least-hashed K-word sequence in it.  Equal edges have equal
   anchors, and about six edges in a row share one.  Documents of the same words are one here
   (the later ones go as a whole), then counts per anchor, partial ones first, find the
   anchors that stand at several places; edges of other anchors are not repeated.
2. A document's edges of one repeated anchor are a path.  A join brings the anchors back to
   the texts, and an exchange on (anchor, path) compacts equal paths: all but the first place
   go as a whole, with that place as source coordinate.
3. Where paths of one anchor differ, the graph branches.  Only there are the first places of
   the paths taken apart into edges, and an exchange on (anchor, edge) finds their sources.
4. What goes is gathered per document, spans whose sources advance in step are joined to long
   repeated spans, and a join with the texts removes the words they cover.

Edges are compared by a 64-bit hash among those of one 64-bit anchor hash.  All passes over
exchanged rows are streams in sorted order that hold one row, whatever the size of a group.

Defined results: null and empty texts have no words; rows that repeat an id and its text are
one document and get the same result; other rows of one id are ordered by a hash of the text;
rows without an id come last, as if theirs were 2^63 - 1, and are never one document with a
row that has it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import common
from inkstone.llm.jaccard import bounds_of, runs
from inkstone.plans.staging import drop, stage

SPAN = 20
K = 8
LAST = 2**63 - 1  # stands for a null id
PIECE_BYTES = 8 << 20  # text that a task takes apart at once
PLACE_BITS = 24  # low bits of a hash that do not count when the least is sought


def leftmost_least(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash in each run of width hashes, the leftmost of equal ones."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    packed = len(grams) <= 1 << PLACE_BITS  # then a place fits into the low bits
    least, place, have = grams & ~low, np.arange(len(grams), dtype=np.uint64), 1
    if packed:
        least |= place
    while have < width:
        step = min(have, width - have)
        if not packed:
            place = np.where(least[step:] < least[:-step], place[step:], place[:-step])
        least = np.minimum(least[:-step], least[step:])
        have += step
    return ((least & low) if packed else place).astype(np.int64)


class Edges:
    """Edges of several documents: where they start, their hashes, their anchors."""

    def __init__(self, texts: list[bytes], span: int, k: int):
        words = [t.split() for t in texts]
        self.n = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.n) - self.n
        flat = common.WORD_HASHES.of([x for w in words for x in w])
        doc = np.repeat(np.arange(len(words)), self.n)
        self.digests = self._digests(flat, doc, len(words))
        k = min(k, span)
        grams, self.hashes = common.rolling(flat, k), common.rolling(flat, span)
        if not len(self.hashes):
            self.starts = self.anchors = self.hash_of_anchor = np.zeros(0, np.int64)
            self.doc = self.starts
            return
        self.starts = np.flatnonzero(doc[: len(self.hashes)] == doc[span - 1 :])
        self.anchors = leftmost_least(grams, span - k + 1)[self.starts]
        self.hashes, self.doc = self.hashes[self.starts], doc[self.starts]
        self.hash_of_anchor = grams[self.anchors]

    @staticmethod
    def _digests(flat: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each document's sequence of words."""
        place = np.arange(len(flat), dtype=np.uint64) - np.searchsorted(doc, doc).astype(np.uint64)
        out = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            values, sums = common.mixed(flat ^ common.mixed(place * np.uint64(seed) + np.uint64(1))), np.zeros(n, np.uint64)
            np.add.at(sums, doc, values)
            out.append(sums.view(np.int64))
        return tuple(out)


def pieces(batch: pa.RecordBatch, text: int, rows: int = 250, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and bytes of text; a longer text is one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        most = (ends[at - 1] if at else 0) + size
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, most, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def anchors(docs: DataFrame, span: int, k: int) -> DataFrame:
    """Per document: words, digests of their sequence, hashes of its anchors, each twice at most."""
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "th", "n", "d1", "d2")), ("anchors", pa.list_(pa.int64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                e = Edges(common.as_bytes(part.column(2)), span, k)
                new = np.ones(len(e.starts), bool)
                new[1:] = e.anchors[1:] != e.anchors[:-1]
                owner, values = e.doc[new], e.hash_of_anchor[new].view(np.int64)
                # two places in a document say all there is to say, so no document heats an anchor
                order = np.lexsort((values, owner))
                owner, values = owner[order], values[order]
                third = np.zeros(len(values), bool)
                third[2:] = (values[2:] == values[:-2]) & (owner[2:] == owner[:-2])
                owner, values = owner[~third], values[~third]
                offsets = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(e.n), pa.array(e.digests[0]), pa.array(e.digests[1]), lists], schema=schema)

    return docs.select("doc_id", "th", "text").mapInArrow(find, "doc_id long, th long, n long, d1 long, d2 long, anchors array<long>")


def repeated(rows: DataFrame) -> DataFrame:
    """The (doc_id, th, anchor) rows whose anchor stands at two places or more.

    Anchors are unique on the counted side, so Spark can split one that very many rows have.
    """
    often = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    return rows.join(often, "anchor", "left_semi")


PATHS = "anchor long, path long, doc_id long, th long, start long, n long, source_doc long, source_start long, deal long, edges array<long>"


def paths(docs: DataFrame, span: int, k: int) -> DataFrame:
    """The paths of repeated anchors; docs has doc_id, th, text, repeated (a list of anchors).

    Of equal paths that a task sees together only the first is still open; the others have it
    as their source and are dealt out by their document, so a path that stands everywhere
    heats no task.
    """
    schema = pa.schema([*((c, pa.int64()) for c in ("anchor", "path", "doc_id", "th", "start", "n", "source_doc", "source_start", "deal")), ("edges", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                e = Edges(common.as_bytes(part.column(2)), span, k)
                lists = part.column(3)
                owner = np.repeat(np.arange(part.num_rows, dtype=np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False))
                of = lambda a, d: common.mixed(a ^ common.mixed(d.astype(np.uint64)))
                ok = np.isin(of(e.hash_of_anchor, e.doc), of(lists.flatten().to_numpy().view(np.uint64), owner))
                starts, at, doc, hashes, a = e.starts[ok], e.anchors[ok], e.doc[ok], e.hashes[ok], e.hash_of_anchor[ok]
                if not len(starts):
                    continue
                lo = bounds_of(at)
                value = common.mixed(hashes ^ common.mixed((at - starts).astype(np.uint64) + np.uint64(77)))
                with np.errstate(over="ignore"):
                    path = np.add.reduceat(value, lo[:-1])
                first = lo[:-1]
                ids, th = part.column(0).to_numpy(), part.column(1).to_numpy()
                key, path = a[first].view(np.int64), path.view(np.int64)
                ids, th, start = ids[doc[first]], th[doc[first]], starts[first] - e.first[doc[first]]
                order = np.lexsort((start, th, ids, path, key))
                head = np.ones(len(order), bool)
                head[1:] = (key[order][1:] != key[order][:-1]) | (path[order][1:] != path[order][:-1])
                at_head = np.flatnonzero(head)
                source = np.empty(len(order), np.int64)
                source[order] = order[np.repeat(at_head, np.diff(np.append(at_head, len(order))))]
                same = (ids == ids[source]) & (th == th[source]) & (start == start[source])
                sizes = np.diff(lo)
                edges = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(same, sizes, 0))]).astype(np.int32)), pa.array(hashes[np.repeat(same, sizes)].view(np.int64)))
                columns = [key, path, ids, th, start, sizes, pa.array(ids[source], mask=same), pa.array(start[source], mask=same), np.where(same, key, common.mixed((ids ^ th).view(np.uint64)).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), edges], schema=schema)

    return docs.select("doc_id", "th", "text", "repeated").mapInArrow(cut, PATHS)


GONE = pa.schema([*((c, pa.int64()) for c in ("doc_id", "th", "start", "n", "source_doc", "source_start")), ("anchor", pa.int64()), ("edge", pa.int64())])
GONE_DDL = "doc_id long, th long, start long, n long, source_doc long, source_start long, anchor long, edge long"


def compacted(rows: DataFrame) -> DataFrame:
    """Places of paths that are not their first, with sources; and, where an anchor has several
    paths, the edges of the first places (rows with an edge)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = None, False  # the last first place, and whether it is known to branch
        for batch in batches:
            if not batch.num_rows:
                continue
            decided = pc.is_valid(batch.column("source_doc"))
            done = batch.filter(decided)
            none = np.zeros(done.num_rows, np.int64)
            yield from common.batches_of(GONE, {c: done.column(c) for c in ("doc_id", "th", "start", "n", "source_doc", "source_start")} | {"anchor": none, "edge": pa.nulls(len(none), pa.int64())})
            batch = batch.filter(pc.invert(decided))
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            a, p, doc, th, start = (table[c].to_numpy() for c in ("anchor", "path", "doc_id", "th", "start"))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
            first = np.flatnonzero(new)
            source = np.repeat(first, np.diff(np.append(first, len(a))))
            later = ~new & ~((doc == doc[source]) & (th == th[source]) & (start == start[source]))
            lengths = table["edges"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            none = np.zeros(int(later.sum()), np.int64)
            yield from common.batches_of(GONE, {"doc_id": doc[later], "th": th[later], "start": start[later], "n": lengths[later], "source_doc": doc[source[later]], "source_start": start[source[later]], "anchor": none, "edge": pa.nulls(len(none), pa.int64())})
            alike = a[first[1:]] == a[first[:-1]]
            branch = np.concatenate([[joined], alike])
            branch[:-1] |= alike
            yield from taken_apart(table, first[:-1][branch[:-1]])
            held, joined = table.slice(int(first[-1]), 1).to_batches()[0], bool(branch[-1])
        if held is not None and joined:
            yield from taken_apart(pa.Table.from_batches([held]), np.zeros(1, np.int64))

    def taken_apart(table: pa.Table, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        part = table.take(pa.array(rows)).combine_chunks()
        lists = part["edges"].combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        spread = lambda c: np.repeat(part[c].to_numpy(), n)
        nulls = pa.nulls(int(n.sum()), pa.int64())
        yield from common.batches_of(GONE, {"doc_id": spread("doc_id"), "th": spread("th"), "start": spread("start") + inner, "n": np.ones(n.sum(), np.int64), "source_doc": nulls, "source_start": nulls, "anchor": spread("anchor"), "edge": lists.flatten()})

    return rows.repartition("deal").sortWithinPartitions("anchor", "path", "doc_id", "th", "start").mapInArrow(stream, GONE_DDL)


def later_edges(rows: DataFrame) -> DataFrame:
    """Places of edges that are not their first, with sources."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key and place of the edge at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            a, edge, doc, th, start = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("anchor", "edge", "doc_id", "th", "start"))
            if held is not None:
                a, edge, doc, th, start = (np.concatenate([[h], c]) for h, c in zip(held, (a, edge, doc, th, start), strict=True))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (edge[1:] != edge[:-1])
            first = np.flatnonzero(new)
            source = np.repeat(first, np.diff(np.append(first, len(a))))
            later = ~new & ~((doc == doc[source]) & (th == th[source]) & (start == start[source]))
            ones = np.ones(int(later.sum()), np.int64)
            yield from common.batches_of(GONE, {"doc_id": doc[later], "th": th[later], "start": start[later], "n": ones, "source_doc": doc[source[later]], "source_start": start[source[later]], "anchor": 0 * ones, "edge": 0 * ones})
            held = [c[first[-1]] for c in (a, edge, doc, th, start)]

    return rows.repartition("anchor", "edge").sortWithinPartitions("anchor", "edge", "doc_id", "th", "start").mapInArrow(stream, GONE_DDL)


def spans(gone: DataFrame) -> DataFrame:
    """Per document the long repeated spans: (start, edges, source_doc, source_start), in order."""
    item = pa.struct([(c, pa.int64()) for c in ("start", "n", "source_doc", "source_start")])
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("spans", pa.list_(item))])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ("doc_id", "th")):
            doc, th, start, n, source, source_start = (part[c].to_numpy() for c in ("doc_id", "th", "start", "n", "source_doc", "source_start"))
            other = np.ones(len(doc), bool)
            other[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
            new = other.copy()  # a span goes on while the next place follows and its source does too
            new[1:] |= (start[1:] != start[:-1] + n[:-1]) | (source[1:] != source[:-1]) | (source_start[1:] != source_start[:-1] + n[:-1])
            lo = np.flatnonzero(new)
            n = np.add.reduceat(n, lo)
            items = pa.StructArray.from_arrays([pa.array(x) for x in (start[lo], n, source[lo], source_start[lo])], fields=list(item))
            heads = np.flatnonzero(other[lo])
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(lo)).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([pa.array(doc[lo][heads]), pa.array(th[lo][heads]), lists], schema=schema)

    ddl = "doc_id long, th long, spans array<struct<start: long, n: long, source_doc: long, source_start: long>>"
    rows = gone.select("doc_id", "th", "start", "n", "source_doc", "source_start")
    return rows.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "start").mapInArrow(join, ddl)


def repeated_spans(docs: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(spans per document, documents whose words stand in an earlier document as a whole).

    docs has doc_id (LAST for null), th and text.
    """
    found = stage(anchors(docs, span, k), "anchors")
    thin = found.filter(F.col("n") >= span).select("doc_id", "th", "n", "d1", "d2")
    first = thin.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "th")).alias("f"))
    first = stage(first.select("n", "d1", "d2", F.col("f.doc_id").alias("doc_id"), F.col("f.th").alias("th")), "first")
    copies = thin.join(first.select("doc_id", "th"), ["doc_id", "th"], "left_anti").select("doc_id", "th").distinct()
    own = found.join(first.select("doc_id", "th"), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    places = own.select("doc_id", "th", F.explode("anchors").alias("anchor"))
    shared = stage(repeated(places).groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("repeated")), "shared")
    rows = stage(compacted(paths(docs.join(shared, ["doc_id", "th"]), span, k)), "paths")
    gone = rows.filter("edge is null").unionByName(later_edges(rows.filter("edge is not null")))
    out = stage(spans(gone), "spans")
    drop(shared)
    drop(rows)
    return out, copies


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of docs; kept words are joined by one space."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).cast("long").isNull().alias("none"))
    # a row without an id is another document than one whose id is LAST
    rows = rows.withColumn("th", F.when(F.col("none"), F.xxhash64(F.lit("none"), "text")).otherwise(F.xxhash64("text")))
    found, copies = repeated_spans(rows, span, k)
    marked = found.select("doc_id", "th", "spans.start", "spans.n", F.lit(False).alias("copy"))
    nothing = F.lit(None).cast("array<bigint>")
    marked = marked.unionByName(copies.select("doc_id", "th", nothing.alias("start"), nothing.alias("n"), F.lit(True).alias("copy")))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                ids, n_words, n_removed, kept = [], [], [], []
                for doc, text, start, n, copy, none in zip(part.column(0).to_pylist(), common.as_bytes(part.column(1)), *(part.column(i).to_pylist() for i in range(2, 6)), strict=True):
                    words = text.split()
                    left = [] if copy else words
                    if start:
                        change = np.zeros(len(words) + 1, np.int64)
                        np.add.at(change, np.array(start), 1)
                        np.add.at(change, np.array(start) + np.array(n) + span - 1, -1)
                        left = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                    ids.append(None if none else doc)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, n_words, n_removed, kept), schema, strict=True)], schema=schema)

    whole = rows.join(marked, ["doc_id", "th"], "left").select("doc_id", "text", "start", "n", "copy", "none")
    return whole.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
SQL = {
    "op5_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
  SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20)
),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS place FROM windows),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS at FROM ranked WHERE place > 1),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS at FROM w),
kept AS (
  SELECT e.doc_id, count(c.at)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY e.at) FILTER (c.at IS NULL) AS text
  FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.at = c.at GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
}
