"""Approximate nearest neighbours with a hash-prefix forest.

A tree is an array of long hash strings, sorted: bit i of a vector's string says on which
side of the tree's i-th random hyperplane it lies (the hyperplanes of a tree are orthogonal as
far as the width allows).  Rows whose strings share a prefix stand next to each other, so a
prefix is a range, and a table of where the prefixes of one length start finds it.

A query descends in every tree to a prefix about as long as tells all rows apart.  Its own
prefixes come first; then those that differ in the bits it is least sure of (its distance from
the hyperplane is small), in order of the sum of the squared distances, over all trees
together.  When these are used up, all trees ascend together to shorter prefixes, down to the
empty one.  It stops when enough candidates are found; these are ranked by their exact distance.

Vectors are dealt to blocks of bounded size, each with a forest of its own that is built once;
queries stream past it, so a task holds a block, its forest and a batch of queries.  The
hyperplanes pass through the mean of a bounded sample (MEAN_SAMPLE vectors, those with the
smallest hashes of their ids); every vector is indexed.  The sample only centres the planes.

Every query visits every block: where neighbours are hardly nearer than other vectors, as in
vectors close to random, a prefix tells too little to leave out a block.  Work and the shuffle
of queries are linear in vectors times queries.

Defined results: vectors that are null, all zero, of another length than most of the sample,
or hold null or non-finite values take no part, neither do rows without an id; rows that
repeat an id and vector count once; ties go to the smaller id; with fewer candidates than
asked for, all are returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.llm import common
from inkstone.plans.staging import drop, stage

TREES, BITS = 160, 32
#: Candidates per query and block: at least this many, and this share of the block.
CANDIDATES, SHARE = 800, 0.19
#: Of a prefix the bits a query is least sure of, and how many of them may differ at once.
UNSURE, FLIPS = 10, 3
#: Bits of the deepest prefixes beyond those that number the rows.
DEEPER = 1
BLOCK_ROWS = 8192
MEAN_SAMPLE = 2000
SEED = 20_240_131


def planes(width: int, trees: int = TREES) -> np.ndarray:
    """Unit normals of all hyperplanes; within a tree orthogonal by as many as the width allows."""
    rng, out = np.random.default_rng(SEED), []
    for _ in range(trees):
        normal = rng.standard_normal((-(-BITS // width), width, width))
        out.append(np.concatenate([np.linalg.qr(m)[0] for m in normal], axis=1)[:, :BITS])
    return np.concatenate(out, axis=1)


def masks(bits: int) -> np.ndarray:
    """All choices of at most FLIPS out of bits, as rows of zeros and ones, the empty one first."""
    rows = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    return rows[rows.sum(axis=1) <= FLIPS].astype(np.int64)


class Forest:
    """Sorted arrays of hash strings over the rows of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, mean: np.ndarray, normals: np.ndarray):
        self.ids, self.x, self.mean, self.normals = ids, x, mean, normals
        self.trees, n = normals.shape[1] // BITS, len(ids)
        h = self.strings(self.distances(x))
        self.depth = min(BITS, max(1, int(np.ceil(np.log2(max(n, 2)))) + DEEPER))
        order = np.argsort(h, axis=1, kind="stable")
        self.order = order.astype(np.int32).ravel()
        # where each prefix of this depth starts in its tree's part of order; shorter ones are runs of these
        prefix = (h >> np.uint64(BITS - self.depth)).astype(np.int64) + (np.arange(self.trees) << self.depth)[:, None]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(prefix.ravel(), minlength=self.trees << self.depth))]).astype(np.int32)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """(row, tree, bit) signed distances from the hyperplanes."""
        return ((x - self.mean) @ self.normals).reshape(len(x), self.trees, BITS)

    @staticmethod
    def strings(distances: np.ndarray) -> np.ndarray:
        """(tree, row) hash strings, first bit on top."""
        packed = np.packbits(distances > 0, axis=2)
        return np.ascontiguousarray(packed).view(f">u{BITS // 8}")[:, :, 0].T.astype(np.uint64)

    def ranges(self, distances: np.ndarray, keys: np.ndarray, length: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the prefixes of one length near a query, nearest first, most of them."""
        if length == 0:
            return np.zeros(1, np.int64), np.array([len(self.ids)])
        sure = np.square(distances[:, :length])
        bits = np.argsort(sure, axis=1, kind="stable")[:, :UNSURE]
        flips = masks(bits.shape[1])
        penalty = np.take_along_axis(sure, bits, axis=1) @ flips.T
        change = (1 << (length - 1 - bits)) @ flips.T
        own = (keys >> np.uint64(BITS - length)).astype(np.int64)
        flat = penalty.ravel()
        near = np.argpartition(flat, most)[:most] if most < len(flat) else np.arange(len(flat))
        near = near[np.argsort(flat[near], kind="stable")]
        low = ((own[:, None] ^ change) + (np.arange(self.trees) << length)[:, None]).ravel()[near]
        rest = self.depth - length
        return self.starts[low << rest], self.starts[(low + 1) << rest]

    def candidates(self, distances: np.ndarray, keys: np.ndarray, wanted: int) -> np.ndarray:
        """Rows for one query: descend, look around, then ascend in all trees together."""
        n = len(self.ids)
        place = np.full(n, -1, np.int64)  # in which order a row was found
        have = np.zeros(0, np.int64)
        for length in [*range(self.depth, 0, -2), 0]:
            lo, hi = self.ranges(distances, keys, length, 4 * wanted)
            size = hi - lo
            lo, size = lo[size > 0].astype(np.int64), size[size > 0]
            if len(size):
                at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
                have = np.concatenate([have, self.order[at]])
                place[have[::-1]] = np.arange(len(have))[::-1]
            found = np.flatnonzero(place >= 0)
            if len(found) >= min(wanted, n):
                return found[np.argpartition(place[found], wanted - 1)[:wanted]] if len(found) > wanted else found
            have = found[np.argsort(place[found])]
        return found

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, k: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest candidates of each query: query, id, distance."""
        out: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(q), 64):
            distances = self.distances(q[at : at + 64])
            keys = self.strings(distances)
            for i, query in enumerate(query_ids[at : at + 64].tolist()):
                rows = self.candidates(distances[i], keys[:, i], wanted)
                rows = rows[self.ids[rows] != query]
                d = np.sqrt(np.square(self.x[rows] - q[at + i]).sum(axis=1))
                best = np.lexsort((self.ids[rows], d))[:k]
                out[0].append(np.full(len(best), query))
                out[1].append(self.ids[rows][best])
                out[2].append(d[best])
        return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(good)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, candidates: int = CANDIDATES, share: float = SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (rows as of vectors) against all vectors."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = stage(usable(vectors, id_col, vector_col).distinct(), "vectors")
    asked = stage(usable(queries, id_col, vector_col).distinct(), "queries")
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEAN_SAMPLE).select("v").collect()  # bounded
    if not few:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = np.array([len(r.v) for r in few])
    width = int(np.bincount(lengths).argmax())
    mean = np.mean([r.v for r in few if len(r.v) == width], axis=0)
    rows, asked = (df.filter(F.size("v") == width) for df in (rows, asked))
    blocks = max(1, -(-rows.count() // block_rows))
    left = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "vec_id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "vec_id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, forest, block, held = None, None, None, ([], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            normals = planes(width, trees) if normals is None else normals
            of, query, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(-1, width)
            for b in np.unique(of).tolist():
                if b != block:  # a block's vectors come first, then the queries that pass by it
                    block, forest, held = b, None, ([], [])
                mine = (of == b) & ~query
                if mine.any():
                    held[0].append(ids[mine])
                    held[1].append(x[mine])
                asks = (of == b) & query
                if not asks.any() or not held[0]:
                    continue
                if forest is None:
                    forest = Forest(np.concatenate(held[0]), np.concatenate(held[1]), mean, normals)
                out = forest.nearest(ids[asks], x[asks], k, max(candidates, int(share * len(forest.ids))))
                yield from common.batches_of(schema, dict(zip(schema.names, out, strict=True)))

    dealt = left.unionByName(right).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "query", "vec_id")
    found = stage(dealt.mapInArrow(search, "query_id long, vec_id long, score double"), "found")
    drop(rows)
    drop(asked)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


QUERIES = {"op10_hash_prefix_forest": op10_hash_prefix_forest}
SQL: dict[str, str] = {}
