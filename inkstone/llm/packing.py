"""Best-fit packing of token sequences (hierarchical residual packing).

Each task tokenises its documents and packs their pieces by best-fit decreasing.  Bins that
are nearly full are final.  The underfull ones become items themselves: they are dealt anew to
an eighth of the tasks, packed by best fit, and so on up a tree, each round with another deal.
The root packs all that is left, whatever its number: bins of one fill are alike, so best fit
runs over the counts of the fills (LIMIT classes at most), and the ranks of the bins in their
class, taken in parallel, tell where each goes.  Only (bin, fill) pairs move up the tree;
pieces stay where they were written and learn their final sequence through a join on the bin.

Defined results: a null or empty text is a document of the end id alone; equal rows are
packed once each; a null id is carried through; an empty table gives no rows; bytes that are no
UTF-8 are read as replacement letters; columns of the input other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.llm import common
from inkstone.plans.staging import drop, stage

LIMIT = 2048
END_ID = 0
#: A bin with at most this share of its tokens free is final in the round that made it.
SLACK = 1 / 128
#: Underfull bins that one task packs in a round of the tree.
ITEMS_PER_TASK = 100_000
FAN_IN = 8

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"
ROUND = "bin long, parent long, base long, fill long"


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing.  Returns each item's bin and place in it, and the bins' fills.

    Open bins are stacked by free space; a bit mask of the occupied stacks gives the
    tightest bin that holds an item in a few integer operations.
    """
    order = np.argsort(-lengths, kind="stable")
    where, at, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = 0
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = mask >> length
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + length
            b = stacks[free].pop()
            if not stacks[free]:
                mask ^= 1 << free
        else:
            free, b = limit, len(fills)
            fills.append(0)
        where[i], at[i] = b, fills[b]
        fills[b] += length
        left = free - length
        if left:
            stacks[left].append(b)
            mask |= 1 << left
    return where, at, np.array(fills, np.int64)


#: A word and one mark behind its last letter or digit: the tokenizer parts the two.
MARKED = re.compile(rb"[^<]*(?:[a-z0-9]|\xc3[\xa0-\xb6\xb8-\xbf])[.,;:!?]\Z")
#: Chunks that a worker keeps (about 80 MB); the first seen stay, as they are the frequent ones.
CACHE_CHUNKS = 400_000


class TokenIds:
    """Token ids, as bytes, of chunks between ASCII white space.

    The tokenizer lower-cases, and its rules never join what white space parts, so a text's
    ids are those of its lower-cased chunks in order, and frequent chunks are encoded once.
    Chunks of letters only give one token with a word's end each, so many of them are encoded
    as one text and cut after these tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only hold memory
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.fresh = Tokenizer.from_file(path), {}, set()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    @staticmethod
    def chunks(text: bytes) -> list[bytes]:
        """Chunks of a text; one that may hold a special token's string keeps its case."""
        return text.split() if b"<|" in text else text.lower().split()

    def learn(self, texts: list[list[bytes]]) -> None:
        known = self.known
        self.fresh = set().union(*texts).difference(known)
        marked = [w for w in self.fresh if MARKED.match(w)]
        if marked:  # the word's ids and then the mark's
            self.fresh.update({w[:-1] for w in marked}.difference(known), {w[-1:] for w in marked}.difference(known))
            self._encode([w for w in self.fresh if not MARKED.match(w)])
            known.update((w, known[w[:-1]] + known[w[-1:]]) for w in marked)
        else:
            self._encode(list(self.fresh))

    def _encode(self, words: list[bytes]) -> None:
        known, encode = self.known, self.tokenizer.encode_batch_fast
        plain = [w for w in words if w.decode("utf-8", "replace").isalpha()]
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = np.array(encode([b" ".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) == len(part):  # else a letter was normalised to something else
                raw, start = ids.tobytes(), 0
                for word, cut in zip(part, cuts, strict=True):
                    known[word] = raw[4 * start : 4 * cut]
                    start = cut
        other = [w for w in words if w not in known]
        for word, e in zip(other, encode([w.decode("utf-8", "replace") for w in other], add_special_tokens=False), strict=True):
            known[word] = np.array(e.ids, "<u4").tobytes()

    def forget(self) -> None:
        """Drop what was learnt last if the cache is full."""
        if len(self.known) > CACHE_CHUNKS:
            for word in self.fresh:
                del self.known[word]
        self.fresh = set()

    def ids(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


_KNOWN: dict[str, TokenIds] = {}  # kept by a worker from task to task


def tokenised(batches: Iterator[pa.RecordBatch], path: str, end_id: int, limit: int) -> Iterator[tuple[list, list, list, list, list]]:
    """Pieces of at most limit tokens: document, number, start, length, checksum."""
    if path not in _KNOWN:
        _KNOWN[path] = TokenIds(path)
    known, end = _KNOWN[path], end_id.to_bytes(4, "little")
    for batch in batches:
        for lo in range(0, batch.num_rows, 600):
            part = batch.slice(lo, 600)
            texts = [known.chunks(b) for b in common.as_bytes(part.column(1))]
            known.learn(texts)
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for doc, words in zip(part.column(0).to_pylist(), texts, strict=True):
                ids = memoryview(known.ids(words) + end)
                for piece, start in enumerate(range(0, len(ids) // 4, limit)):
                    cut = ids[4 * start : 4 * (start + limit)]
                    for column, value in zip(out, (doc, piece, start, len(cut) // 4, zlib.crc32(cut)), strict=True):
                        column.append(value)
            known.forget()
            yield out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """One row per piece: where it starts in its document and where it lies in which sequence."""
    common.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "bin", "at", "fill"))])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], [], []]
        for part in tokenised(batches, tokenizer, end_id, limit):
            for column, more in zip(columns, part, strict=True):
                column += more
        where, at, fills = best_fit(np.array(columns[3], np.int64), limit)
        first = TaskContext.get().partitionId() << 32
        named = dict(zip(schema.names[:5], columns, strict=True)) | {"bin": where + first, "at": at, "fill": fills[where]}
        yield from common.batches_of(schema, named)

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stage(thin.mapInArrow(local, PIECE), "pieces")
    full = F.col("fill") >= limit - int(limit * SLACK)
    moved = merged(pieces.filter(~full).groupBy("bin").agg(F.max("fill").alias("fill")), limit, items_per_task)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    still = pieces.filter(full).select(*columns, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return still.unionByName(pieces.filter(~full).join(moved, "bin").select(*columns, F.col("root").alias("sequence_id"), (F.col("at") + F.col("base")).alias("offset")))


def best_fit_counts(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over classes of equal items, given as size to count.

    Returns (size, first rank, first bin, items a bin, place of the first): items from that
    rank on go so many to a bin, into following bins, up to the next entry's rank.
    """
    out: list[tuple[int, int, int, int, int]] = []
    stacks: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]  # by free space, ranges of bins
    mask = bins = 0

    def put(free: int, lo: int, hi: int) -> None:
        nonlocal mask
        if free and lo < hi:
            stacks[free].append((lo, hi))
            mask |= 1 << free

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            fitting = mask >> size
            if not fitting:
                more = -(-left // (limit // size))
                put(limit, bins, bins + more)
                bins += more
                continue
            free = (fitting & -fitting).bit_length() - 1 + size
            lo, hi = stacks[free].pop()
            if not stacks[free]:
                mask ^= 1 << free
            each = min(free // size, left)
            full = min(hi - lo, left // each)
            out.append((size, rank, lo, each, limit - free))
            put(free - each * size, lo, lo + full)
            put(free, lo + full, hi)
            rank, left = rank + full * each, left - full * each
    return out


def rooted(bins: DataFrame, limit: int, items_per_task: int) -> DataFrame:
    """The root: (bin, parent, base) of all bins by best fit over the counts of their fills."""
    buckets = max(1, math.ceil(bins.count() / items_per_task))
    dealt = bins.withColumn("bucket", F.pmod(F.xxhash64("bin"), F.lit(buckets)))
    sums = stage(dealt.groupBy("fill", "bucket").agg(F.count(F.lit(1)).alias("n")), "fills")
    counts = {r.fill: r.n for r in sums.groupBy("fill").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    plan = np.array(sorted(best_fit_counts(counts, limit)), np.int64).reshape(-1, 5)
    before = F.sum("n").over(W.partitionBy("fill").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    ahead = sums.select("fill", "bucket", F.coalesce(before, F.lit(0)).alias("ahead"))
    nth = F.row_number().over(W.partitionBy("fill", "bucket").orderBy("bin")) - 1
    ranked = dealt.withColumn("nth", nth).join(ahead, ["fill", "bucket"]).select("bin", "fill", (F.col("ahead") + F.col("nth")).alias("rank"))
    schema = pa.schema([("bin", pa.int64()), ("parent", pa.int64()), ("base", pa.int64())])
    high = np.int64(max(counts.values(), default=0) + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = plan[:, 0] * high + plan[:, 1]
        for batch in batches:
            name, fill, rank = (batch.column(i).to_numpy() for i in range(3))
            _, first, head, each, base = plan[np.searchsorted(starts, fill * high + rank, side="right") - 1].T
            inner = rank - first
            # bins of the root are numbered downwards from -1, apart from those of the tasks
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(-1 - head - inner // each), pa.array(base + inner % each * fill)], schema=schema)

    return ranked.mapInArrow(place, "bin long, parent long, base long")


def merged(bins: DataFrame, limit: int, items_per_task: int) -> DataFrame:
    """The tree: from (bin, fill) to (bin, root, base), the sequence and place of each bin."""
    bins = stage(bins, "underfull")
    moved = bins.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("base"))

    def lifted(step: DataFrame) -> DataFrame:
        by_root = moved.join(step.select(F.col("bin").alias("root"), "parent", F.col("base").alias("more")), "root", "left")
        return stage(by_root.select("bin", F.coalesce("parent", "root").alias("root"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")), "moved")

    def again(part: pa.Table) -> pa.Table:
        part = part.sort_by("bin")  # the same result on every attempt
        names, fills = part["bin"].to_numpy(), part["fill"].to_numpy()
        where, at, made = best_fit(fills, limit)
        heads = np.zeros(len(made), np.int64)
        heads[where[at == 0]] = names[at == 0]
        return pa.table({"bin": names, "parent": heads[where], "base": at, "fill": made[where]})

    tasks, level = math.ceil(bins.count() / items_per_task), 0
    while tasks > 1:
        dealt = bins.withColumn("task", F.pmod(F.xxhash64(F.lit(level), "bin"), F.lit(tasks)))
        step = stage(dealt.groupBy("task").applyInArrow(lambda t: again(t), ROUND), "round")
        moved = lifted(step)
        open_bins = step.filter(F.col("fill") < limit - int(limit * SLACK)).groupBy(F.col("parent").alias("bin")).agg(F.max("fill").alias("fill"))
        drop(bins)
        bins, before = stage(open_bins, "underfull"), tasks
        drop(step)
        tasks, level = max(math.ceil(before / FAN_IN), math.ceil(bins.count() / items_per_task)), level + 1
        if tasks >= before:  # too many that fit with none: the root takes any number
            break
    return lifted(rooted(bins, limit, items_per_task))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
SQL: dict[str, str] = {}
