"""Toxicity classifier: subword bags averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character 3-, 4- and 5-grams (with its ends marked),
hashed into 2^BITS buckets, so a misspelling that was never seen shares most of its vectors
with its kin.  A text is cut into segments of SEGMENT words; a segment is the mean of its
words, and a softmax over two classes gives its probability.  A text scores as its worst
segment, so a few toxic words count the same in a short text and in a very long one.

Vectors and softmax weights are trained together by Adam on labelled texts; a text's loss is
that of its segments, weighted towards the worst.  Training starts from log ratios of n-gram
counts.  At most SAMPLE texts of each class are used, those with the smallest hashes of their
ids, and of these, in that order, those with which the class stays within SAMPLE_BYTES, so the
driver's memory is bounded; nothing else is, and every text is scored whole.

When scoring, the model collapses to one number per bucket (the difference of the two
logits), so a word is a number, and a worker keeps the numbers of frequent words.

Defined results: null and empty texts score as an empty segment; without labelled rows of
both classes every score is the share of toxic labels (0 without labels); rows without an id
are scored and never trained on; equal rows score equally; labels that repeat an id count as
toxic if any does; of texts that repeat an id the first in order is trained on; bytes that are
no UTF-8 are read as replacement letters; extra columns are carried, added ones start with __tx_.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstone.llm import common

BITS, NGRAMS, WIDTH = 17, (3, 4, 5), 6
SEGMENT = 3
SAMPLE = 1500
SAMPLE_BYTES = 16 << 20
ROUNDS = 40
#: Steps for the vectors, the softmax weights and the biases.
STEP, DAMPING = (0.2, 0.1, 0.1), 0.05
SCALE, SMOOTHING = 8.0, 3.0
#: How sharply a text stands by its worst segments.
SHARPNESS = 2.0
FOLDS = 5
WORDS_AT_ONCE = 10_000  # whose n-grams are hashed together


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram; letters are code points, A-Z lower-cased."""
    text = "\x02" + "\x03\x02".join([w.decode("utf-8", "replace") for w in words]) + "\x03"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint64(32), codes)
    word = np.cumsum(codes == 2) - 1  # words hold no control characters below 9 as first letters
    lengths = np.array([len(w.decode("utf-8", "replace")) + 2 for w in words])
    if lengths.sum() == len(codes):
        word = np.repeat(np.arange(len(words)), lengths)
    owners, buckets = [], []
    for n in NGRAMS:
        if len(codes) < n:
            continue
        inside = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :])
        h = common.rolling(codes, n, 0x9E3779B97F4A7C15 + 2 * n)[inside]
        owners.append(word[inside].astype(np.int32))
        buckets.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    """One number per bucket, and one for all texts; or a constant where nothing can be learnt."""

    weights: np.ndarray
    bias: float
    constant: float | None = None

    def words(self, words: list[bytes]) -> np.ndarray:
        owner, bucket = subwords(words)
        count = np.bincount(owner, minlength=len(words))
        return np.bincount(owner, weights=self.weights[bucket], minlength=len(words)) / np.maximum(count, 1)


class Sparse:
    """A fixed sparse pattern, for sums over rows and over columns without loops."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int):
        self.count = np.maximum(np.bincount(rows, minlength=n_rows), 1).astype(np.float32)[:, None]
        self.by_row, self.by_column = self._order(rows, columns, n_rows), self._order(columns, rows, n_columns)

    @staticmethod
    def _order(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        packed = keys.astype(np.int64)  # key above value, sorted in place: a pair takes 8 bytes and no more
        packed <<= 32
        packed |= values
        packed.sort()
        high, low = packed.view(np.int32)[1::2], packed.view(np.int32)[::2]
        first = np.flatnonzero(np.append(True, high[1:] != high[:-1])[: len(high)])
        return low.copy(), high[first], first, n

    @staticmethod
    def _sums(order: tuple, x: np.ndarray) -> np.ndarray:
        values, found, first, n = order
        out = np.zeros((n, x.shape[1]), np.float32)
        for j in range(x.shape[1] if len(found) else 0):  # a column at a time, for memory
            out[found, j] = np.add.reduceat(x[:, j][values], first)
        return out

    def means(self, x: np.ndarray) -> np.ndarray:
        return self._sums(self.by_row, x) / self.count

    def sums_by_column(self, x: np.ndarray) -> np.ndarray:
        return self._sums(self.by_column, x)

    def back(self, grad: np.ndarray) -> np.ndarray:
        return self._sums(self.by_column, grad / self.count)


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Train on whole texts; the same input gives the same model."""
    if not 0 < labels.sum() < len(labels):
        return Model(np.zeros(1 << BITS, np.float32), 0.0, float(labels.mean()) if len(labels) else 0.0)
    index: dict[bytes, int] = {}
    ids = [np.fromiter((index.setdefault(w, len(index)) for w in text.lower().split()), np.int32) for text in texts]
    n = np.array([len(x) for x in ids], np.int64)
    sequence = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    del texts, ids
    parts = np.maximum(1, -(-n // SEGMENT))
    n_segments, inner = int(parts.sum()), np.arange(len(sequence)) - np.repeat(np.cumsum(n) - n, n)
    segment = (np.repeat(np.cumsum(parts) - parts, n) + inner // SEGMENT).astype(np.int32)
    # one more text, empty and clean
    labels, owner = np.append(labels, 0), np.append(np.repeat(np.arange(len(n), dtype=np.int32), parts), np.int32(len(n)))
    if not index:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, float(labels.mean()))
    y, first = labels[owner].astype(np.float32), np.flatnonzero(np.diff(owner, prepend=-1))  # every text has a segment
    words = list(index)
    del index
    owners, buckets = [], []
    for at in range(0, len(words), WORDS_AT_ONCE):
        of, bucket = subwords(words[at : at + WORDS_AT_ONCE])
        owners.append(of + np.int32(at))
        buckets.append(bucket)
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    grams = Sparse(owners, buckets, len(words), 1 << BITS)
    del owners, buckets
    bags = Sparse(segment, sequence, n_segments + 1, len(words))
    share = np.where(labels == 1, 1 / labels.sum(), 1 / (len(labels) - labels.sum()))
    rng = np.random.default_rng(7)
    params = [rng.normal(0, 0.01, (1 << BITS, WIDTH)).astype(np.float32), rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32), np.array([[1.0, -1.0]], np.float32)]
    params[0][:, 0] = first_vectors(grams, owner[segment], sequence, labels)
    params[1][0] = (-SCALE / 2, SCALE / 2)
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        # means and softmax odds are linear: one column passes through them instead of WIDTH, in both directions
        tilt = params[1][:, 1:] - params[1][:, :1]
        odds = (bags.means(grams.means(params[0] @ tilt)) + (params[2][0, 1] - params[2][0, 0]))[:, 0]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        worst = np.maximum.reduceat(odds, first)
        weight = np.exp(np.clip(SHARPNESS * (odds - worst[owner]), -30, 0))
        weight *= share[owner] / np.bincount(owner, weights=weight)[owner]
        g = (weight * (p - y) / 2).astype(np.float32)
        back = grams.back(bags.back(g[:, None]))  # of the odds, by bucket
        d_softmax, d_bias = params[0].T @ back, g.sum()
        grads = [back @ tilt.T, np.hstack([-d_softmax, d_softmax]), np.array([[-d_bias, d_bias]], np.float32)]
        for i, grad in enumerate(grads):
            mean[i] += 0.1 * (grad - mean[i])
            square[i] += 0.01 * (grad * grad - square[i])
            size = np.sqrt(square[i] / (1 - 0.99**t)) + 1e-8
            if i == 0:  # vectors with small gradients, those of rare n-grams, move little
                size += DAMPING * float(np.abs(grad).max())
            params[i] -= STEP[i] * (mean[i] / (1 - 0.9**t)) / size
    difference = params[1][:, 1] - params[1][:, 0]
    return Model((params[0] @ difference).astype(np.float32), float(params[2][0, 1] - params[2][0, 0]))


def first_vectors(grams: Sparse, owner: np.ndarray, word: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Where training starts: log ratio of an n-gram's smoothed counts in toxic and clean texts."""
    n_words = len(grams.count)
    pairs = np.unique(owner.astype(np.int64) * n_words + word)
    toxic = labels[pairs // n_words] == 1
    counts = np.stack([np.bincount(pairs[side] % n_words, minlength=n_words) for side in (~toxic, toxic)], axis=1).astype(np.float32)
    counts = grams.sums_by_column(counts)
    total = counts.sum(axis=0) + 1
    return np.log((counts[:, 1] + SMOOTHING) / total[1]) - np.log((counts[:, 0] + SMOOTHING) / total[0])


class WordScores(dict):
    """Numbers of words, kept up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def score(self, texts: list[bytes]) -> list[float]:
        if self.model.constant is not None:
            return [self.model.constant] * len(texts)
        words = [t.lower().split() for t in texts]
        fresh = list({w for ws in words for w in ws if w not in self})
        if fresh:
            self.update(zip(fresh, self.model.words(fresh).tolist(), strict=True))
        n = np.array([len(ws) for ws in words])
        flat = np.fromiter((x for ws in words for x in map(self.__getitem__, ws)), np.float64, n.sum())
        parts = np.maximum(1, -(-n // SEGMENT))
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        lo = np.repeat(start, parts) + inner * SEGMENT
        hi = np.minimum(lo + SEGMENT, np.repeat(start + n, parts))
        sums = np.concatenate([[0.0], np.cumsum(flat)])
        odds = (sums[hi] - sums[lo]) / np.maximum(hi - lo, 1) + self.model.bias
        worst = np.maximum.reduceat(odds, np.cumsum(parts) - parts) if len(n) else odds
        if len(self) > common.CACHE_WORDS:
            for w in fresh:
                del self[w]
        return (1 / (1 + np.exp(-np.clip(worst, -60, 60)))).round(9).tolist()


_KNOWN: dict[bytes, WordScores] = {}  # that of the last model, kept by a worker from task to task


def scores_of(model: Model, name: bytes) -> WordScores:
    if name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name] = WordScores(model)
    return _KNOWN[name]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int | None = None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most sample texts and sample_bytes of each class; with folds, rows of fold 0 are left out."""
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("__tx_id")).agg(F.max(label_col).alias("__tx_label"))
    if folds:
        ids = ids.filter(F.crc32(F.col("__tx_id").cast("string").cast("binary")) % folds != 0)
    order = (F.xxhash64("__tx_id"), F.col("__tx_id"))
    few = [ids.filter(F.col("__tx_label") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]))  # at most 2 * sample rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("__tx_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__tx_text")).join(chosen, "__tx_id")
    # lengths first: a text beyond the bound never leaves its task
    sizes = texts.withColumn("__tx_size", F.octet_length("__tx_text")).filter(F.col("__tx_size") <= sample_bytes)
    rows = sizes.groupBy("__tx_id", "__tx_label").agg(F.min(F.struct("__tx_text", "__tx_size")).alias("t")).select("__tx_id", "__tx_label", "t.__tx_text", "t.__tx_size")
    upto = W.partitionBy("__tx_label").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)  # over sample rows
    rows = rows.withColumn("__tx_sum", F.sum("__tx_size").over(upto)).filter(F.col("__tx_sum") <= sample_bytes)
    rows = rows.orderBy(*order).select("__tx_text", "__tx_label").collect()  # at most 2 * sample texts, 2 * sample_bytes
    kinds = np.array([r["__tx_label"] for r in rows], np.int64)
    return fit([rows.pop(0)["__tx_text"].encode() for _ in range(len(rows))], kinds)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with __tx_score."""
    common.small_batches(docs.sparkSession)
    names, name = docs.columns, hashlib.sha256(model.weights.tobytes() + repr((model.bias, model.constant)).encode()).digest()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scores_of(model, name)
        at = names.index(text_col)
        for batch in batches:
            out: list[float] = []
            for lo in range(0, batch.num_rows, 500):
                out += known.score(common.as_bytes(batch.column(at).slice(lo, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, "__tx_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField("__tx_score", DoubleType())]))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold."""
    return scored(docs, model, text_col).filter(F.col("__tx_score") < threshold).drop("__tx_score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    out = scored(docs, train(docs, labels, folds=FOLDS))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("__tx_score").alias("score"), (F.col("__tx_score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
