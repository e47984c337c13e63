"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters, for trim functions.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that a worker's cache may hold (about 35 MB); the first seen stay, as they are the frequent ones.
CACHE_WORDS = 200_000
#: Bytes of an Arrow batch (a single longer row makes a batch of its own).
BATCH_MB = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, megabytes: int = BATCH_MB) -> None:
    """Bound the bytes of an Arrow batch, so that long texts can't make batches of gigabytes.

    Plans run after the operator that asks for this returns, so the setting stays; it is only
    ever lowered and changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-") or 0) if spark.conf.get(key).endswith("b") else None
    if now is None or not 0 < now <= megabytes << 20:
        spark.conf.set(key, f"{megabytes << 20}b")


def ascii_lower(column: Column) -> Column:
    """A-Z become a-z; other letters stay."""
    return F.translate(column, UPPER, LOWER)


def n_words(column: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words; those of the first CACHE_WORDS words are kept."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: One per worker process, kept from task to task.
WORD_HASHES = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, width: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of width values; binary doubling, so log2(width) passes."""
    if len(h) < width:
        return h[:0]
    with np.errstate(over="ignore"):
        power, block, size = np.uint64(factor), h, 1  # power = factor ** size
        out, have, bits = None, 0, width
        while bits:
            if bits & 1:
                if out is None:
                    out, have = block, size
                else:
                    n = len(h) - (have + size) + 1
                    out, have = out[:n] * power + block[have : have + n], have + size
            bits >>= 1
            if bits:
                n = len(h) - 2 * size + 1
                block = block[:n] * power + block[size : size + n]
                power, size = power * power, size * 2
        return mixed(out)


def batches_of(schema: pa.Schema, columns: dict, step: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of at most step rows."""
    whole = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
    for at in range(0, max(whole.num_rows, 0), step):
        yield whole.slice(at, step)
