"""Token counts by a linear longest-match automaton, without building the tokens.

Greedy word pieces: a word, with the mark of a word's start before it, is cut from the left
into the longest pieces of the vocabulary.  The pieces form a trie.  A node that is a piece
pops itself and fails to the root; any other node fails to the node that stands for what is
left of its string once the longest pieces at its start are taken off, and remembers how many
pieces that took.  So one pass over a word's letters, following failure links where the trie
ends and adding up the remembered counts, gives the number of pieces in linear time.

A word that can't be cut is one unknown token.  Words are parted by ASCII white space; counts
of the words seen first are kept by each worker up to a bound.

Defined results: null and empty texts have no words and no tokens; rows without an id and
repeated rows are counted each; bytes that are no UTF-8 are read as replacement letters; extra
columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import common

START = "▁"
UNKNOWN = 1 << 32  # added to the count of a word that can't be cut


class Automaton:
    """Trie with failure links and counts of popped pieces."""

    def __init__(self, pieces: Iterable[str], start: str = START):
        self.start = start
        self.next: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for letter in piece:
                node = self.next[node].setdefault(letter, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    whole.append(False)
            whole[node] = node > 0
        self.fail: list[int | None] = [None] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for letter, node in self.next[parent].items():
                queue.append(node)
                if whole[node]:
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at is not None and letter not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at is not None:
                    self.fail[node], self.pops[node] = self.next[at][letter], popped

    def count(self, word: str) -> int:
        """Pieces of a word, or 1 + UNKNOWN."""
        nxt, fail, pops, node, n = self.next, self.fail, self.pops, 0, 0
        for letter in self.start + word:
            while letter not in nxt[node]:
                if fail[node] is None:
                    return 1 + UNKNOWN
                n += pops[node]
                node = fail[node]
            node = nxt[node][letter]
        while node:
            if fail[node] is None:
                return 1 + UNKNOWN
            n += pops[node]
            node = fail[node]
        return n


class WordCounts(dict):
    """Counts of words; those of the first CACHE_WORDS words are kept."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode("utf-8", "replace"))
        if len(self) < common.CACHE_WORDS:
            self[word] = n
        return n


def vocabulary(path: str) -> list[str]:
    """The text pieces of a sentence-piece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


_KNOWN: dict[str, WordCounts] = {}  # one per vocabulary, kept by a worker from task to task


def counts_of(path: str) -> WordCounts:
    if path not in _KNOWN:
        _KNOWN[path] = WordCounts(Automaton(vocabulary(path)))
    return _KNOWN[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) per row of docs."""
    common.small_batches(docs.sparkSession)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_tokens", "n_unknown")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                words = [t.split() for t in common.as_bytes(part.column(1))]
                n = np.array([len(w) for w in words], np.int64)
                values = np.fromiter((x for w in words for x in map(known.__getitem__, w)), np.int64, n.sum())
                sums = np.concatenate([[0], np.cumsum(values)])
                ends = np.cumsum(n)
                both = sums[ends] - sums[ends - n]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(both % UNKNOWN), pa.array(both // UNKNOWN)], schema=schema)

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
