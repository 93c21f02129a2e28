"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a white-space separated run with the word mark in front. The
distinct pre-tokens of a batch go into one trie; each trie node keeps the
best unigram score of any segmentation of the string from the root to it (the
forward score) and the number of pieces of that segmentation, so a prefix that
many pre-tokens share is scored once. A document's count is the sum of the
counts stored at its terminals.

A piece's score is the logarithm of its share of the corpus (with one more of
each piece, so that none is impossible), estimated in a first pass over all
documents, each pre-token cut by the vocabulary's own merges. What is collected
are the counts of the vocabulary's pieces, a bound that doesn't grow with the
data. A character may also be written as the pieces of its UTF-8 bytes. Ties go
to fewer pieces, then to the longer last piece.

Defined results: a null or empty text, or one of white space only, has 0
pre-tokens and 0 tokens; a null ``doc_id`` stays null; every row is counted,
repeated ones too; a text, or a pre-token, of any length is counted whole; an
empty table gives no row. Only ``doc_id`` and ``text`` are read, so other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, starts_of, table

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Nodes of the trie that a worker keeps before it starts afresh; results don't depend on it.
MAX_NODES = 500_000
COUNTS = "doc_id bigint, n_pretokens bigint, n_tokens bigint"
SHAPE = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> sentencepiece.SentencePieceProcessor:
    """The vocabulary of a worker process, kept between its tasks."""
    return sentencepiece.SentencePieceProcessor(model_file=path)


def pretokens(texts: pa.Array) -> tuple[pa.Array, pa.DictionaryArray]:
    """The pre-tokens of each text as a list, and all of them in a row with their distinct values."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    return split, pc.dictionary_encode(split.flatten())


def piece_counts(docs: DataFrame, vocabulary: str) -> np.ndarray:
    """How often each piece of the vocabulary stands in ``docs``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary_of(vocabulary)
        total = np.zeros(model.get_piece_size(), np.int64)
        for part in byte_chunks(batches, 0, 16_000_000):
            _, coded = pretokens(part.column(0))
            often = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)) if len(coded) else np.empty(0, np.int64)
            ids = model.encode(coded.dictionary.to_pylist(), num_threads=1)
            flat = np.fromiter((i for x in ids for i in x), np.int64)
            np.add.at(total, flat, np.repeat(often, [len(x) for x in ids]))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

    total = np.zeros(vocabulary_of(vocabulary).get_piece_size(), np.int64)
    for row in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(kernel, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        total[row.piece] = row.n
    return total


def unigram(path: str, counts: np.ndarray) -> tuple[dict[str, float], list[float]]:
    """The score of every ordinary piece, and those of the 256 bytes."""
    model = vocabulary_of(path)
    scores = np.log((counts + 1) / (counts.sum() + len(counts))).tolist()
    odd = [i for i in range(len(scores)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)]
    pieces = {model.id_to_piece(i): scores[i] for i in sorted(set(range(len(scores))) - set(odd))}
    return pieces, [scores[model.piece_to_id(f"<0x{b:02X}>")] for b in range(256)]


class Counter:
    """Distinct pre-tokens in a trie: each node with the forward score and the pieces of the string that leads to it.

    ``ending`` is a trie of the vocabulary read backwards, in which one walk
    from a character to the left meets every piece that ends there. A leaf key
    of ``""`` holds the score.
    """

    def __init__(self, scores: dict[str, float], of_bytes: list[float]):
        self.ending: dict = {}
        for piece, score in scores.items():
            node = self.ending
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[""] = score
        self.of_bytes = of_bytes
        self.start()

    def start(self) -> None:
        """An empty trie. A child is found by its parent's number and its character."""
        self.child: dict[int, int] = {}
        self.forward, self.pieces = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text."""
        split, coded = pretokens(texts)
        distinct = coded.dictionary.to_pylist()
        if len(self.forward) > MAX_NODES:
            self.start()
        for pretoken in distinct:
            if pretoken and pretoken not in self.terminal:
                self.insert(pretoken)
        get = self.terminal.get
        of = np.fromiter((get(x, 0) for x in distinct), np.int64, len(distinct))
        each = of[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
        ends = starts_of(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return tuple(np.diff(starts_of(x)[ends]) for x in (each > 0, each))

    def insert(self, pretoken: str) -> None:
        """Walk down the trie; nodes that aren't there yet are made and scored from those above them."""
        child, forward, pieces, ending, text, path = self.child, self.forward, self.pieces, self.ending, MARK + pretoken, [0]
        for end, char in enumerate(text):
            key = path[-1] << 21 | ord(char)
            at = child.get(key)
            if at is None:
                spelt = char.encode("utf-8", "surrogatepass")
                best, fewest = forward[path[-1]] + sum(map(self.of_bytes.__getitem__, spelt)), pieces[path[-1]] + len(spelt)
                node, start = ending, end
                while start >= 0:
                    node = node.get(text[start])
                    if node is None:
                        break
                    if "" in node:
                        above = path[start]
                        score, n = forward[above] + node[""], pieces[above] + 1
                        if score > best or score == best and n <= fewest:
                            best, fewest = score, n
                    start -= 1
                at = child[key] = len(forward)
                forward.append(best)
                pieces.append(fewest)
            path.append(at)
        self.terminal[pretoken] = pieces[path[-1]]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, pre-tokens and tokens of every row of ``docs``: a pass for the scores, and one for the counts."""
    shared = docs.sparkSession.sparkContext.broadcast(unigram(vocabulary, piece_counts(docs, vocabulary)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter(*shared.value)
        for part in byte_chunks(batches, most=16_000_000):
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, own.count(part.column(1)))], schema=SHAPE)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, COUNTS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
