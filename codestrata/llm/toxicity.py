"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores
``p = sigmoid(b + sum of the weights of its distinct words)``, or 0 where no word
of it has a weight, and a document the noisy-or ``1 - prod(1 - p)``. A word's
weight is that of the word and of its beginnings of 4 and 5 letters. Weights are
trained from document labels alone, so the sentence scores then say where the
offence is.

Defined results: a null or empty text has no sentence and scores 0; a null
``doc_id`` is scored like any other but never used for training; a document
with contradicting label rows takes the highest; with no usable labels of
both classes the model is empty and nothing is flagged. Repeated rows are
scored one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fold, give_back, table, text_chunks

SENTENCE = re.compile(r"[^.!?\n]+")
#: Bound on the labelled documents a model is fitted on, half of each class.
TRAIN_DOCS = 8000
#: A document at or over this noisy-or probability is rejected.
THRESHOLD = 0.5
#: A word must be in this many training documents to get a weight.
MIN_DOCS = 3
#: Chi-squared by which a word must be more frequent in toxic documents to get a weight.
MIN_CHI2 = 15.0
#: Log-odds of a sentence at the start of the fit.
START_BIAS = -8.0
#: Smaller weights are dropped from a model.
LEAST_WEIGHT = 0.5
#: Lengths of the beginnings that stand for a word's stem.
STEMS = (4, 5)
#: Characters of words without a weight that a worker remembers; results don't depend on it.
MEMO_CHARS = 3_000_000

SPANS = "doc_id bigint, doc_score double, sentence int, start_char int, end_char int, sentence_score double"


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = 300, l2: float = 1e-4) -> dict[str, int]:
    """Word weights in millionths, the bias under the key ``""``; fitted on at most ``train_docs`` labelled documents.

    The sample takes the lowest hashes of ``doc_id`` in each class, so it is
    the same whatever the partitioning; its ids are broadcast to the scan of the
    texts, which is safe because the parameter bounds them.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("toxic") == c).orderBy(*order).limit(train_docs // 2) for c in (0, 1)]
    sample = F.broadcast(picked[0].unionAll(picked[1]))
    texts = docs.select("doc_id", "text").join(sample, "doc_id")
    rows = texts.select("doc_id", "toxic", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(rows.column("text").to_pylist(), np.array(rows.column("toxic").to_pylist(), float), rounds, l2)


def features(word: str) -> list[str]:
    """The word and, where it is longer, its beginnings, so that unseen forms of a word share what is known of its stem."""
    return [word] + [word[:n] + "*" for n in STEMS if len(word) > n]


def fit(texts: list[str | None], toxic: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> dict[str, int]:
    """Full-batch Adam on the noisy-or log loss with weights of 0 at least; they are whole millionths, so sums don't depend on their order.

    Only words (and beginnings) that the toxic documents have markedly more often take part.
    """
    if not len(toxic) or toxic.min() == toxic.max():
        return {}
    df: Counter[str] = Counter()
    df_toxic: Counter[str] = Counter()
    for text, bad in zip(texts, toxic):
        seen = {f for word in set(WORD.findall(fold(text or ""))) for f in features(word)}
        df.update(seen)
        if bad > 0:
            df_toxic.update(seen)
    names = np.array(sorted(f for f in df_toxic if df[f] >= MIN_DOCS), object)
    total, bad = (np.array([x[f] for f in names], float) for x in (df, df_toxic))
    names = names[association(total, bad, len(texts), toxic.sum()) >= MIN_CHI2]
    if not len(names):
        return {}
    # only sentences with a screened word are kept; others score 0
    column = {f: i for i, f in enumerate(names)}
    of_word: dict[str, list[int]] = {}
    feature_at, sentence_at, sentence_doc = [], [], []
    for i, text in enumerate(texts):
        for sentence in SENTENCE.findall(fold(text or "")):
            n = len(feature_at)
            for word in sorted(set(WORD.findall(sentence))):
                own = of_word.get(word)
                if own is None:
                    own = of_word[word] = [column[f] for f in features(word) if f in column]
                feature_at.extend(own)
            if n < len(feature_at):
                sentence_at.extend([len(sentence_doc)] * (len(feature_at) - n))
                sentence_doc.append(i)
    kept, w, s, d = names, np.array(feature_at), np.array(sentence_at), np.array(sentence_doc)
    weight, bias = np.zeros(len(kept)), START_BIAS
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    share = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum()))
    for t in range(1, rounds + 1):
        z = bias + np.bincount(s, weight[w], len(d))
        bag = np.bincount(d, np.logaddexp(0, z), len(texts))
        pull = np.where(toxic > 0, -1 / np.expm1(np.clip(bag, 1e-6, 50)), 1.0) * share
        g = pull[d] / (1 + np.exp(-z))
        gw, gb = np.bincount(w, g[s], len(kept)) + l2 * weight, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, e = 1 - 0.9**t, 1 - 0.99**t
        rate = 0.15 * min(1, 2 * (1 - t / (rounds + 1)))
        weight = np.maximum(0, weight - rate * (m / c) / (np.sqrt(v / e) + 1e-9))
        bias -= rate * (mb / c) / (np.sqrt(vb / e) + 1e-9)
    return {"": round(bias * 1e6)} | {n: round(x * 1e6) for n, x in zip(names, weight) if x >= LEAST_WEIGHT}


def association(df: np.ndarray, df_toxic: np.ndarray, docs: int, toxic: float) -> np.ndarray:
    """Chi-squared of each word's document counts in the two classes; 0 where the word isn't more frequent in toxic documents."""
    a, b = df_toxic, df - df_toxic
    c, d = toxic - a, docs - toxic - b
    spread = (a + b) * (c + d) * (a + c) * (b + d)
    return np.where((a * d > b * c) & (spread > 0), docs * (a * d - b * c) ** 2 / np.maximum(spread, 1e-9), 0.0)


class Scorer:
    """A model with the words it has met: those with a weight, and those without."""

    def __init__(self, model: dict[str, int]):
        self.model, self.bias = model, model.get("", 0)
        self.weights: dict[str, int] = {}
        self.none: set[str] = set()
        self.held = 0

    def weight(self, word: str) -> int:
        found = self.weights.get(word)
        if found is None:
            found = sum(self.model.get(f, 0) for f in features(word))
            if found:
                self.weights[word] = found
            else:
                self.none.add(word)
                self.held += len(word)
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float, int]]]:
        """The noisy-or probability of a text, and (start, end, probability, number) of each sentence with a weighted word."""
        if not self.model or not text:
            return 0.0, []
        if self.held > MEMO_CHARS:
            self.none.clear()
            self.weights.clear()
            self.held = 0
        low, none, spans, z = fold(text), self.none, [], []
        if not any(map(self.weight, set(WORD.findall(low)) - none)):
            return 0.0, []
        for i, m in enumerate(SENTENCE.finditer(low)):
            own = set(WORD.findall(m.group())) - none
            if own and (total := sum(map(self.weight, own))):
                spans.append((*m.span(), i))
                z.append(self.bias + total)
        zs = np.array(z) / 1e6
        p = 1 / (1 + np.exp(-zs))
        return float(-np.expm1(-np.logaddexp(0, zs).sum())), [(a, b, float(x), i) for (a, b, i), x in zip(spans, p)]


def offending_sentences(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row for each offending sentence of each document at or over ``threshold``.

    A sentence offends when its own probability reaches the threshold; a
    document flagged by many weak sentences reports its worst one (the first on ties).
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_docs))
    shape = pa.schema([("doc_id", pa.int64()), ("doc_score", pa.float64()), ("sentence", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("sentence_score", pa.float64())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part, texts in text_chunks(batches):
            out: list[tuple] = []
            for doc_id, text in zip(part.column(0).to_pylist(), texts):
                total, sentences = scorer.score(text)
                if sentences and total >= threshold:
                    worst = max(sentences, key=lambda x: (x[2], -x[3]))
                    out += [(doc_id, total, i, a, b, p) for a, b, p, i in sentences if p >= threshold or i == worst[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, shape)], schema=shape)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(locate, SPANS)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs``, all columns, whose noisy-or probability is under ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_docs))

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pa.array([scorer.score(t)[0] < threshold for t in texts.to_pylist()], pa.bool_())
        del scorer
        give_back()

    return docs.where(clean(F.col("text").cast("string")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offending_sentences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
