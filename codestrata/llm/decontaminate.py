"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document, like the segments of a text search
engine: every row is a segment of about a megabyte of text with its sorted terms
and, for each term, the positions at which it stands. So building it moves
nothing between executors, and lists are intersected inside a segment. It is a
table in the shared folder; queries read the columns they need from it.

A query is a benchmark item. Its phrases are all runs of ``PHRASE`` of its words
(the whole item where it is shorter). A phrase is looked up from its rarest
term, by document frequency over the whole corpus: the term's list, moved back
by the term's place in the phrase, is intersected with the moved lists of the
other terms in order of rarity until nothing is left. An item also matches by
proximity where all its distinct terms stand, in any order, in a run of words of
one document that is at most half as long again as the item; the postings of the
rarest term are the places looked at.

Defined results: one row for each run of consecutive phrase matches (``phrase``)
and for the shortest such run of words of each document and item (``proximity``,
the first on ties). Words are those of ``common.words``; positions count from 0,
ends are exclusive. Null or empty texts and items match nothing, and an empty
table on either side gives no row; a null ``doc_id`` or ``item_id`` is reported
as null; every repeated row is reported. A text of any length is one document of
one segment. Only ``doc_id``, ``item_id`` and ``text`` are read, so other
columns may have any names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, discard_but, hash_words, marks, placed, save, saved_paths, starts_of, table, text_chunks

PHRASE = 10
#: Benchmark words handled in one pass over the index; a larger benchmark takes more passes.
PASS_WORDS = 4_000_000

INDEX = "doc_ids array<bigint>, terms binary, doc_counts binary, starts binary, doc_starts binary, positions binary"
MATCHES = "doc_id bigint, item_id bigint, kind string, start_word int, end_word int, n_words int"
INDEX_SHAPE = pa.schema([("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("terms", "doc_counts", "starts", "doc_starts", "positions"))])
MATCH_SHAPE = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("n_words", pa.int32())])


def segment(doc_ids: list[int | None], texts: list[str | None]) -> tuple:
    """One row of the index. ``starts`` are those of each term's run in ``positions``, which count words through the segment."""
    hashes, counts = hash_words(texts)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)[order]
    fresh = new.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    doc_counts = np.add.reduceat(fresh.astype(np.int32), starts) if len(starts) else starts
    arrays = (ordered[starts], doc_counts.astype("<i4"), np.append(starts, len(order)).astype("<i4"), starts_of(counts).astype("<i4"), order.astype("<i4"))
    return (doc_ids, *(x.tobytes() for x in arrays))


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of ``docs`` as a table in the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, most=1_000_000):
            row = segment(part.column(0).to_pylist(), texts)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, INDEX_SHAPE)], schema=INDEX_SHAPE)

    return save(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, INDEX), "index")


class Benchmark:
    """Items with their phrases, ready to look up; ``rarity`` is filled with the terms' document frequencies."""

    def __init__(self, item_ids: list[int | None], texts: list[str | None], phrase: int):
        hashes, counts = hash_words(texts)
        self.vocabulary, flat = np.unique(hashes, return_inverse=True)
        at = starts_of(counts)
        self.items = [(i, flat[a:b]) for i, a, b in zip(item_ids, at[:-1], at[1:]) if b > a]
        self.phrase = phrase
        self.rarity = np.zeros(len(self.vocabulary), np.int64)

    def plan(self) -> None:
        """Order the terms of every phrase by rarity; phrases of one length stand in one matrix."""
        of_length = defaultdict(list)
        for k, (_, terms) in enumerate(self.items):
            n = min(self.phrase, len(terms))
            for offset in range(len(terms) - n + 1):
                of_length[n].append((k, offset, terms[offset : offset + n]))
        self.phrases = []
        for n, rows in sorted(of_length.items()):
            terms = np.array([t for _, _, t in rows])
            order = np.argsort(self.rarity[terms], axis=1, kind="stable")
            self.phrases.append((n, np.array([(k, o) for k, o, _ in rows]), np.take_along_axis(terms, order, 1), order))
        self.rarest = []
        for _, terms in self.items:
            distinct = np.unique(terms)
            self.rarest.append(distinct[np.argsort(self.rarity[distinct], kind="stable")])


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def shortest_cover(lists: list[np.ndarray]) -> tuple[int, int]:
    """The shortest span (first one on ties) with an entry of each of the sorted lists, its end exclusive."""
    places, kinds = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(places, kind="stable")
    places, kinds = places[order].tolist(), kinds[order].tolist()
    held, missing, left, best = [0] * len(lists), len(lists), 0, (1 << 60, 0)
    for place, kind in zip(places, kinds):
        missing -= not held[kind]
        held[kind] += 1
        while held[kinds[left]] > 1:
            held[kinds[left]] -= 1
            left += 1
        if not missing:
            best = min(best, (place + 1 - places[left], places[left]))
    return best[1], best[1] + best[0]


def look_up(benchmark: Benchmark, doc_ids: list, terms: np.ndarray, starts: np.ndarray, doc_starts: np.ndarray, positions: np.ndarray) -> list[tuple]:
    """All matches of the benchmark in one segment."""
    if not len(terms) or not len(benchmark.vocabulary):
        return []
    at = np.minimum(np.searchsorted(terms, benchmark.vocabulary), len(terms) - 1)
    present = terms[at] == benchmark.vocabulary
    lists: dict[int, np.ndarray] = {}

    def postings(term: int) -> np.ndarray:
        if term not in lists:
            lists[term] = positions[starts[at[term]] : starts[at[term] + 1]].astype(np.int64)
        return lists[term]

    def doc_of(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(doc_starts, places, "right") - 1

    hits: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    for n, source, phrase_terms, offsets in benchmark.phrases:
        for row in np.flatnonzero(present[phrase_terms].all(1)).tolist():
            found = postings(phrase_terms[row, 0]) - offsets[row, 0]
            found = found[found >= 0]
            for term, offset in zip(phrase_terms[row, 1:].tolist(), offsets[row, 1:].tolist()):
                if not len(found):
                    break
                found = found[among(found + offset, postings(term))]
            if len(found):
                k, offset = source[row].tolist()
                docs = doc_of(found)
                inside = found + n <= doc_starts[docs + 1]
                for place, doc in zip(found[inside].tolist(), docs[inside].tolist()):
                    hits[doc, k, place - offset].append((place, place + n))
    out = []
    for (doc, k, _), spans in sorted(hits.items()):
        spans.sort()
        base, runs = int(doc_starts[doc]), [list(spans[0])]
        for a, b in spans[1:]:
            if a <= runs[-1][0] + 1 or a <= runs[-1][1]:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        out += [(doc_ids[doc], benchmark.items[k][0], "phrase", a - base, b - base, b - a) for a, b in runs]
    for k, own in enumerate(benchmark.rarest):
        if present[own].all():
            places = postings(int(own[0]))
            docs, widest = doc_of(places), len(benchmark.items[k][1]) * 3 // 2
            for term in own[1:].tolist():
                from_, to = np.maximum(places - widest + 1, doc_starts[docs]), np.minimum(places + widest, doc_starts[docs + 1])
                close = np.searchsorted(postings(term), from_) < np.searchsorted(postings(term), to)
                places, docs = places[close], docs[close]
                if not len(places):
                    break
            for doc in np.unique(docs).tolist():
                base, end = int(doc_starts[doc]), int(doc_starts[doc + 1])
                a, b = shortest_cover([x[np.searchsorted(x, base) : np.searchsorted(x, end)] for x in map(postings, own.tolist())])
                if b - a <= widest:
                    out.append((doc_ids[doc], benchmark.items[k][0], "proximity", a - base, b - base, len(own)))
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, pass_words: int = PASS_WORDS) -> DataFrame:
    """All phrase and proximity matches of the benchmark's items in ``docs``.

    What is broadcast is the benchmark, whose size is checked first: one of
    more than ``pass_words`` words is split by item into passes over the index.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.regexp_count("text", F.lit(r"\w+")))).first()[0] or 0
    passes = max(1, math.ceil(size / pass_words))
    found = None
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        one = one_pass(spark, index, Benchmark([r.item_id for r in rows], [r.text for r in rows], phrase))
        found = one if found is None else found.unionAll(one)
    return found


def one_pass(spark: SparkSession, index: DataFrame, benchmark: Benchmark) -> DataFrame:
    wanted = spark.sparkContext.broadcast(benchmark.vocabulary)
    shape = pa.schema([("term", pa.int64()), ("docs", pa.int64())])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = wanted.value
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1)):
                terms, counts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), "<i4")
                if len(terms) and len(vocabulary):
                    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                    total += np.where(terms[at] == vocabulary, counts[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=shape)

    for row in index.select("terms", "doc_counts").mapInArrow(frequencies, "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        benchmark.rarity[row.term] = row.docs
    benchmark.plan()
    shared = spark.sparkContext.broadcast(benchmark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                terms, starts, doc_starts, positions = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((1, np.uint64), (2, "<i4"), (3, "<i4"), (4, "<i4")))
                out = look_up(own, batch.column(0)[i].as_py(), terms, starts, doc_starts, positions)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, MATCH_SHAPE)], schema=MATCH_SHAPE)

    return index.select("doc_ids", "terms", "starts", "doc_starts", "positions").mapInArrow(search, MATCHES)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item matches.

    Matched rows are told by the hash of their text, so null and repeated ids
    don't matter, and dropped by the place where they are stored.
    """
    rows = placed(docs)
    key, before = F.xxhash64(F.col("doc.text").cast("string")), saved_paths()
    matched = find_matches(rows.select(key.alias("doc_id"), F.col("doc.text").alias("text")), benchmark, phrase)
    keys = save(matched.select(F.col("doc_id").alias("matched")).distinct(), "contaminated")
    discard_but(before, keys)
    dropped = marks(rows.select("piece", "at", key.alias("key")).join(keys, F.col("key") == F.col("matched"), "left_semi").select("piece", "at", F.lit(1).alias("value")), "dropped")
    discard(keys)
    return rows.where(dropped(F.col("piece"), F.col("at")) == 0).select("doc.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
