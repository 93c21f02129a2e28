"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document is the set of its runs of ``SHINGLE`` words. SuperMinHash gives each
element a random permutation of the signature's slots and offers slot
``p[j]`` the value ``j + r`` with ``r`` uniform in [0, 1), rank after rank; a
slot keeps the least. As the ranks of one element are all different, slots are
negatively correlated and the estimate varies less than MinHash's. Once every
slot of a document is filled at a rank below the next, no later offer can win,
and the document is finished: long documents need one or two ranks.

Documents with the same words are one node from the start. Nodes that agree in
all values of a band share a bucket. In every bucket its least node is compared
with the others, then all pairs that are not yet in one group; each comparison
is the exact Jaccard similarity of the shingle sets. Verified pairs are united
to groups by union-find in each partition and star contraction between them.

A row is known by the place where it is stored, so what is joined are keys and
places. Texts of nodes that share a bucket with another are read once more, and
only their shingle sets are shuffled. Joins between tables that grow with the
data are merge joins at every size; nothing is broadcast.

Defined results: texts with no word (null, empty) are never grouped, and kept. A
text with fewer words than a shingle is one shingle; texts of any length are
taken whole. Repeated rows are copies of each other; null ``doc_id`` rows are
grouped by their text like others, and sort last as a representative. The
representative is the row with the least ``doc_id``, on ties the one stored
first, whatever its other columns hold. An empty table has no group. Columns of
``docs`` may have any names; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hash_words, marks, mix64, placed, save, starts_of, table, text_chunks

SHINGLE = 3
BANDS, ROWS = 40, 4
#: Jaccard similarity from which two documents are near duplicates.
THRESHOLD = 0.5

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of every text, repeats included, and their number for each text."""
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    total = int(n.sum())
    if not total:
        return np.empty(0, np.uint64), n
    begin = np.repeat(starts_of(counts)[:-1] - starts_of(n)[:-1], n) + np.arange(total)
    width = np.repeat(np.minimum(counts, size), n)
    value = width.astype(np.uint64)
    for i in range(size):
        word = hashes[np.minimum(begin + i, len(hashes) - 1)]
        value = np.where(i < width, mix64(value * GOLDEN ^ word), value)
    return value, n


def super_minhash(elements: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """Signatures of sets given as runs of element hashes: an array of documents x slots; an empty set has infinities.

    Goes through the ranks for all documents at once. An element's permutation
    is a Fisher-Yates shuffle of its own random numbers, kept only for elements
    of documents that aren't finished.
    """
    out = np.full((len(counts), slots), np.inf)
    doc = np.repeat(np.arange(len(counts)), counts)
    seed, swaps, order = elements, [], None
    for rank in range(slots):
        draw = mix64(seed + np.uint64((rank + 1) * int(GOLDEN) % 2**64))
        r = (draw >> np.uint64(32)).astype(np.float64) / 2.0**32
        swap = rank + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        if rank == 0:
            slot = swap
        elif rank == 1:  # where the first swap left slot 0
            slot = np.where(swap == swaps[0], 0, swap)
        else:
            rows = np.arange(len(seed))
            slot = order[rows, swap]
            order[rows, swap] = order[:, rank]
        np.minimum.at(out.reshape(-1), doc * slots + slot, rank + r)
        left = (out.max(1) >= rank + 1)[doc]
        if not left.any():
            break
        seed, doc = seed[left], doc[left]
        if rank < 2:
            swaps = [x[left] for x in (*swaps, swap)]
        if rank == 1:
            rows = np.arange(len(seed))
            order = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(seed), slots)).copy()
            order[rows, swaps[0]] = 0
            order[rows, swaps[1]] = order[:, 1]
        elif rank > 1 and not left.all():
            order = order[left]
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, bits.shape[:2]).copy()
    for i in range(rows):
        value = mix64(value * GOLDEN ^ bits[:, :, i])
    return value.view(np.int64)


def content_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each text's words in order; texts that differ in case or punctuation only share it."""
    starts = starts_of(counts)
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(starts[:-1], counts).astype(np.uint64)
    value = mix64(hashes ^ mix64((place + np.uint64(1)) * GOLDEN))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    return mix64(sums[starts[1:]] - sums[starts[:-1]] + counts.astype(np.uint64)).view(np.int64)


def sign(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """Content ``key`` of the ``rows`` that have a word, with the bands of each key at its first row in a task."""
    shape = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("at", pa.int32()), ("key", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        for part, texts in text_chunks(batches, 3, 1_000_000):
            hashes, counts = hash_words(texts)
            some = np.flatnonzero(counts)
            counts = counts[some]
            keys = content_keys(hashes, counts)
            fresh = np.zeros(len(keys), bool)
            for i, key in enumerate(keys.tolist()):
                if key not in signed:
                    signed.add(key)
                    fresh[i] = True
            own = hashes[np.repeat(fresh, counts)]
            found = band_hashes(super_minhash(*shingles(own, counts[fresh]), bands * per_band), bands, per_band)
            cut = pa.array(np.where(np.append(fresh, True), starts_of(fresh * bands), 0), pa.int32(), mask=~np.append(fresh, True))
            lists = pa.ListArray.from_arrays(cut, pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(some)) for i in range(3)), pa.array(keys), lists], schema=shape)

    return rows.select("doc_id", "piece", "at", "text").mapInArrow(kernel, "doc_id bigint, piece bigint, at int, key bigint, bands array<bigint>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``key`` and the sorted distinct shingle hashes, as binary, of each of the ``texts``, which have words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in text_chunks(batches, 0):
            hashes, counts = hash_words(own)
            value, n = shingles(hashes, counts)
            at = starts_of(n)
            sets = [np.unique(value[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(content_keys(hashes, counts)), pa.array(sets, pa.binary())], names=["key", "shingles"])

    return texts.select("text").mapInArrow(kernel, "key bigint, shingles binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``u``, ``v`` with a Jaccard similarity of ``threshold`` at least."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [jaccard(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)) >= threshold for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    a, b = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"s{k}")) for k in "uv")
    return pairs.hint("merge").join(a, "u").hint("merge").join(b, "v").select("u", "v", "su", "sv").mapInArrow(kernel, "u bigint, v bigint")


def local_forest(edges: DataFrame) -> DataFrame:
    """Union-find over each partition's edges: every node once, with the least node it is united with."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        for i in range(0, len(nodes), 100_000):
            some = nodes[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in some], pa.int64()), pa.array(some, pa.int64())], names=["u", "v"])

    return edges.mapInArrow(kernel, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of the edges ``u``, ``v`` that isn't a root.

    Alternates large-star and small-star steps until nothing changes; every
    round is a saved table. A round takes a component's depth down by a constant
    factor, so rounds grow with its logarithm.
    """
    now = save(local_forest(edges.select("u", "v")), "stars")
    state = fingerprint(now)
    while True:
        # large star: a node's larger neighbours are tied to its least neighbour
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select("m", "u", "v")
        after = save(small.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct(), "stars")
        discard(now)
        now, before, state = after, state, fingerprint(after)
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def fingerprint(edges: DataFrame) -> tuple:
    """Number and hash sum of a set of edges: equal for equal sets, and otherwise not but by a 64-bit coincidence."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def members(rows: DataFrame, threshold: float, bands: int, per_band: int) -> DataFrame:
    """``doc_id``, ``piece``, ``at`` and ``root`` of the rows that are in a group of two or more; a saved table."""
    slim = rows.select(F.col("doc.doc_id").cast("bigint").alias("doc_id"), "piece", "at", F.col("doc.text").cast("string").alias("text"))
    signed = save(sign(slim, bands, per_band), "signed")
    labels = group_labels(slim, signed, threshold)
    every = signed.select("doc_id", "piece", "at", "key").hint("merge").join(labels, F.col("key") == F.col("node"), "left").select("doc_id", "piece", "at", F.coalesce("root", "key").alias("root"))
    found = save(every.hint("merge").join(every.groupBy("root").count().where("count > 1").select("root"), "root").select("doc_id", "piece", "at", "root"), "members")
    discard(signed, labels)
    return found


def group_labels(slim: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """``node`` (a content key) and the ``root`` of its group, for keys that are united with a smaller one; a saved table."""
    banded = signed.where("bands is not null").select("key", F.explode("bands").alias("band"))
    # the leader of a bucket is its least key: found by partial aggregates, so that no bucket meets in one task
    leaders = save(banded.groupBy("band").agg(F.min("key").alias("leader"), F.max("key").alias("last")).where("leader < last").select("band", "leader"), "leaders")
    buckets = save(banded.hint("merge").join(leaders, "band").select("band", "leader", "key").distinct(), "buckets")
    discard(leaders)
    star = save(buckets.where("leader <> key").select(F.col("leader").alias("u"), F.col("key").alias("v")).distinct(), "star")
    sets = save(shingle_sets(chosen_texts(slim, signed, buckets.select("key").distinct())), "shingles")
    # each key with the least of its leaders: enough to unite most copies, with one comparison for each
    nearest = star.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    edges = [save(verified(nearest, sets, threshold), "edges")]
    united = components(edges[0])
    # then the other leaders of a key, where its group is still another one
    roots = united.select(F.col("node").alias("u"), F.col("root").alias("ru")), united.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    others = star.hint("merge").join(nearest, ["u", "v"], "left_anti").hint("merge").join(roots[0], "u", "left").hint("merge").join(roots[1], "v", "left")
    edges.append(save(verified(others.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v"), sets, threshold), "edges"))
    discard(star, united)
    united = components(edges[0].unionAll(edges[1]))
    # what the stars left apart: pairs of one bucket in different groups
    flat = buckets.hint("merge").join(united, F.col("key") == F.col("node"), "left").select("band", "leader", "key", F.coalesce("root", "key").alias("root"))
    mixed = flat.groupBy("band").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first < last").select("band")
    apart = save(flat.where("key <> leader").hint("merge").join(mixed, "band").select("band", "key", "root"), "apart")
    a, b = apart.select("band", F.col("key").alias("u"), F.col("root").alias("ru")), apart.select("band", F.col("key").alias("v"), F.col("root").alias("rv"))
    rest = a.hint("merge").join(b, "band").where("u < v and ru <> rv").select("u", "v").distinct()
    edges.append(save(verified(rest, sets, threshold), "edges"))
    discard(buckets, apart, sets, united)
    labels = components(edges[0].unionAll(edges[1]).unionAll(edges[2]))
    discard(*edges)
    return labels


def chosen_texts(slim: DataFrame, signed: DataFrame, keys: DataFrame) -> DataFrame:
    """``text`` of one row for each of the ``keys``, read where it is stored."""
    rows = signed.where("bands is not null").select("key", F.struct("piece", "at").alias("place")).hint("merge").join(keys, "key")
    first = rows.groupBy("key").agg(F.min("place").alias("place")).select("place.piece", "place.at", F.lit(1).alias("value"))
    wanted = marks(first, "chosen")
    return slim.where(wanted(F.col("piece"), F.col("at")) == 1).select("text")


def representatives(found: DataFrame) -> DataFrame:
    """Each group's ``root``, ``group_size`` and first row: its ``group_id`` (the least ``doc_id``), ``piece`` and ``at``."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "piece", "at")
    groups = found.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("root", F.col("first.doc_id").alias("group_id"), "group_size", F.col("first.piece").alias("first_piece"), F.col("first.at").alias("first_at"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``group_id`` (its least ``doc_id``), ``group_size`` and ``is_representative`` for each row in a group of two or more."""
    found = members(placed(docs), threshold, bands, rows)
    own = (F.col("piece") == F.col("first_piece")) & (F.col("at") == F.col("first_at"))
    return found.hint("merge").join(representatives(found), "root").select("doc_id", "group_id", "group_size", own.alias("is_representative"))


def keep_representatives(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that are in no group, and one row of each group."""
    stored = placed(docs)
    found = members(stored, threshold, bands, rows)
    other = (F.col("piece") != F.col("first_piece")) | (F.col("at") != F.col("first_at"))
    dropped = marks(found.hint("merge").join(representatives(found), "root").where(other).select("piece", "at", F.lit(1).alias("value")), "dropped")
    discard(found)
    return stored.where(dropped(F.col("piece"), F.col("at")) == 0).select("doc.*")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
