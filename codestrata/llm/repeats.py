"""Suffix-array dedup: passages of many words that documents share.

Two steps make the work of a suffix array local. Every document is sampled by
winnowing: of each window of consecutive word runs the one with the least hash
is an anchor, and the windows are so long that any passage of ``MIN_WORDS``
words has an anchor inside, the same one in each document. Around anchors that
two different texts share, a segment is cut that holds every such passage
through the anchor, and the segments of one anchor meet in one task.

There they are a collection that is aligned at the anchor, since a passage through
the anchor has it at the same place in every text. Its suffix order is built
column by column, from the last to the first (Bauer, Cox and Rosone; with common
prefixes, Cox et al.), by :func:`aligned_order`: a column's order is that of the
column after it, sorted by the words in the column. As suffixes of different
columns never share a passage at one anchor, a column replaces the one after it:
the work is one step for each word, and what is held is an order and a common
prefix for each segment. :func:`construct` keeps the suffixes of all columns in
one order, in blocks that are files, at a cost of the square of a segment's words;
the tests hold the aligned order against it.

Segments that share ``MIN_WORDS`` words from a column on and come from two
different documents have a repeat there.

Defined results: one row for each maximal span of a document that is covered by
passages of at least ``min_words`` words that another document has too.
Documents with the same text share all of it. A passage that is repeated within
one document only is no repeat, and rows with one ``doc_id`` and the same text
are one document (reported once each). Null and shorter texts have none; null
ids count as one document and are reported as null. Words are those of
``common.words``; positions count from 0, ends are exclusive.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_words, mix64, save, starts_of, table, text_chunks

MIN_WORDS = 50
#: Words of a run; anchors are runs.
RUN = 20
#: Segments collected for one construction, but for a larger anchor group.
BATCH = 3000
#: Symbols of a block.
BLOCK = 2_000_000
NO_ID = 2**63 - 1
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; those that reach over the end wrap and mean nothing."""
    value, width, out, at = words, 1, None, 0
    while size:  # binary powers: joins runs of doubling width
        if size & 1:
            out = np.roll(value, -at) if out is None else mix64(out * GOLDEN ^ np.roll(value, -at))
            at += width
        size >>= 1
        value, width = mix64(value * GOLDEN ^ np.roll(value, -width)), width * 2
    return out


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` values from a place on (shorter at the end)."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(hashes: np.ndarray, counts: np.ndarray, min_words: int, run: int) -> np.ndarray:
    """Places (in the joined words) of the anchors of all texts."""
    windows = min_words - run + 1
    n = len(hashes)
    if n < min_words:
        return np.empty(0, np.int64)
    value = run_hashes(hashes, run)
    doc = np.repeat(np.arange(len(counts)), counts)
    last = np.minimum(np.arange(n) + min_words - 1, n - 1)
    whole = (doc[last] == doc) & (np.arange(n) + min_words <= n)
    least = np.where(whole, sliding(value, windows, np.minimum), np.uint64(0))
    # a run is an anchor if it is the least of some window: the greatest least of the windows it is in
    most = sliding(least[::-1], windows, np.maximum)[::-1]
    return np.flatnonzero((value == most) & (most > 0))


class Blocks:
    """The columns of a collection as blocks in memory, or as files in ``folder``."""

    def __init__(self, folder: str | None):
        self.fs, self.root = (None, None) if folder is None else pyarrow.fs.FileSystem.from_uri(folder)
        self.blocks: list = []
        self.n = 0
        if self.fs:
            self.root = f"{self.root}/collection-{uuid.uuid4().hex}"
            self.fs.create_dir(self.root, recursive=True)

    def read(self) -> Iterator[tuple[np.ndarray, ...]]:
        for block in self.blocks:
            if self.fs is None:
                yield block
            else:
                with self.fs.open_input_stream(block) as f:
                    data = f.read()
                n = len(data) // 24
                yield tuple(np.frombuffer(data, kind, n, at * n) for kind, at in (("<u8", 0), ("<i8", 8), ("<i4", 16), ("<i4", 20)))

    def replace(self, blocks: Iterator[tuple[np.ndarray, ...]]) -> None:
        old, new, n = self.blocks, [], 0
        for block in blocks:
            n += len(block[0])
            if self.fs is None:
                new.append(block)
            else:
                new.append(f"{self.root}/{uuid.uuid4().hex}")
                with self.fs.open_output_stream(new[-1]) as f:
                    for column in block:
                        f.write(np.ascontiguousarray(column).tobytes())
        self.blocks, self.n = new, n
        if self.fs:
            for path in old:
                self.fs.delete_file(path)

    def close(self) -> None:
        if self.fs:
            self.fs.delete_dir(self.root)


def construct(words: np.ndarray, lengths: np.ndarray, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings in order: string, suffix length and common prefix with the one before.

    ``words`` are the strings joined; every string ends in a mark of its own
    that is less than any word. A block's columns are the sort key (first symbol
    and place of the shorter suffix), string, common prefix and suffix length.
    """
    n = len(lengths)
    _, symbols = np.unique(words, return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    ends = starts_of(lengths)[1:]
    store = Blocks(folder)
    strings = np.arange(n, dtype=np.int64)
    store.replace(iter([(strings.astype(np.uint64), strings, np.zeros(n, np.int32), np.zeros(n, np.int32))]))
    place = strings.copy()  # of each string's newest suffix
    for j in range(1, int(lengths.max(initial=0)) + 1):
        active = np.flatnonzero(lengths >= j)
        symbol, at = symbols[ends[active] - j], place[active]
        key = symbol.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64)
        order = np.argsort(key)
        key, active = key[order], active[order]
        m = len(key)
        # first pass: where the new suffixes go, and their neighbours
        into = np.zeros(m, np.int64)
        before, after = np.zeros(m, np.uint64), np.full(m, ~np.uint64(0))
        base, done, last_key = 0, 0, np.uint64(0)
        for keys, *_ in store.read():
            to = m if base + len(keys) == store.n else int(np.searchsorted(key, keys[-1]))
            some = slice(done, to)
            local = np.searchsorted(keys, key[some])
            into[some] = base + local
            before[some] = np.where(local > 0, keys[np.maximum(local - 1, 0)], last_key)
            after[some] = np.where(local < len(keys), keys[np.minimum(local, len(keys) - 1)], ~np.uint64(0))
            base, done, last_key = base + len(keys), to, keys[-1]
        # of new suffixes that go to one place, each is the next one's neighbour
        joined = np.concatenate([[False], into[1:] == into[:-1]])
        before = np.where(joined, np.concatenate([[np.uint64(0)], key[:-1]]), before)
        tail = ~np.concatenate([joined[1:], [False]])  # the last one at its place, whose neighbour is an old suffix
        low = np.concatenate([before, key[tail]])
        high = np.concatenate([key, after[tail]])
        same = low >> np.uint64(32) == high >> np.uint64(32)
        same &= high >> np.uint64(32) > 0
        common = np.zeros(len(low), np.int64)
        if same.any():
            mask = np.uint64(0xFFFFFFFF)
            common[same] = 1 + least_between(store, (low[same] & mask).astype(np.int64), (high[same] & mask).astype(np.int64))
        new_lcp, next_lcp = common[:m], common[m:]
        next_at = into[tail]
        # second and last pass: write the blocks anew
        store.replace(merged(store, key, active, into, new_lcp, next_at, next_lcp, j))
        place[active] = into + np.arange(m)
    found = [[], [], []]
    for _, string, lcp, length in store.read():
        for a, b in zip(found, (string, length, lcp)):
            a.append(b)
    store.close()
    return tuple(np.concatenate(x) for x in found)


def least_between(store: Blocks, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least common prefix in (low, high] for each pair of places; one pass over the blocks."""
    out = np.full(len(low), 1 << 30, np.int64)
    order = np.argsort(low, kind="stable")
    low, high = low[order] + 1, high[order] + 1
    base = 0
    for _, _, lcp, _ in store.read():
        end = base + len(lcp)
        on = np.flatnonzero((low < end) & (high > base))
        if len(on):
            a, b = np.maximum(low[on], base) - base, np.minimum(high[on], end) - base
            edges = np.empty(2 * len(on), np.int64)
            edges[::2], edges[1::2] = a, b
            out[on] = np.minimum(out[on], np.minimum.reduceat(np.append(lcp, 1 << 30), edges)[::2])
        base = end
    back = np.empty_like(out)
    back[order] = out
    return back


def merged(store: Blocks, key: np.ndarray, string: np.ndarray, into: np.ndarray, lcp: np.ndarray, next_at: np.ndarray, next_lcp: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The blocks with the new suffixes in; places in keys move by the number of suffixes put in before them."""
    mask, base, done = np.uint64(0xFFFFFFFF), 0, 0
    slots = np.bincount(into, minlength=store.n + 1) if store.fs is None else None
    moved = np.cumsum(slots).astype(np.uint64) if slots is not None else None

    def move(keys: np.ndarray) -> np.ndarray:
        own = keys >> np.uint64(32) > 0
        at = keys & mask
        by = moved[at.astype(np.int64)] if moved is not None else np.searchsorted(into, at.astype(np.int64), "right").astype(np.uint64)
        return np.where(own, keys + by, keys)

    new_keys = move(key)
    for keys, strings, lcps, lengths in store.read():
        end = base + len(keys)
        to = len(into) if end == store.n else int(np.searchsorted(into, end))
        some, own = slice(done, to), into[done:to] - base
        lcps = lcps.copy()
        a, b = np.searchsorted(next_at, [base, end])
        lcps[next_at[a:b] - base] = next_lcp[a:b]
        at = own + np.arange(len(own))
        is_new = np.zeros(len(keys) + len(own), bool)
        is_new[at] = True
        block = []
        for old, new in ((move(keys), new_keys[some]), (strings, string[some]), (lcps, lcp[some]), (lengths, length)):
            column = np.empty(len(is_new), old.dtype)
            column[~is_new] = old
            column[is_new] = new
            block.append(column)
        base, done = end, to
        pieces = max(1, -(-len(is_new) // (2 * BLOCK))) if store.fs else 1
        yield from zip(*(np.array_split(c, pieces) for c in block))


def least_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for each pair, none of them empty; by runs of doubling width."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp(high - low)[1] - 1
    for k in range(int(level.max(initial=-1)) + 1):
        on = np.flatnonzero(level == k)
        out[on] = np.minimum(values[low[on]], values[high[on] - (1 << k)])
        values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


def aligned_order(words: np.ndarray, begins: np.ndarray, lengths: np.ndarray, columns: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of ``width`` columns, from the last to the first, the strings in the order of their suffixes from there, and the common prefix of each with the one before.

    String ``i`` has ``lengths[i]`` of ``words`` from ``begins[i]`` on, and its
    first one stands in column ``columns[i]``. Outside of itself it has marks of
    its own, which are less than any word. A column's order is that of the next
    one, sorted by the column's symbols.
    """
    n = len(lengths)
    order, common = np.arange(n), np.zeros(n, np.int32)
    low_bits, place = np.uint64(31), np.arange(n, dtype=np.uint64)
    for c in range(width - 1, -1, -1):
        inside = np.flatnonzero((columns <= c) & (c < columns + lengths))
        symbol = np.zeros(n, np.uint64)
        symbol[inside] = words[begins[inside] + (c - columns[inside])].astype(np.uint64) + np.uint64(1)
        key = np.sort(symbol[order] << low_bits | place)
        source, symbol = (key & np.uint64((1 << 31) - 1)).astype(np.int64), key >> low_bits
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0))
        new = np.zeros(n, np.int32)
        new[same + 1] = 1 + least_in(common, source[same] + 1, source[same + 1] + 1)
        order, common = order[source], new
        yield c, order, common


def repeated(group: pa.Table, min_words: int, run: int) -> list[np.ndarray]:
    """Row, start, end and first id of the shared passages among segments (anchor, row, first, start, at, words)."""
    rows, firsts, starts, at = (group.column(c).to_numpy() for c in ("row", "first", "start", "at"))
    data = group.column("words").to_pylist()
    lengths = np.array([len(x) // 4 for x in data], np.int64)
    words, n = np.frombuffer(b"".join(data), "<u4"), len(data)
    columns = (min_words - run) - at.astype(np.int64)
    origin = starts - columns  # a string's place in its text is this and the column
    end, least = np.full(n, -1), np.full(n, NO_ID)
    out: list[tuple[np.ndarray, ...]] = []

    def close(which: np.ndarray, c: int) -> None:
        out.append((rows[which], origin[which] + c, origin[which] + end[which], least[which]))
        end[which], least[which] = -1, NO_ID

    for c, order, common in aligned_order(words, starts_of(lengths)[:-1], lengths, columns, 2 * min_words - run):
        if c > min_words - run:
            continue  # what begins behind the anchor doesn't hold it
        begins = np.flatnonzero(common < min_words)
        low, high, first = np.minimum.reduceat(rows[order], begins), np.maximum.reduceat(rows[order], begins), np.minimum.reduceat(firsts[order], begins)
        size = np.diff(np.append(begins, n))
        good = np.repeat(low != high, size)
        covered, own = order[good], np.repeat(first, size)[good]
        ended = end >= 0
        ended[covered] = False
        close(np.flatnonzero(ended), c + 1)
        end[covered] = np.where(end[covered] < 0, c + min_words, end[covered])
        least[covered] = np.minimum(least[covered], own)
    close(np.flatnonzero(end >= 0), 0)
    return [np.concatenate(x) for x in zip(*out)]


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """``doc_id``, ``start_word``, ``end_word``, ``n_words`` and ``first_doc_id`` (the least id that shares a part) of every repeated span."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("row"), "text")
    sampled = save(slim.mapInArrow(lambda batches: sample(batches, min_words, run), "doc_id bigint, row bigint, n_words int, anchors array<bigint>, places array<int>"), "anchors")
    each = sampled.select("row", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select("row", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("place"))
    shared = save(each.groupBy("anchor").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high").select("anchor"), "shared")
    of_text = each.join(shared, "anchor").groupBy("row").agg(F.collect_set(F.struct("anchor", "place")).alias("found"))
    firsts = sampled.groupBy("row").agg(F.min("doc_id").alias("first"), F.min("n_words").alias("n_words"), F.countDistinct(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("ids"))
    wanted = save(of_text.join(firsts, "row").select(F.col("row").alias("w_row"), "first", F.col("found.anchor").alias("anchors"), F.col("found.place").alias("places")), "wanted")
    texts = slim.join(wanted, (F.col("row") == F.col("w_row")) & slim["doc_id"].eqNullSafe(F.col("first")))
    texts = texts.select("row", "text", F.coalesce("first", F.lit(NO_ID)).alias("first"), "anchors", "places")
    segments = texts.mapInArrow(lambda batches: cut_segments(batches, min_words, run), "anchor bigint, row bigint, first bigint, start int, at int, words binary")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("first", pa.int64())])
        for group in whole_groups(batches):
            out = repeated(group, min_words, run)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, shape)], schema=shape)

    spans = segments.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(kernel, "row bigint, start int, end int, first bigint").distinct()
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0))).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    united = numbered.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"))
    copies = firsts.where((F.col("ids") > 1) & (F.col("n_words") >= min_words)).select("row", F.lit(0).alias("start"), F.col("n_words").alias("end"), F.coalesce("first", F.lit(NO_ID)).alias("first"))
    # a text that several documents share is repeated as a whole
    merged_spans = united.join(copies.select("row"), "row", "left_anti").select("row", "start", "end", "first").unionAll(copies)
    result = sampled.select("doc_id", "row").join(merged_spans, "row")
    return result.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), F.when(F.col("first") < NO_ID, F.col("first")).alias("first_doc_id"))


def sample(batches: Iterator[pa.RecordBatch], min_words: int, run: int) -> Iterator[pa.RecordBatch]:
    for part, texts in text_chunks(batches, 2):
        hashes, counts = hash_words(texts)
        at = anchors(hashes, counts, min_words, run)
        value = run_hashes(hashes, run)[at].view(np.int64) if len(at) else np.empty(0, np.int64)
        starts = starts_of(counts)
        doc = np.searchsorted(starts, at, "right") - 1
        cut = pa.array(starts_of(np.bincount(doc, minlength=len(texts))), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (value, (at - starts[doc]).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int32()), *lists], names=["doc_id", "row", "n_words", "anchors", "places"])


def cut_segments(batches: Iterator[pa.RecordBatch], min_words: int, run: int) -> Iterator[pa.RecordBatch]:
    """From each anchor, the words that any passage through it can have."""
    names = ["anchor", "row", "first", "start", "at", "words"]
    for part, texts in text_chunks(batches):
        hashes, counts = hash_words(texts)
        small, starts = (hashes >> np.uint64(32)).astype("<u4"), starts_of(counts)
        rows, firsts = part.column(0).to_pylist(), part.column(2).to_pylist()
        out: list[tuple] = []
        for i, (keys, places) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist())):
            words = small[starts[i] : starts[i + 1]]
            for key, place in zip(keys, places):
                begin = max(0, place - (min_words - run))
                out.append((key, rows[i], firsts[i], begin, place - begin, words[begin : place + min_words].tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)


def whole_groups(batches: Iterator[pa.RecordBatch], size: int = BATCH) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows, never parting those of one anchor, which stand together."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, at = batch.column(0).to_numpy(), 0
        new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for i in ([] if last is None or keys[0] == last else [0]) + new.tolist():
            if n + i - at >= size:
                yield pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, n, at = [], 0, i
        held.append(batch.slice(at))
        n, last = n + batch.num_rows - at, keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))
