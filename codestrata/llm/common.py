"""Shared pieces: the word tokenizer, stable word hashes and tables in the shared folder.

A word is a maximal run of letters, digits and underscores of the lower-cased
text. A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
NO_WORD = re.compile(r"[^\w \n]+")
#: Bytes of text handled at once in a kernel.
CHUNK_BYTES = 2_000_000

#: Bounds on what an executor and its Python workers exchange at once, set where the session leaves them at their defaults.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

_run_dirs: list[tuple[SparkSession, str]] = []


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def fold(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")]] = True
_IS_WORD[128:] = True
#: Keeps the lowest so many bytes of eight.
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Stable 64-bit hashes of the words of all texts, one after another, and the number of words of each text.

    Works on bytes: in an ASCII text the word bytes are known, and in any other
    text what isn't part of a word is blanked first.
    """
    low = [t.lower() if t else "" for t in texts]
    raw = [(t if t.isascii() else NO_WORD.sub(" ", t)).encode("utf-8", "replace") for t in low]
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n" + bytes(8), np.uint8)
    inside = _IS_WORD[data].view(np.int8)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    first, rest = edge[::2].copy(), edge[1::2] - edge[::2]
    counts = np.diff(np.searchsorted(first, starts_of(sizes)))
    eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    value = rest.astype(np.uint64)
    on = np.arange(len(first))
    while len(on):
        value[on] = mix64(value[on] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[first[on]] & _LOWEST[np.minimum(rest[on], 8)]))
        on = on[rest[on] > 8]
        first[on] += 8
        rest[on] -= 8
    return value, counts


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets of runs of the given lengths, with the end of the last."""
    return np.concatenate([[0], np.cumsum(counts)])


def byte_chunks(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about ``most`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return a worker's freed memory to the system: workers stay for later tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def give_back_heaps(spark: SparkSession) -> None:
    """Have every executor collect its garbage, which returns the heap's free room to the system: heaps grow to their limit and stay there, next to the Python workers."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).selectExpr("reflect('java.lang.System', 'gc')").collect()


def text_chunks(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """:func:`byte_chunks` with the texts as Python strings."""
    for part in byte_chunks(batches, column, most):
        yield part, part.column(column).to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests, one machine), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='codestrata-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def bound_batches(spark: SparkSession) -> None:
    """Batches of some megabytes, as texts are long: a default one of 10,000 rows can hold most of a worker's memory."""
    for key in BATCHES.keys() - spark.conf.getAll.keys():
        spark.conf.set(key, BATCHES[key])


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by :func:`release`."""
    bound_batches(spark)
    path = f"{shared_folder(spark)}/codestrata/{name}-{uuid.uuid4().hex}"
    if not _run_dirs:
        atexit.register(release)
    _run_dirs.append((spark, path))
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by :func:`save` that no later step reads."""
    names = {f.rsplit("/", 2)[-2] for df in tables for f in df.inputFiles()}
    for spark, path in [x for x in _run_dirs if x[1].rsplit("/", 1)[-1] in names]:
        _remove(spark, path)
        _run_dirs.remove((spark, path))


def saved_paths() -> set[str]:
    """Paths of the tables that are in the shared folder now."""
    return {path for _, path in _run_dirs}


def discard_but(paths: set[str], *tables: DataFrame) -> None:
    """Remove every table of this process but those at ``paths`` and ``tables``."""
    names = {f.rsplit("/", 2)[-2] for df in tables for f in df.inputFiles()}
    for spark, path in [x for x in _run_dirs if x[1] not in paths and x[1].rsplit("/", 1)[-1] not in names]:
        _remove(spark, path)
        _run_dirs.remove((spark, path))


def release(spark: SparkSession | None = None) -> None:
    """Remove every table that :func:`save` wrote in this process; call it when no result is needed any more."""
    while _run_dirs:
        owner, path = _run_dirs.pop()
        _remove(spark or owner, path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as one struct ``doc``, so that no column of its own clashes with an operator's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


#: Rows of a file whose marks are one piece.
PIECE = 1 << 20


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` packed as ``doc``, with the place where each row is stored: ``piece`` (a run of a file's rows) and ``at`` in it.

    A place stands for its row in later steps, so that they move no text. Only
    rows of Parquet files have one; any other table is saved first.
    """
    if not _from_files(docs._jdf.queryExecution().analyzed()):
        docs = save(docs, "rows")
    stored = docs.metadataColumn("_metadata")
    row, block = stored.getField("row_index"), F.shiftright(stored.getField("row_index"), PIECE.bit_length() - 1)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.xxhash64(stored.getField("file_path"), block).alias("piece"), row.bitwiseAND(F.lit(PIECE - 1)).cast("int").alias("at"))


def _from_files(plan) -> bool:
    """Whether a plan only selects from the rows of one Parquet table."""
    kind = plan.getClass().getSimpleName()
    if kind == "LogicalRelation":
        return "parquet" in plan.relation().toString().lower()
    return kind in ("Project", "Filter", "SubqueryAlias") and plan.deterministic() and _from_files(plan.children().head())


def marks(decided: DataFrame, name: str):
    """A function of ``piece`` and ``at`` that gives the ``value`` which ``decided`` has there, or 0.

    ``decided`` (``piece``, ``at``, ``value``) is written to the shared folder,
    one small file for each piece; a task loads those of the rows it meets. So
    rows get their marks where they are, without a join.
    """
    path = own_path(decided.sparkSession, name)
    decided.select("piece", F.col("at").cast("int").alias("at"), F.col("value").cast("int").alias("value")).repartition("piece").sortWithinPartitions("piece", "at").write.partitionBy("piece").parquet(path)

    def load(piece: int) -> tuple[np.ndarray, np.ndarray]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        if fs.get_file_info(f"{root}/_SUCCESS").type != pyarrow.fs.FileType.File:
            raise FileNotFoundError(f"{path} is gone")
        found = [x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/piece={piece}", allow_not_found=True)) if x.path.endswith(".parquet")]
        parts = [pq.ParquetFile(x, filesystem=fs).read(["at", "value"]) for x in found]
        at, value = (np.concatenate([np.empty(0, np.int64), *(p.column(c).to_numpy() for p in parts)]).astype(np.int64) for c in ("at", "value"))
        order = np.argsort(at, kind="stable")
        return at[order], value[order]

    @F.arrow_udf("int")
    def value(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pieces, places in batches:
            pieces, places = pieces.to_numpy(), places.to_numpy()
            out = np.zeros(len(pieces), np.int32)
            for piece in np.unique(pieces).tolist():
                if piece not in held:
                    if len(held) >= 4:
                        held.pop(next(iter(held)))
                    held[piece] = load(piece)
                known, values = held[piece]
                if len(known):
                    rows = np.flatnonzero(pieces == piece)
                    i = np.minimum(np.searchsorted(known, places[rows]), len(known) - 1)
                    out[rows] = np.where(known[i] == places[rows], values[i], 0)
            yield pa.array(out)
        held.clear()
        give_back()

    return value
