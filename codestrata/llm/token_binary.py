"""Token ids as compressed binary records with a shared dictionary.

Every document is tokenized, its ids are serialized as little-endian 16-bit
integers, and the bytes are compressed as one zstandard frame of their own with
a dictionary trained on such arrays. A shard file is the frames of one partition
in order; the dictionary lies beside the shards under its hash. The result is
the offset index: every record has its shard's path, its byte offset there and
its length, and the dictionary's hash, so that a short document is read without
its neighbours.

The dictionary is trained on ``TRAIN_PIECES`` pieces of ``PIECE_CHARS``
characters with the lowest hashes among all pieces of all documents, so a text's
end counts as much as its beginning.

Defined results: a null or empty text has 0 tokens and a frame of 0 bytes of
content; null ``doc_id`` stays null; repeated rows are separate records; texts
of any length are one record; an empty table gives no record and no shard. Only
``doc_id`` and ``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, save, shared_folder, starts_of, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces, and characters of each, that train the dictionary: 8 MB of text at most.
TRAIN_PIECES, PIECE_CHARS = 2000, 4096
DICTIONARY_BYTES = 32768
LEVEL = 3
INDEX = "doc_id bigint, n_tokens int, shard string, byte_offset bigint, byte_length int, dictionary_hash string"
SHAPE = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("shard", pa.string()), ("byte_offset", pa.int64()), ("byte_length", pa.int32()), ("dictionary_hash", pa.string())])


class Encoder:
    """Texts -> serialized ids, each distinct piece between single spaces encoded once for a batch.

    A single space always starts a pre-token, so the ids of a text are those of
    its pieces, each with the space before it. Texts with a run of spaces, or a
    space at an end, are encoded whole. The distinct pieces are encoded as one
    text and the ids split where the bytes of a piece end.
    """

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.model = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.bytes_of[i] = len(token)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode_ordinary(text), "<u2").tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        lone = pc.match_substring_regex(texts, "^ |  | $").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(lone), "", texts), " ")
        coded = pc.dictionary_encode(split.flatten())
        if not len(coded):
            return []
        distinct, index = pc.replace_substring_regex(coded.dictionary, "^$", "-"), coded.indices.to_numpy()
        ids = np.array(self.model.encode_ordinary(" " + " ".join(distinct.to_pylist())), "<u2")
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(pc.binary_length(distinct).to_numpy() + 1), "left") + 1
        begins = np.concatenate([[0], ends[:-1]])
        lengths = (ends - begins)[index]
        at = starts_of(lengths)
        flat = ids[np.arange(at[-1]) - np.repeat(at[:-1] - begins[index], lengths)].tobytes()
        rows = starts_of(pc.list_value_length(split).to_numpy())
        out = []
        for text, own, a, b in zip(texts.to_pylist(), lone.tolist(), rows[:-1].tolist(), rows[1:].tolist()):
            if own or not text:
                out.append(self.whole(text))
            else:
                head = text.partition(" ")[0]
                out.append((self.whole(head) if head else b"") + flat[2 * at[a + 1] : 2 * at[b]])
        return out


@lru_cache(maxsize=2)
def encoder_of(vocabulary: str) -> Encoder:
    """The encoder of a worker process, kept between its tasks."""
    return Encoder(vocabulary)


def train_dictionary(docs: DataFrame, vocabulary: str = VOCABULARY, train_pieces: int = TRAIN_PIECES) -> bytes:
    """A zstandard dictionary from the sampled pieces; empty only where there is no text at all."""
    text = F.col("text").cast("string")
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((F.length("text") - 1) / PIECE_CHARS).cast("bigint"))
    pieces = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).where("length(text) > 0").select("doc_id", "text", F.explode(numbers).alias("piece"))
    keyed = pieces.withColumn("h", F.xxhash64("doc_id", "piece", F.length("text")))
    # hashes first: what a task sends is then small, however many tasks there are
    cut = keyed.select("h").orderBy("h").limit(train_pieces).agg(F.max("h")).first()[0]
    own = F.substring("text", (F.col("piece") * PIECE_CHARS + 1).cast("int"), F.lit(PIECE_CHARS))
    sample = keyed.where(F.col("h") <= F.lit(cut).cast("bigint")).select("h", own.alias("own")).orderBy("h", "own").limit(train_pieces)
    samples = [x for x in encoder_of(vocabulary).encode(pa.array([r.own for r in sample.collect()], pa.string())) if x]
    return trained(samples)


def trained(samples: list[bytes]) -> bytes:
    """The dictionary of the samples, which are repeated where they are too few for the trainer."""
    times = 1
    while samples:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples * times, k=200, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            if times * sum(map(len, samples)) > 1 << 24:
                raise
            times *= 4
    return b""


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT) if data else None


def dictionary_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def encode_documents(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, train_pieces: int = TRAIN_PIECES) -> DataFrame:
    """Write the shards of ``docs`` under ``folder`` (one of its own in the shared folder by default); the offset index.

    Encoding is map-only. A task writes under a name of its own attempt and
    moves the finished file into place, so a task that is run again leaves one
    whole file.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/codestrata/tokens-{uuid.uuid4().hex}"
    data = train_dictionary(docs, vocabulary, train_pieces)
    name = dictionary_hash(data)
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}.dict") as out:
        out.write(data)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shared, offset = encoder_of(vocabulary), as_dictionary(data), 0
        if shared:
            shared.precompute_compress(level=LEVEL)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True).compress
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        shard, draft = f"{TaskContext.get().partitionId():06d}.tok", f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            for part in byte_chunks(batches, most=2_000_000):
                ids = encoder.encode(part.column(1))
                frames = [compress(x) for x in ids]
                out.write(b"".join(frames))
                lengths, n = np.array([len(x) for x in frames], np.int64), len(frames)
                ends = offset + np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 2 for x in ids], pa.int32()), pa.array([f"{folder}/{shard}"] * n, pa.string()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int32()), pa.array([name] * n, pa.string())], schema=SHAPE
                )
                offset = int(ends[-1])
        fs.move(draft, f"{root}/{shard}") if offset else fs.delete_file(draft)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return save(slim.mapInArrow(encode, INDEX), "token-index")


def decode(frame: bytes, dictionary: bytes) -> np.ndarray:
    """The ids of one frame."""
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=as_dictionary(dictionary)).decompress(frame), "<u2")


def read_document(shard: str, byte_offset: int, byte_length: int, dictionary_hash: str) -> np.ndarray:
    """The ids of one document from its shard file, reading its bytes only."""
    fs, path = pyarrow.fs.FileSystem.from_uri(shard)
    with fs.open_input_file(f"{path.rsplit('/', 1)[0]}/{dictionary_hash}.dict") as f:
        dictionary = f.read()
    with fs.open_input_file(path) as f:
        return decode(f.read_at(byte_length, byte_offset), dictionary)


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
