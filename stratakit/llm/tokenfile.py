"""Token-id files: every document compressed by itself with a shared zstandard dictionary.

A shard holds consecutive documents in ascending doc_id order as one binary blob::

    magic "STKTOK02" | u8 bytes an id (2 or 4) | u32 documents | u64 dictionary hash
    | i64 doc_id[n] | u64 id offset[n] | u64 frame offset[n + 1] | frames

Id offsets count the ids of all documents before in the part (the shards of one range of doc_id); the manifest holds
each part's offset. Frame offsets are bytes from the first frame. ``lookup`` reads short documents: the range of ids that
each shard is stored with prunes row groups and pages in the scan, the shard's index gives the place, and one small frame
is decompressed. The dictionary is trained on serialized id arrays of pieces of a bounded sample (``sample_docs``
documents of smallest id hash, ``sample_chars`` characters from a place given by the hash); it does not see every row,
which bears on the compression alone. Files hold its hash and readers refuse another. Documents are shuffled once, as
text, by range of doc_id, text hash and row, in parts of some ``part_bytes`` of text, so an id that a third of all rows
share is spread over parts; ids are made, packed and written where they land. Shards, manifest and dictionary are
written by Spark as Parquet rows, so any store Spark writes to will do, and lost tasks are written again.

Defined cases: null text has no ids but its end id; null doc_id sorts first and is stored as the least long; repeated
rows are all kept, side by side, and rows that share a doc_id come in order of text hash; a very long text is one frame;
an empty table gives an empty file set. Only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakit.llm.common import work_path
from stratakit.llm.tokens import default_path, encoder

MAGIC = b"STKTOK02"
_HEAD = 21
NULL_ID = -(1 << 63)
_SHARD_SCHEMA = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("content", pa.binary())])


def train_dictionary(docs: DataFrame, path: str, width: int, sample_docs: int = 1500, sample_chars: int = 8192, size: int = 32 << 10) -> bytes:
    """Dictionary bytes; empty where the sample is too small to train on."""
    picked = docs.select(F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id").limit(sample_docs)
    edge = picked.agg(F.max("h").alias("h")).first().h
    if edge is None:
        return b""
    # rows, not ids, are many where ids repeat, so the limit holds for both
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)).cast("int") + 1
    rows = docs.where(F.xxhash64("doc_id") <= edge).select("doc_id", F.substring("text", start, F.lit(sample_chars)).alias("text")).orderBy("doc_id", "text").limit(sample_docs)
    heads = [narrowed(x, width) for x in encoder(path).encode([r.text for r in rows.toLocalIterator()])]
    try:
        return zstandard.train_dictionary(size, [h for h in heads if h]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def narrowed(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def id_width(path: str) -> int:
    return 2 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else 4


def dictionary_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw)


def pack_shard(doc_ids: list[int], starts: list[int], ids: list[bytes], dictionary: bytes, width: int = 2, level: int = 3) -> bytes:
    """A shard of id arrays with ``width`` bytes an id."""
    pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_dict_id=False)
    frames = [pack.compress(x) for x in ids]
    at = np.cumsum([0, *map(len, frames)], dtype="<u8")
    return b"".join([MAGIC, struct.pack("<BIQ", width, len(ids), dictionary_hash(dictionary)), np.array(doc_ids, "<i8").tobytes(), np.array(starts, "<u8").tobytes(), at.tobytes(), *frames])


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, blob: bytes, dictionary: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        self.width, n, digest = struct.unpack_from("<BIQ", blob, 8)
        if digest != dictionary_hash(dictionary):
            raise ValueError("the shard was written with another dictionary")
        self.doc_ids = np.frombuffer(blob, "<i8", n, _HEAD)
        self.starts = np.frombuffer(blob, "<u8", n, _HEAD + 8 * n)
        self.at = np.frombuffer(blob, "<u8", n + 1, _HEAD + 16 * n)
        self.body = memoryview(blob)[_HEAD + 24 * n + 8 :]
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> bytes:
        """Little-endian 32-bit ids of the k-th document."""
        raw = self.unpack.decompress(self.body[self.at[k] : self.at[k + 1]])
        return raw if self.width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()

    def find(self, doc_id: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.doc_ids, doc_id))
        return np.frombuffer(self.ids(k), "<u4") if k < len(self) and self.doc_ids[k] == doc_id else None


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, shard_bytes: int = 4 << 20, part_bytes: int = 16 << 20) -> None:
    """Write ``path``/shards, ``path``/manifest and ``path``/dictionary."""
    spark = docs.sparkSession
    file = tokenizer or default_path()
    width = id_width(file)
    tail = end_id.to_bytes(width, "little")
    dictionary = train_dictionary(docs, file, width)
    parts = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at, size = TaskContext.get().partitionId(), 0, 0, 0
        held: tuple[list, list, list] = ([], [], [])
        tokens = 0

        def shard():
            blob = pack_shard(*held, dictionary, width)
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [number], "first_doc": [held[0][0]], "last_doc": [held[0][-1]], "n_docs": [len(held[0])], "n_tokens": [tokens], "content": [blob]}, _SHARD_SCHEMA)

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                for doc, ids in zip(some.column(0).to_pylist(), encoder(file).encode(some.column(1).to_pylist()), strict=True):
                    if size > shard_bytes:
                        yield shard()
                        number, tokens, size = number + 1, 0, 0
                        held = ([], [], [])
                    ids = narrowed(ids, width) + tail
                    held[0].append(NULL_ID if doc is None else doc)
                    held[1].append(at)
                    held[2].append(ids)
                    at += len(ids) // width
                    tokens += len(ids) // width
                    size += len(ids)
        if held[0]:
            yield shard()

    # ranges in order: partition numbers are part numbers
    keys = ["doc_id", "of", "row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("of"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    rows.mapInArrow(pack, "part int, shard int, first_doc long, last_doc long, n_docs int, n_tokens long, content binary").write.option("compression", "uncompressed").parquet(f"{path}/shards")
    # one number per part of some ``part_bytes``
    sums = spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/manifest")
    spark.createDataFrame([(bytearray(dictionary), f"{dictionary_hash(dictionary):016x}")], "dictionary binary, hash string").coalesce(1).write.parquet(f"{path}/dictionary")


_READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def _documents(shard: Shard, base: int, picks: np.ndarray) -> pa.RecordBatch:
    ids = [shard.ids(k) for k in picks.tolist()]
    doc = pa.array([None if d == NULL_ID else d for d in shard.doc_ids[picks].tolist()], pa.int64())
    return pa.RecordBatch.from_arrays([doc, pa.array(shard.starts[picks].astype(np.int64) + base), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def _with_base(spark: SparkSession, path: str, most_parts: int = 2_000_000) -> tuple[DataFrame, bytes]:
    """part, base and content of the shards, and the dictionary. The manifest, two numbers a part, is broadcast up to ``most_parts``."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    manifest = spark.read.parquet(f"{path}/manifest")
    shards = spark.read.parquet(f"{path}/shards")
    return shards.join(F.broadcast(manifest) if manifest.count() <= most_parts else manifest, "part"), dictionary


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, from the files."""
    shards, dictionary = _with_base(spark, path)

    def run(batches):
        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(blob.as_py(), dictionary)
                for lo in range(0, len(shard), 1000):
                    yield _documents(shard, base, np.arange(lo, min(lo + 1000, len(shard))))

    return shards.select("base", "content").mapInArrow(run, _READ_SCHEMA)


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """The rows of ``read_tokens`` for a few doc_ids: only shards whose range holds one are read, and only its frames unpacked."""
    shards, dictionary = _with_base(spark, path)
    wanted = np.unique(np.array([NULL_ID if d is None else d for d in doc_ids], np.int64))
    hit = F.lit(False)
    for d in wanted.tolist():
        hit = hit | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))

    def run(batches):
        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(blob.as_py(), dictionary)
                picks = np.flatnonzero(np.isin(shard.doc_ids, wanted))
                if len(picks):
                    yield _documents(shard, base, picks)

    return shards.where(hit).select("base", "content").mapInArrow(run, _READ_SCHEMA)


def token_digests(docs: DataFrame) -> DataFrame:
    """Write the documents' token files in the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    path = work_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
