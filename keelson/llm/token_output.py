"""Token ids in compressed shards with a shared dictionary.

Documents are put in ascending ``doc_id`` order by a range shuffle, encoded, and packed
into shards of bounded size.  Every document is one zstandard frame, compressed on its
own with a dictionary trained on serialized id arrays, so any document can be read
without its neighbours.  A shard is::

    b"KTS1" | ids' width in bytes u8 | SHA-256 of the dictionary (32 bytes)
    | documents n u32 | n + 1 frame offsets u64 | n id counts u32 | frames

A folder holds the shards as rows of a Parquet table (``part``, ``seq``: place in the
order; ``part_start``: ids before the shard inside its part; ``doc_ids``; ``payload``)
and the dictionary as a one-row table, so it can live in any store Spark reaches.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.session import scratch_path

from .encoding import CHUNK, tokenizers_encoder
from .text import chunks, pick

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
END_ID = 2
MAGIC = b"KTS1"
LEVEL = 3
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 20_000, 64 << 10    # bounds of the dictionary's training set
SHARD_DOCS, SHARD_BYTES = 2048, 4 << 20                                # a shard is closed at either
SHARDS = "part int, seq int, part_start long, n_docs int, n_ids long, doc_ids array<bigint>, payload binary"


def train_dictionary(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> bytes:
    """A dictionary trained on the id arrays of at most SAMPLE_DOCS documents.

    They are those of at most SAMPLE_CHARS characters with the smallest hash of their id.
    The dictionary changes sizes only, never what is read back.  Too little text to train
    on gives an empty dictionary: frames are then compressed without one.
    """
    d = pick(docs, doc_id="long", text="string").where(F.length("text").between(1, SAMPLE_CHARS))
    ids = [r[0] for r in d.select("doc_id").where(F.col("doc_id").isNotNull())
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    texts = [r[0] for r in d.where(F.col("doc_id").isin(ids)).select("text").limit(SAMPLE_DOCS).collect()] if ids else []
    if len(texts) < 16:
        return b""
    import zstandard
    enc = tokenizers_encoder(vocabulary)
    end = np.asarray([end_id], enc.dtype).tobytes()
    samples = [x + end for x in enc.encode_many(sorted(texts))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(frames: list[bytes], counts: list[int], width: int, dictionary_hash: bytes) -> bytes:
    """One shard from its documents' frames and id counts."""
    n = len(frames)
    offsets = np.zeros(n + 1, "<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:])
    head = MAGIC + struct.pack("<B", width) + dictionary_hash + struct.pack("<I", n)
    return b"".join([head, offsets.tobytes(), np.asarray(counts, "<u4").tobytes(), *frames])


class Shard:
    """Reader of one shard: ``len``, ``counts`` and ``ids(i)`` of any single document."""

    def __init__(self, payload: bytes, dictionary: bytes):
        import zstandard
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.dtype = np.dtype(f"<u{payload[4]}")
        if payload[5:37] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        n = struct.unpack_from("<I", payload, 37)[0]
        self.offsets = np.frombuffer(payload, "<u8", n + 1, 41)
        self.counts = np.frombuffer(payload, "<u4", n, 41 + 8 * (n + 1))
        self.body = 41 + 8 * (n + 1) + 4 * n
        self.payload = memoryview(payload)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.z = zstandard.ZstdDecompressor(dict_data=known)

    def __len__(self):
        return len(self.counts)

    def ids(self, i: int) -> np.ndarray:
        frame = self.payload[self.body + int(self.offsets[i]):self.body + int(self.offsets[i + 1])]
        raw = self.z.decompress(frame, max_output_size=int(self.counts[i]) * self.dtype.itemsize)
        return np.frombuffer(raw, self.dtype)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode every text (null: empty), append ``end_id``, and write shards to ``path``.

    Documents stand in ascending ``doc_id`` order, null ids first; rows with one id
    stand by the hash of their text, then in any order (they are equal).  Texts are
    encoded whole; one longer than a shard's bound is a shard of its own.  An empty
    table writes an empty table of shards.  Extra columns are ignored.
    """
    dictionary = train_dictionary(docs, vocabulary, end_id)
    spark = docs.sparkSession
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary)],
                          "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches):
        import zstandard
        enc = tokenizers_encoder(vocabulary)
        width, end = enc.dtype.itemsize, np.asarray([end_id], enc.dtype).tobytes()
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        digest, part = hashlib.sha256(dictionary).digest(), TaskContext.get().partitionId()
        seq = part_start = 0
        ids, frames, counts, size = [], [], [], 0

        def close():
            nonlocal seq, part_start, ids, frames, counts, size
            row = pa.record_batch([pa.array([x], t) for x, t in (
                (part, pa.int32()), (seq, pa.int32()), (part_start, pa.int64()), (len(ids), pa.int32()),
                (sum(counts), pa.int64()), (ids, pa.list_(pa.int64())),
                (pack(frames, counts, width, digest), pa.binary()))], names=[x.split()[0] for x in SHARDS.split(", ")])
            seq, part_start = seq + 1, part_start + sum(counts)
            ids, frames, counts, size = [], [], [], 0
            return row

        for b in batches:
            for first, last in chunks(b.column(1), CHUNK):
                tokens, bounds = enc.encode(b.column(1).slice(first, last - first))
                doc_ids = b.column(0).slice(first, last - first).to_pylist()
                for doc_id, at, to in zip(doc_ids, bounds[:-1].tolist(), bounds[1:].tolist()):
                    frame = z.compress(tokens[at:to].tobytes() + end)
                    if ids and (len(ids) >= SHARD_DOCS or size + len(frame) > SHARD_BYTES):
                        yield close()
                    ids.append(doc_id)
                    frames.append(frame)
                    counts.append(to - at + 1)
                    size += len(frame)
        if ids:
            yield close()

    d = pick(docs, doc_id="long", text="string")
    d = d.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    d = d.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    d.mapInArrow(run, SHARDS).write.option("compression", "none").parquet(f"{path}/shards")


def read_shards(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """Shards of ``path`` with ``start`` (ids before the shard), and the dictionary.

    The only window without a partition is over one row per part.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    from pyspark.sql import Window
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row of 12 bytes per writing task
    return shards.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + F.col("part_start")), dictionary


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, decoded from the files of ``path``."""
    shards, dictionary = read_shards(spark, path)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "n_bytes"]

    def run(batches):
        for b in batches:
            for doc_ids, start, payload in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                shard = Shard(payload.as_py(), dictionary)
                n = shard.counts.astype(np.int64)
                crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in range(len(shard))]
                yield pa.record_batch([
                    pa.array(doc_ids.as_py(), pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n),
                    pa.array(crc, pa.int64()), pa.array(np.diff(shard.offsets).astype(np.int64))], names=names)

    return shards.select("doc_ids", "start", "payload").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def document_ids(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each of its rows): reads the shards whose ids hold it, decodes one frame."""
    shards, dictionary = read_shards(spark, path)
    rows = shards.where(F.array_contains("doc_ids", doc_id)).orderBy("part", "seq").select("doc_ids", "payload")
    return [Shard(bytes(r["payload"]), dictionary).ids(i).tolist()
            for r in rows.toLocalIterator() for i, x in enumerate(r["doc_ids"]) if x == doc_id]


def token_output(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` to ``path`` (default: a new folder in the shared one) and describe what was read back."""
    path = path or scratch_path(docs.sparkSession, f"tokens-{uuid.uuid4().hex}")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
