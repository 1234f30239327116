"""Operator 8: token ids in binary packs under one shared zstandard dictionary.

A dictionary is trained on the serialised id arrays of a bounded sample (`SAMPLE_DOCS` documents with the smallest hash
of their id among those of at most `SAMPLE_BYTES` bytes). Texts are encoded and compressed in the tasks that read them,
every document as a frame of its own, and the frames are staged, so that frames and no texts are shuffled. Documents are
range-partitioned by id; a task writes its documents, in order, into packs of about `PACK_BYTES`. A short document is read
by its place in the pack's offset index, without its neighbours.

A pack, little-endian: magic "OFT1", id width (2 or 4), SHA-256 of the dictionary, number of documents; then per document
its id (and whether it has one), number of ids and end offset in the frames; then the frames. Packs are rows of a Parquet
table (shard, pack, n_docs, n_tokens, blob), so that Spark's commit protocol covers lost executors and any file system
that Spark writes will do. The dictionary is a one-row table beside it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE, documents, shared_dir, slices, staged, text_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 1 << 16
DICTIONARY_BYTES = 1 << 15
PACK_BYTES = 1 << 20
LEVEL = 3
#: Entries of a worker's memory of white-space separated chunks.
MEMO = 1_000_000
MAGIC = b"OFT1"
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n", "<u8"), ("end", "<u8")])

#: A word of one id that stands between chunks which are encoded together, and how many are.
MARK, TOGETHER = "\u2764", 500


class Encoder:
    """Ids of whole texts. White space is dropped by the vocabulary's own rules and no match crosses it, so the library
    encodes chunks between ASCII white space, each distinct one of a slice of texts once while it is remembered."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        whole = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.ids = lambda texts: [found.ids for found in whole(texts, add_special_tokens=False)]
        self.mark = self.ids([MARK])[0]

    def remember(self, chunks: list[str]) -> None:
        """Encode chunks, many in one text with the mark between them; those that hold the mark, one by one."""
        alone = [c for c in chunks if MARK in c] if len(self.mark) == 1 else chunks
        for chunk, ids in zip(alone, self.ids(alone)):
            self.memo[chunk] = np.array(ids, self.dtype).tobytes()
        chunks = [c for c in chunks if MARK not in c] if len(self.mark) == 1 else []
        for at in range(0, len(chunks), TOGETHER):
            part = chunks[at:at + TOGETHER]
            ids = np.array(self.ids([f" {MARK} ".join([*part, ""])])[0], self.dtype)
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) != len(part):
                raise RuntimeError("the mark is not a word of its own in this vocabulary")
            raw, width = ids.tobytes(), self.dtype.itemsize
            starts = [0, *(ends[:-1] + 1).tolist()]
            self.memo.update(zip(part, (raw[width * a:width * b] for a, b in zip(starts, ends.tolist()))))

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of every text, with the end id."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        parts = pc.ascii_split_whitespace(texts)
        chunks = parts.flatten().dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        known = list(map(memo.get, distinct))
        fresh = [k for k, ids in enumerate(known) if ids is None]
        self.remember([distinct[k] for k in fresh])
        for k in fresh:
            known[k] = memo[distinct[k]]
        width = self.dtype.itemsize
        ends = np.cumsum([0, *map(len, known), width]) // width  # the last list is the end id
        pool = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(known) + np.array([END_ID], self.dtype).tobytes(), self.dtype)))
        stop = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False) + 1)
        at = np.full(int(stop[-1]) if len(stop) else 0, len(known))
        inside = np.ones(len(at), bool)
        inside[stop - 1] = False
        at[inside] = chunks.indices.to_numpy(zero_copy_only=False)
        lists = pool.take(pa.array(at))
        raw = lists.flatten().to_numpy().tobytes()
        stop = (lists.offsets.to_numpy().astype(np.int64)[stop] * width).tolist()
        return [raw[a:b] for a, b in zip([0, *stop], stop)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder per worker process: its memory outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(rows: DataFrame, vocabulary: str) -> DataFrame:
    """ids (binary, in the vocabulary's width) of rows doc_id, h, text."""

    def run(batches):
        encoder = encoder_of(vocabulary)
        for part in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([pa.array(encoder.encode(part.column(2)), pa.binary())], names=["ids"])

    return rows.mapInArrow(run, "ids binary")


def train_dictionary(rows: DataFrame, vocabulary: str) -> bytes:
    """rows: doc_id, h, text. A small or empty sample gives a dictionary of its raw bytes, or none."""
    short = rows.where(F.octet_length("text") <= SAMPLE_BYTES)
    place = F.struct(F.xxhash64("doc_id"), "doc_id", "h")
    cut = short.select(place.alias("place")).orderBy("place").limit(SAMPLE_DOCS).agg(F.max("place").alias("cut"))  # one row
    sample = short.join(F.broadcast(cut), place <= F.col("cut")).select("doc_id", "h", "text").limit(SAMPLE_DOCS)  # ties are equal texts
    arrays = sorted(bytes(r["ids"]) for r in encode_texts(sample, vocabulary).toLocalIterator())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:DICTIONARY_BYTES]


def compress_texts(rows: DataFrame, vocabulary: str, raw: bytes) -> DataFrame:
    """doc_id, h, n (number of ids) and frame of rows doc_id, h, text."""

    def run(batches):
        encoder = encoder_of(vocabulary)
        dictionary = _dictionary(raw)
        if dictionary:
            dictionary.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        for part in slices(batches, 2, 2 * SLICE):
            ids = encoder.encode(part.column(2))
            n = pa.array([len(x) // encoder.dtype.itemsize for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, pa.array(map(compressor.compress, ids), pa.binary())],
                                             names=["doc_id", "h", "n", "frame"])

    return rows.mapInArrow(run, "doc_id long, h long, n long, frame binary")


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_packs(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> None:
    """Write the documents' ids under path/packs, the dictionary under path/dictionary.

    Null text counts as empty; every document has at least the end id. Rows without an id come first; rows with equal ids
    stand in order of their texts' hash. An empty table writes no packs; extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text_of(docs, text_col)).alias("h"), text_of(docs, text_col).alias("text"))
    raw = train_dictionary(rows, vocabulary)
    framed = staged(compress_texts(rows, vocabulary, raw), "frames")
    width = encoder_of(vocabulary).dtype.itemsize
    digest = hashlib.sha256(raw).digest()
    spark.createDataFrame([(digest.hex(), raw)], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches):
        shard = TaskContext.get().partitionId()
        index, frames, size, number = [], [], 0, 0

        def pack():
            head = MAGIC + struct.pack("<B", width) + digest + struct.pack("<Q", len(index))
            blob = head + np.array(index, ENTRY).tobytes() + b"".join(frames)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([len(index)], pa.int64()),
                 pa.array([sum(x[2] for x in index)], pa.int64()), pa.array([blob], pa.binary())],
                names=["shard", "pack", "n_docs", "n_tokens", "blob"])

        for part in slices(batches, 2):
            for doc_id, n, frame in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                frames.append(frame)
                size += len(frame)
                index.append((doc_id or 0, doc_id is not None, n, size))
                if size >= PACK_BYTES:
                    yield pack()
                    index, frames, size, number = [], [], 0, number + 1
        if index:
            yield pack()

    order = ["doc_id", "h"]
    (framed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "frame")
     .mapInArrow(run, "shard int, pack long, n_docs long, n_tokens long, blob binary")
     .write.parquet(f"{path}/packs"))


class Pack:
    """Reader of one pack."""

    def __init__(self, blob: bytes, dictionary: bytes):
        width, = struct.unpack_from("<B", blob, 4)
        if blob[:4] != MAGIC or blob[5:37] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a pack of this dictionary")
        count, = struct.unpack_from("<Q", blob, 37)
        self.index = np.frombuffer(blob, ENTRY, count, 45)
        self.frames = memoryview(blob)[45 + ENTRY.itemsize * count:]
        self.dtype = np.dtype(f"<u{width}")
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at this place; only its own frame is read."""
        start = int(self.index[place - 1]["end"]) if place else 0
        entry = self.index[place]
        raw = self.reader.decompress(self.frames[start:int(entry["end"])], max_output_size=int(entry["n"]) * self.dtype.itemsize)
        return np.frombuffer(raw, self.dtype)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """shard, pack, doc_id, local (ids before the document in its pack), n_tokens, ids (binary, unsigned 32-bit
    little-endian), in no set order; with_starts() adds the place in the whole."""
    raw = spark.read.parquet(f"{path}/dictionary").select("dictionary").first()[0]  # DICTIONARY_BYTES at most
    schema = "shard int, pack long, n_docs long, n_tokens long, blob binary"
    packs = spark.read.schema(schema).parquet(f"{path}/packs")

    def run(batches):
        for batch in batches:
            for shard, number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                pack = Pack(blob.as_py(), bytes(raw))
                before = 0
                for at in range(0, len(pack.index), 256):
                    part = pack.index[at:at + 256]
                    ids = [pack.ids(at + k).astype("<u4").tobytes() for k in range(len(part))]
                    starts = before + np.concatenate(([0], np.cumsum(part["n"].astype(np.int64))))
                    before = int(starts[-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(part), pa.int32()), pa.array([number] * len(part), pa.int64()),
                         pa.array(part["doc_id"].copy(), mask=part["has_id"] == 0), pa.array(starts[:-1]),
                         pa.array(part["n"].astype(np.int64)), pa.array(ids, pa.binary())],
                        names=["shard", "pack", "doc_id", "local", "n_tokens", "ids"])

    return packs.select("shard", "pack", "blob").mapInArrow(
        run, "shard int, pack long, doc_id long, local long, n_tokens long, ids binary")


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """rows (shard, pack, local, ...) with start: ids of all documents before."""
    base = offsets(rows.sparkSession.read.parquet(f"{path}/packs").select("shard", "pack", "n_tokens"))
    return rows.join(base, ["shard", "pack"]).withColumn("start", F.col("base") + F.col("local"))


def offsets(packs: DataFrame) -> DataFrame:
    """shard, pack, base: ids in all packs before. Shards are summed first, so no window holds all packs."""
    before = Window.unboundedPreceding, -1
    shards = (packs.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
              .select("shard", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(*before)), F.lit(0)).alias("base")))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("pack").rowsBetween(*before)), F.lit(0))
    return (packs.select("shard", "pack", inside.alias("inside")).join(shards, "shard")
            .select("shard", "pack", (F.col("base") + F.col("inside")).alias("base")))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_packs(documents(spark, sf_dir), path)
    digests = read_packs(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return with_starts(digests, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def plain_crc32(ids: list[int]) -> int:
    """Plain form of the digest, for tests."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
