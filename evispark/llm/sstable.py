"""Token ids in sorted-string-table shards.

A shard is one file, written through Spark's own file committer, and readable from any
store that Spark reads. Its parts, in order, each followed by one newline byte:

* data blocks: length and crc32 of the body (4 bytes each, little-endian), then the body
  compressed with zstandard. A body is a run of entries in key order: lengths of the
  prefix shared with the key before, of the rest of the key, and of the value (varints),
  then the rest of the key and the value. A value is the width of an id in bytes (2 or
  4) and the ids, little-endian;
* the sparse index: for each block its last key, place, size, documents and ids;
* the Bloom filter over keys: ten bits and seven probes a key;
* the footer of fixed size: magic, shard number, places and sizes of index and filter,
  numbers of documents and ids.

A key is the identifier with its sign bit turned, big-endian, so that byte order is
number order; a null identifier has the empty key, which sorts first. A manifest beside
the shards has each one's range of identifiers. A look-up takes the shards whose range
fits, asks the filter, then searches the index, then reads one block.

Defined cases: null and empty texts hold the end id only; repeated identifiers stay, as
neighbours, ordered by a hash of their text, and may lie in two shards; rows equal in
identifier and text are dealt by a draw of their own; an empty table gives no shard and an empty result; other columns are ignored. Memory: a task holds one
block of ids, and the index and keys' hashes of its shard; a reader holds one shard.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evispark.llm.common import pieces, read_table, shared_path, stored
from evispark.llm.pretokens import WordEncoder, byte_chars

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
MAGIC = b"IDSHARD1"
FOOTER = struct.Struct("<8sqqqqqqq")
BLOCK_BYTES = 1 << 18
PROBES, BITS_A_KEY = 7, 10


@lru_cache(maxsize=2)
def library_encoder(path: str) -> WordEncoder:
    """The tokenizers library's model, asked once for each distinct word while the word stays in the cache."""
    tokenizer = Tokenizer.from_file(path)
    model, chars = tokenizer.model, byte_chars()
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

    def encode_words(words):
        return [[t.id for t in model.tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(chars))] for w in words]

    return WordEncoder(path, public_tokenizers.PATTERN, special, encode_words)


def key_of(identifier: int | None) -> bytes:
    return b"" if identifier is None else struct.pack(">Q", (identifier + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def identifier_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_ids(x: np.ndarray) -> bytes:
    return b"\x02" + x.astype("<u2").tobytes() if not len(x) or x.max() < 65536 else b"\x04" + x.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype="<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def bloom_probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    step = (h >> 33) | 1
    return [(h + i * step) % bits for i in range(PROBES)]


class ShardWriter:
    """Yields the parts of one shard for entries that come in key order."""

    def __init__(self, number: int, block_bytes: int = BLOCK_BYTES):
        self.number, self.block_bytes = number, block_bytes
        self.body, self.last, self.docs, self.ids = bytearray(), b"", 0, 0
        self.index, self.hashes, self.at, self.all_docs, self.all_ids = [], [], 0, 0, 0

    def _part(self, data: bytes) -> bytes:
        self.at += len(data) + 1  # the newline that Spark's text writer adds
        return data

    def _block(self) -> bytes:
        body = zstandard.ZstdCompressor(level=3).compress(bytes(self.body))
        self.index.append((self.last, self.at, len(body) + 8, self.docs, self.ids))
        self.all_docs, self.all_ids = self.all_docs + self.docs, self.all_ids + self.ids
        self.body, self.docs, self.ids = bytearray(), 0, 0
        return self._part(struct.pack("<II", len(body), zlib.crc32(body)) + body)

    def add(self, key: bytes, ids: np.ndarray) -> Iterator[bytes]:
        shared = 0
        if self.docs:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = pack_ids(ids)
        self.body += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.docs, self.ids = key, self.docs + 1, self.ids + len(ids)
        self.hashes.append(key)
        if len(self.body) >= self.block_bytes:
            yield self._block()

    def close(self) -> Iterator[bytes]:
        if self.docs:
            yield self._block()
        if not self.all_docs:
            return
        index = b"".join(varint(len(k)) + k + b"".join(map(varint, rest)) for k, *rest in self.index)
        index_at = self.at
        yield self._part(index)
        bits = max(64, BITS_A_KEY * self.all_docs)
        bloom = np.zeros(bits, dtype=bool)
        for key in self.hashes:
            bloom[bloom_probes(key, bits)] = True
        packed, bloom_at = struct.pack("<q", bits) + np.packbits(bloom).tobytes(), self.at
        yield self._part(packed)
        yield FOOTER.pack(MAGIC, self.number, index_at, len(index), bloom_at, len(packed), self.all_docs, self.all_ids)


class Shard:
    """Reads one shard from its bytes, or from anything that has a length and gives slices; blocks are read when asked for."""

    def __init__(self, data):
        self.data = data
        footer = data[len(data) - FOOTER.size - 1 : len(data) - 1]
        magic, self.number, index_at, index_size, bloom_at, bloom_size, self.docs, self.ids = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, self.blocks, at = data[index_at : index_at + index_size], [], 0
        while at < index_size:
            size, at = read_varint(index, at)
            key, at = bytes(index[at : at + size]), at + size
            rest = []
            for _ in range(4):
                n, at = read_varint(index, at)
                rest.append(n)
            self.blocks.append((key, *rest))
        self.keys = [b[0] for b in self.blocks]
        self.bloom_at, self.bloom_size = bloom_at, bloom_size

    @cached_property
    def bloom(self) -> tuple[int, bytes]:
        found = self.data[self.bloom_at : self.bloom_at + self.bloom_size]
        return struct.unpack_from("<q", found)[0], found[8:]

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, size, _, _ = self.blocks[block]
        part = self.data[place : place + size]
        length, crc = struct.unpack_from("<II", part)
        body = part[8:]
        if length != len(body) or zlib.crc32(body) != crc:
            raise ValueError(f"block {block} of shard {self.number} is damaged")
        body = zstandard.ZstdDecompressor().decompress(body)
        at, key = 0, b""
        while at < len(body):
            shared, at = read_varint(body, at)
            rest, at = read_varint(body, at)
            size, at = read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest + size
            yield key, body[at - size : at]

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            for key, value in self._entries(i):
                yield key, unpack_ids(value)

    def may_hold(self, key: bytes) -> bool:
        bits, bloom = self.bloom
        return all(bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in bloom_probes(key, bits))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        found: list[np.ndarray] = []
        if not self.may_hold(key):
            return found
        for i in range(bisect_left(self.keys, key), len(self.blocks)):
            entries = list(self._entries(i))
            found += [unpack_ids(v) for k, v in entries if k == key]
            if entries[-1][0] > key:
                break
        return found


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, shard_bytes: int = 32 << 20) -> int:
    """Encode and write; returns the number of shards dealt.

    Texts, not ids, are shuffled by ranges of the identifier (and a hash of the text, so
    that an identifier with very many rows is dealt over shards); each task sorts, encodes
    and writes one shard of about ``shard_bytes`` of text.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    narrow = narrow.withColumn("draw", F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("short"))
    size = narrow.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    by = [F.col("doc_id"), F.xxhash64("text"), F.col("draw")]  # the draw parts rows that are equal in both

    def write(batches):
        encoder, writer = library_encoder(vocabulary), ShardWriter(TaskContext.get().partitionId())
        part = lambda data: pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])
        for batch in batches:
            for piece in pieces(batch, "text"):
                for identifier, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(piece.column("text").to_pylist())):
                    for data in writer.add(key_of(identifier), np.append(ids, np.uint32(end_id))):
                        yield part(data)
        for data in writer.close():
            yield part(data)

    dealt = narrow.repartitionByRange(shards, *by).sortWithinPartitions(*by)
    parts = dealt.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    parts.write.option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path)
    return shards


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("path", "content")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(file, shard, doc_id, local_start, ids_crc32, n_tokens) of every document, read back from the files."""

    def read(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                shard, rows, start = Shard(content.as_buffer().to_pybytes()), [], 0
                for key, ids in shard.scan():
                    rows.append((shard.number, identifier_of(key), start, zlib.crc32(ids.tobytes()), len(ids)))
                    start += len(ids)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(rows), pa.string()), *columns], names=["file", "shard", "doc_id", "local_start", "ids_crc32", "n_tokens"])

    return _shards(spark, path).mapInArrow(read, "file string, shard long, doc_id long, local_start long, ids_crc32 long, n_tokens long")


def write_manifest(spark: SparkSession, path: str, rows: DataFrame | None = None) -> None:
    """A row a shard beside the shards, in ``_manifest``: file, number, documents, nulls, and the least and greatest identifier."""
    rows = read_shards(spark, path) if rows is None else rows
    nulls = F.count_if(F.col("doc_id").isNull()).alias("nulls")
    ranges = rows.groupBy("shard", "file").agg(F.count("*").alias("docs"), nulls, F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")


def lookup(spark: SparkSession, path: str, identifiers: list[int | None]) -> list[tuple[int | None, list[int]]]:
    """(identifier, ids) of every document with one of the identifiers, a bounded list.

    The manifest names the shards whose range holds an identifier; of those the footer,
    the filter, the index and the blocks that the index points at are read, through
    Hadoop's file system, and nothing else.
    """
    wanted = [i for i in dict.fromkeys(identifiers) if i is not None]
    within = F.exists(F.array(*map(F.lit, wanted)), lambda x: x.between(F.col("low"), F.col("high"))) if wanted else F.lit(False)
    if None in identifiers:
        within = within | (F.col("nulls") > 0)
    found = []
    for r in spark.read.parquet(f"{path}/_manifest").filter(within).orderBy("shard").collect():  # shards that the bounded list meets
        with FileRange(spark, r["file"]) as data:
            shard = Shard(data)
            due = [i for i in wanted if r["low"] is not None and r["low"] <= i <= r["high"]] + [None] * (None in identifiers and r["nulls"] > 0)
            found += [(i, ids.tolist()) for i in due for ids in shard.get(key_of(i))]
    return found


class FileRange:
    """Slices of a file in any store that Hadoop reads; ``read`` counts the bytes asked for."""

    def __init__(self, spark: SparkSession, file: str):
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(file)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.size, self.stream, self.bytes_of, self.read = store.getFileStatus(path).getLen(), store.open(path), jvm.org.apache.commons.io.IOUtils.toByteArray, 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        self.stream.seek(part.start)
        self.read += part.stop - part.start
        return bytes(self.bytes_of(self.stream, part.stop - part.start))

    def __enter__(self) -> FileRange:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()


def with_starts(rows: DataFrame, group: int = 1024) -> DataFrame:
    """Adds ``start``: ids of all documents before, in order of shards. Sums run over shards, in groups, then over groups."""
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("shard") / group))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("group").agg(F.sum("n").alias("g")).select("group", F.coalesce(F.sum("g").over(before), F.lit(0)).alias("group_base"))
    inside = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(groups, "group")
    bases = bases.select("shard", (F.col("base") + F.col("group_base")).alias("base"))
    return rows.join(bases, "shard").withColumn("start", F.col("base") + F.col("local_start"))


def op2_sstable(spark, sf_dir) -> DataFrame:
    """Write every document's ids into shards, read them back and place each document."""
    path = shared_path(spark, "id-shards")
    write_shards(read_table(spark, sf_dir, "documents"), path)
    rows = stored(read_shards(spark, path), "id-rows")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
