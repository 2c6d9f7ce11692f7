"""Sorted-string-table shards of tokenised documents.

A shard holds the documents of one range of identifiers, in ascending order:

    data blocks   entries (shared key bytes, own key bytes, value length, own part of the key, value), the key
                  prefix-compressed against the entry before; every RESTART entries a whole key; the
                  restart offsets and their number end a block. A block is zstandard-compressed.
    index         last key, offset and stored length of each block
    filter        Bloom filter over the keys
    footer        fixed length: places of index and filter, number of documents and of ids, magic

A lookup reads the footer, index and filter once, asks the filter, searches the index and then the block's restarts
by bisection, and reads one block.

Values are ids as little-endian unsigned 16-bit integers. A table is a folder of shards and a manifest (Parquet, one row
for each shard). Each write attempt has a file name of its own and only the manifest makes a file part of the
table, so tasks that are repeated after the loss of an executor do no harm.

Defined cases: null text counts as empty (only the end id is stored); very long texts are encoded in stretches cut at white space
and stored whole; null identifiers sort before all others; repeated identifiers (ties) are kept side by side, ordered by the hash of
their text, and repeated rows are each stored; columns other than identifier and text are not read, whatever their names; an
empty table gives a manifest without rows.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import crc32_ids, cut, documents, filesystem, new_path
from .encoders import encoder

BLOCK_BYTES = 1 << 16
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQ8s")
_MAGIC = b"LXSST\x00\x01\n"
VOCABULARY, END_ID = "byte_bpe_50k.json", 2


def key_bytes(key: int | None) -> bytes:
    """An identifier as bytes that sort as the identifiers do, null first."""
    return b"\0" if key is None else b"\1" + (key + (1 << 63)).to_bytes(8, "big")


def key_value(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bloom_hashes(key: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    return h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1


def _bloom_places(a: int, b: int, bits: int) -> list[int]:
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Takes (key, value) in ascending order of keys and writes one shard to a binary stream."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.pack = stream, zstandard.ZstdCompressor(level=1)
        self.at = self.n = self.ids = 0
        self.block, self.restarts, self.last, self.in_block = bytearray(), [], b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = array("Q")  # two numbers for each key: where its bits lie in the filter

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.n or key != self.last:
            self.hashes.extend(_bloom_hashes(key))
        self.last, self.in_block, self.n, self.ids = key, self.in_block + 1, self.n + 1, self.ids + len(value) // 2
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        at, self.at = self.at, self.at + len(data)
        return at, len(data)

    def _end_block(self) -> None:
        if self.in_block:
            tail = b"".join(struct.pack("<I", x) for x in [*self.restarts, len(self.restarts)])
            self.index.append((self.last, *self._put(self.pack.compress(bytes(self.block) + tail))))
            self.block, self.restarts, self.in_block = bytearray(), [], 0

    def finish(self) -> None:
        self._end_block()
        index = self._put(b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index))
        bits = max(64, len(self.hashes) // 2 * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for k in range(0, len(self.hashes), 2):
            for p in _bloom_places(self.hashes[k], self.hashes[k + 1], bits):
                bloom[p >> 3] |= 1 << (p & 7)
        places = self._put(struct.pack("<Q", bits) + bytes(bloom))
        self._put(_FOOTER.pack(*index, *places, self.n, self.ids, _MAGIC))


class Shard:
    """A shard opened for lookups and for reading in order."""

    def __init__(self, uri: str):
        import zstandard

        system, path = filesystem(uri)
        self.file, self.unpack = system.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        ia, il, ba, bl, self.n, self.ids, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is no shard")
        data, at = self._read(ia, il), 0
        self.keys: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.keys.append(data[at : at + n])
            a, at = _read_varint(data, at + n)
            n, at = _read_varint(data, at)
            self.places.append((a, n))
        bloom = self._read(ba, bl)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _block(self, k: int) -> tuple[bytes, list[int], int]:
        data = self.unpack.decompress(self._read(*self.places[k]))
        n = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 * (n + 1)
        return data, list(struct.unpack_from(f"<{n}I", data, end)), end

    @staticmethod
    def _entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n]
            at += n

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(*_bloom_hashes(key), self.bits))

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key, by bisection over blocks and over the restarts of the first that can hold it."""
        out: list[bytes] = []
        if not self.may_hold(key):
            return out
        for k in range(bisect_left(self.keys, key), len(self.keys)):
            data, restarts, end = self._block(k)
            # the last restart whose whole key is below the one sought
            i = bisect_left(restarts, key, key=lambda at: next(self._entries(data, at, end))[0])
            for found, value in self._entries(data, restarts[max(0, i - 1)], end):
                if found > key:
                    return out
                if found == key:
                    out.append(value)
        return out

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.places)):
            data, _, end = self._block(k)
            yield from self._entries(data, 0, end)


def write_shard(uri: str, rows: Iterable[tuple[int | None, bytes]]) -> dict | None:
    """Writes one shard from rows in ascending order; None if there are none. Memory: a block, and the keys' filter."""
    rows = iter(rows)
    if (first := next(rows, None)) is None:
        return None
    system, path = filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as stream:
        w, last = Writer(stream), first[0]
        w.add(key_bytes(first[0]), first[1])
        for last, value in rows:
            w.add(key_bytes(last), value)
        w.finish()
    return {"path": uri, "first_key": first[0], "last_key": last, "n_docs": w.n, "n_ids": w.ids}


def write_table(docs: DataFrame, uri: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Encodes each whole text, appends end_id, and writes shards below uri; the manifest, in order of shards.

    One shuffle deals the texts out by range of (key, hash of the text): that order is total up to rows that are equal
    throughout, so repeated keys can be split over shards. Encoding happens while a task writes its shard."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h")
    end = np.array([end_id], "<u2").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        def entries():
            e = encoder(vocabulary)
            for b in batches:
                yield from zip(b.column(0).to_pylist(), e.encode(b.column(1), end), strict=True)

        shard = TaskContext.get().partitionId()
        if got := write_shard(f"{uri}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}.sst", entries()):
            yield pa.RecordBatch.from_pylist([got | {"shard": shard}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = rows.mapInArrow(run, "shard int, path string, first_key bigint, last_key bigint, n_docs bigint, n_ids bigint")
    manifest.repartition(1).write.parquet(f"{uri}/manifest")  # a row for each shard, in one file
    return docs.sparkSession.read.parquet(f"{uri}/manifest")


def scan_table(manifest: DataFrame, schema: str, make: Callable[[int | None, int, bytes], tuple]) -> DataFrame:
    """make(key, start, ids) for every document of a table, read from its shards; start counts the ids before it in the table."""
    # a row for each shard
    starts = cut(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("path", "start"), "op1-starts")
    n = max(1, starts.count())
    out = T.StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(out)
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), fields.types, strict=True)], schema=fields)
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                size = 0
                with Shard(path) as shard:
                    for k, v in shard:
                        rows.append(make(key_value(k), at, v))
                        at, size = at + len(v) // 2, size + len(v)
                        if size > 1 << 22:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return starts.repartition(n).mapInArrow(run, out)


def read_table(manifest: DataFrame) -> DataFrame:
    """All documents of a table from its shards: key, start (ids before it in the table), ids (binary, unsigned 16-bit)."""
    return scan_table(manifest, "key bigint, start bigint, ids binary", lambda k, at, v: (k, at, v))


def lookup(manifest: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The documents of given keys: bisection over the shards' ranges, then over a shard's blocks and restarts.

    The ranges (one row for each shard, not for each document) go to every task. Keys are sorted within a task, so that
    a shard is opened once, and one alone is open at a time."""
    ranges = sorted((key_bytes(r.last_key), key_bytes(r.first_key), r.path) for r in manifest.select("last_key", "first_key", "path").toLocalIterator())
    asked = keys.select(F.col(key).cast("bigint").alias("key")).distinct()

    def run(batches):
        import pyarrow as pa

        last = [x[0] for x in ranges]
        for b in batches:
            wanted: dict[int, list] = {}
            for k in b.column(0).to_pylist():
                i, kb = bisect_left(last, key_bytes(k)), key_bytes(k)
                while i < len(ranges) and ranges[i][1] <= kb:
                    wanted.setdefault(i, []).append((k, kb))
                    i += 1
            for i, own in sorted(wanted.items()):
                with Shard(ranges[i][2]) as shard:
                    out = [(k, v) for k, kb in own for v in shard.get(kb)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["key", "ids"])

    return asked.sortWithinPartitions("key").mapInArrow(run, "key bigint, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_table(documents(spark, sf_dir), new_path(spark, "op1-table"))
    digest = lambda k, at, v: (k, at, len(v) // 2, crc32_ids(np.frombuffer(v, "<u2")))
    return scan_table(manifest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", digest)
