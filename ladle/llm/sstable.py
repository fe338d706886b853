"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of id. Layout, little-endian throughout:

    header   magic, version u16, bytes of a token id u16
    blocks   entries, then crc32 u32 of them; an entry: bytes of its key shared with the key before,
             bytes not shared, bytes of its value (all varint), the rest of the key, the value
    index    per block: length of first key u16, first key, offset u64, bytes u32, entries u32, ids u64
    filter   a Bloom filter over keys: number of hashes u32, then its bits
    footer   offsets of index and filter u64, number of blocks, entries, ids u64, crc32 of index and
             filter u32, magic

A key is the id with its sign bit flipped, big-endian, so that bytes sort as ids do; the key of a
null id is empty and sorts first. A value is the document's ids.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladle.llm import text as words
from ladle.llm.storage import bound_batches, give_back, materialize, new_path
from ladle.llm.tokens import vocabulary_size, word_encoder

MAGIC = b"LADLESST"
HEADER = struct.Struct("<8sHH")
INDEX = struct.Struct("<QIIQ")
FOOTER = struct.Struct("<QQQQQI8s")
BLOCK_BYTES = 1 << 16
#: Bytes of text whose distinct words are looked up together, so that a frequent word is looked up once for all of them.
LOOKUP_BYTES = 1 << 21
#: The ranges of so many shards may be given to every task of a lookup.
BROADCAST_SHARDS = 1_000_000
#: Bits of the Bloom filter per key, and its hashes: one absent key in a hundred gets through.
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(id_: int | None) -> bytes:
    return b"" if id_ is None else struct.pack(">Q", (id_ + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries, which come in order of their keys, to an open file. Holds one block, the index and the keys' filter hashes."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = out.write(HEADER.pack(MAGIC, 1, width))
        self.block, self.first, self.last, self.entries, self.ids = bytearray(), b"", b"", 0, 0
        self.index: list[tuple] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()
        if self.entries:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), min(len(key), len(self.last)))
        else:
            shared, self.first = 0, key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.ids += len(value) // self.width
        self.keys.append(key)

    def _close_block(self) -> None:
        data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
        self.index.append((self.first, self.at, len(data), self.entries, self.ids))
        self.at += self.out.write(data)
        self.block, self.entries, self.ids = bytearray(), 0, 0

    def close(self) -> tuple[int, int]:
        """Number of entries and ids of the shard."""
        if self.entries:
            self._close_block()
        index = b"".join(struct.pack("<H", len(k)) + k + INDEX.pack(*rest) for k, *rest in self.index)
        bits = np.zeros(max(64, len(self.keys) * BLOOM_BITS + 7 & ~7), dtype=np.uint8)
        for key in self.keys:
            bits[_probes(key, len(bits))] = 1
        bloom = struct.pack("<I", BLOOM_HASHES) + np.packbits(bits).tobytes()
        n, ids = len(self.keys), sum(x[4] for x in self.index)
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, self.at + len(index), len(self.index), n, ids, zlib.crc32(index + bloom), MAGIC))
        return n, ids


class ShardReader:
    """Reads a shard from an open, seekable file: all of it in order, or one key by binary search."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        self.index_at, self.bloom_at, self.n_blocks, self.n_entries, self.n_ids, crc, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        data = self._read(self.index_at, size - FOOTER.size - self.index_at)
        head = HEADER.unpack(self._read(0, HEADER.size))
        if magic != MAGIC or head[0] != MAGIC or zlib.crc32(data) != crc:
            raise ValueError("not a whole shard")
        self.width, self.index, at = head[2], [], 0
        for _ in range(self.n_blocks):
            n = struct.unpack_from("<H", data, at)[0]
            self.index.append((data[at + 2 : at + 2 + n], *INDEX.unpack_from(data, at + 2 + n)))
            at += 2 + n + INDEX.size
        self.firsts = [x[0] for x in self.index]
        self.bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=self.bloom_at - self.index_at + 4))

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, entries, _ = self.index[k]
        data = self._read(at, size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        at, key = 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + size]
            at += rest + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(self.n_blocks):
            yield from self._block(k)

    def get(self, key: bytes) -> list[bytes]:
        """Values of a key: one as a rule, several if ids repeat, none if it is absent."""
        if not self.n_blocks or not self.bits[_probes(key, len(self.bits))].all():
            return []
        found = []
        for k in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            found += [v for x, v in self._block(k) if x == key]
        return found


def _open(uri: str):
    return pa.fs.FileSystem.from_uri(uri)


def _write(directory: str, tokenizer_path: str, width: int, end_id: int, cache_words: int | None, keep: bool):
    def run(batches):
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        if not keep:
            give_back()  # of other stages
        encoder, end = word_encoder(tokenizer_path, width, cache_words), int(end_id).to_bytes(width, "little")
        uri = f"{directory}/shard-{shard:06d}-{attempt}.sst"
        writer = out = None
        first = last = None
        for batch in batches:
            at, data = words.string_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            row = 0
            while row < len(ids):
                # some texts at a time: their words share a look into the cache
                to = max(row + 1, int(np.searchsorted(at, at[row] + LOOKUP_BYTES, side="right")) - 1)
                texts = [encoder.words(data[at[i] : at[i + 1]].tobytes()) for i in range(row, to)]
                known = encoder.ids(texts)
                for id_, t in zip(ids[row:to], texts):
                    if writer is None:
                        fs, path = _open(uri)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(path)
                        writer, first = ShardWriter(out, width), id_
                    writer.add(key_of(id_), b"".join(map(known.__getitem__, t)) + end)
                    last = id_
                row = to
            if not keep:
                texts = known = at = data = None
                give_back()
        if not keep:
            encoder = None
            word_encoder.cache_clear()
            give_back()
        if writer is not None:
            n, total = writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([uri]), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["shard", "path", "first_id", "last_id", "n_docs", "n_ids"])

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, directory: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, cache_words: int | None = None, keep: bool = True) -> DataFrame:
    """Encodes whole texts and writes them to shards, in ascending order of id over all shards.

    Returns the manifest, one row per shard: (shard, path, first_id, last_id, n_docs, n_ids, start), start
    being the number of ids in the shards before. Each document ends with end_id. directory: a new folder
    in the shared one by default. A null text has end_id only; a null id comes first; rows that share an id
    follow each other by text. An empty table has no shards. A task writes under a name of its own, and only the names
    in the manifest count, so that a repeated task does no harm. Other columns are not looked at. cache_words: see ``WordEncoder``. keep: workers keep the encoder and its
    words from task to task, which saves time and takes memory of whatever runs on them next.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    directory = directory or new_path(spark, "shards")
    width = 2 if max(vocabulary_size(tokenizer_path), end_id + 1) <= 1 << 16 else 4
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = given.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    written = materialize(ordered.mapInArrow(_write(directory, tokenizer_path, width, end_id, cache_words, keep), "shard long, path string, first_id long, last_id long, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches):
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, path = _open(uri)
            with fs.open_input_file(path) as source:
                shard, rows = ShardReader(source), []
                for k in range(shard.n_blocks):
                    for key, value in shard._block(k):
                        n = len(value) // shard.width
                        rows.append((id_of(key), start, n, value if shard.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()))
                        start += n
                    if len(rows) >= 256 or k + 1 == shard.n_blocks:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "start", "n_tokens", "ids"])
                        rows = []


def read_shards(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the shards; ids are little-endian unsigned 32-bit integers."""
    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(_read, "id long, start long, n_tokens long, ids binary")


def _find(batches):
    for batch in batches:
        uri = None
        for path_, id_ in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if path_ != uri:
                uri = path_
                fs, path = _open(uri)
                shard = ShardReader(fs.open_input_file(path))
            values = [np.frombuffer(v, f"<u{shard.width}").astype("<u4").tobytes() for v in shard.get(key_of(id_))]
            if values:
                yield pa.RecordBatch.from_arrays([pa.array([id_] * len(values), pa.int64()), pa.array(values, pa.binary())], ["id", "ids"])


def _ranged(firsts: np.ndarray, lasts: np.ndarray, numbers: np.ndarray):
    """Gives each id the shards whose range has it. Ranges follow each other, but neighbours may share an id."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            to, at = np.searchsorted(firsts, ids, side="right"), np.searchsorted(lasts, ids, side="left")
            n = np.maximum(to - at, 0)
            which = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(numbers[which])], ["id", "shard"])

    return run


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of the wanted documents that the shards hold. Each id is looked up in the shards whose
    range has it: the filter first, then a binary search of the index and one block.

    Ranges follow each other, as ``write_shards`` makes them. Up to BROADCAST_SHARDS of them (24 bytes each) are searched by every task; with more,
    every id is compared with every range. An empty manifest has nothing."""
    ids = wanted.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    shards = manifest.where("last_id is not null").select("shard", "path", F.coalesce("first_id", F.lit(-(1 << 63))).alias("first_id"), "last_id")
    if manifest.count() <= BROADCAST_SHARDS:
        bounds = shards.select("first_id", "last_id", "shard").orderBy("first_id", "last_id").toArrow()
        firsts, lasts, numbers = (bounds.column(k).to_numpy() for k in range(3))
        asked = ids.mapInArrow(_ranged(firsts, lasts, numbers), "id long, shard long").join(shards.select("shard", "path").hint("merge"), "shard")
    else:
        asked = ids.join(shards, (F.col("id") <= F.col("last_id")) & (F.col("first_id") <= F.col("id")))
    return asked.select("path", "id").repartition("path").sortWithinPartitions("path", "id").mapInArrow(_find, "id long, ids binary")
