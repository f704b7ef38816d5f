"""Token-id shards with a minimal perfect hash index from document keys to offsets.

A shard file holds, in this order: HEADER, the raw ids of its documents back to back (unsigned
little-endian, 2 bytes each if every id of the vocabulary fits, else 4), the keys in document order, the
index, and TRAILER with the places of these sections. The index is a minimal perfect hash function in
levels (each level keeps the keys that hit a bit alone and passes the rest on; Limasset et al., 2017)
and, by slot, a 32-bit fingerprint of the key, the offset of its first id, the number of ids and the
number of documents that have the key. Shards follow one another in ascending key order. Beside the shards lies a
directory: a row for each shard with its file, first and last key and first id. A look-up reads the directory's rows for a
key, the hash function of a shard once, and then one entry and one range of ids, whatever the size of the shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import TABLE_BYTES, LibraryEncoder, held, read_vocabulary
from .common import fresh_path, map_arrow, read_blobs, read_range, staged, table, texts_of, tuned, write_blobs

MAGIC, END = b"IDSHARD1", b"IDSHEND\n"
HEADER = struct.Struct("<8sIIQQ")  # magic, bytes of an id, end id, documents, ids
TRAILER = struct.Struct("<QQQQQ")  # places of payload, keys, hash function, its entries; bytes in all before END
SHARD_IDS = 4_000_000
END_ID = 2
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of integer keys (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + MIX[0] * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * MIX[1]
        z = (z ^ (z >> np.uint64(27))) * MIX[2]
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash function of distinct integer keys: each to its own slot of 0 .. n-1."""

    GAMMA = 2.0

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits) - bits + base)
            base += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], np.asarray(keys, np.int64)
        while rest.size:
            if len(levels) > 200:
                raise ValueError("the keys of a perfect hash must be distinct")
            m = max(64, -(-int(cls.GAMMA * rest.size) // 64) * 64)
            at = (mixed(rest, len(levels)) % np.uint64(m)).astype(np.int64)
            bits = np.bincount(at, minlength=m) == 1
            levels.append(bits)
            rest = rest[~bits[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys outside the set, any slot for the others (fingerprints tell)."""
        keys = np.asarray(keys, np.int64)
        out = np.full(keys.size, -1, np.int64)
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = (mixed(keys, k) % np.uint64(bits.size)).astype(np.int64)
            hit = (out < 0) & bits[at]
            out[hit] = rank[at[hit]]
        return out

    def pack(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<I", x.size) + np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes, at: int) -> tuple[PerfectHash, int]:
        (n,), at, levels = struct.unpack_from("<I", data, at), at + 4, []
        for _ in range(n):
            (m,), at = struct.unpack_from("<I", data, at), at + 4
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, m // 8, at)).astype(bool))
            at += m // 8
        return cls(levels), at


ENTRY = np.dtype([("mark", "<u4"), ("records", "<u4"), ("start", "<u8"), ("n", "<u8")])
NULL_KEY = np.iinfo(np.int64).min


class ShardIndex:
    """Keyed access to the documents of a shard: one slot to look at for any key."""

    def __init__(self, function: PerfectHash, entries: np.ndarray) -> None:
        self.function, self.entries = function, entries

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> ShardIndex:
        distinct, first, records = np.unique(keys, return_index=True, return_counts=True)
        starts = np.cumsum(counts) - counts
        function = PerfectHash.build(distinct)
        entries = np.zeros(distinct.size, ENTRY)
        slot = function.slots(distinct)
        entries["mark"][slot] = mixed(distinct, 255) & np.uint64(0xFFFFFFFF)
        entries["records"][slot], entries["start"][slot] = records, starts[first]
        entries["n"][slot] = np.add.reduceat(counts, first) if distinct.size else []
        return cls(function, entries)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key; records is 0 where the key isn't in the shard (but for one key in 2**32)."""
        out = np.zeros(len(keys), ENTRY)
        if self.entries.size and len(keys):
            slot = self.function.slots(keys)
            found = self.entries[np.maximum(slot, 0)]
            ok = (slot >= 0) & (found["mark"] == (mixed(keys, 255) & np.uint64(0xFFFFFFFF)).astype("<u4"))
            out[ok] = found[ok]
        return out

    def pack(self) -> tuple[bytes, bytes]:
        """The hash function and its entries."""
        return self.function.pack(), self.entries.tobytes()

    @classmethod
    def unpack(cls, function: bytes, entries: bytes) -> ShardIndex:
        return cls(PerfectHash.unpack(function, 0)[0], np.frombuffer(entries, ENTRY))


def pack_shard(keys: list[int | None], parts: list[bytes], width: int, end_id: int) -> bytes:
    """A shard (without END) of documents in ascending key order; parts: their ids with the end id."""
    counts = np.array([len(p) // width for p in parts], np.int64)
    plain = np.array([NULL_KEY if k is None else k for k in keys], np.int64)
    function, entries = ShardIndex.build(plain, counts).pack()
    sections = [HEADER.pack(MAGIC, width, end_id, len(keys), int(counts.sum())), b"".join(parts), plain.tobytes() + counts.tobytes(), function, entries]
    places = np.cumsum([len(x) for x in sections]).tolist()
    return b"".join([*sections, TRAILER.pack(*places[:-1], places[-1] + TRAILER.size)])


class Shard:
    """A shard read back: documents in order, or one by its key."""

    @staticmethod
    def head(data: bytes) -> tuple[int, int, int, int]:
        """Documents, ids, first and last key, without the rest."""
        _, _, _, n, n_ids = HEADER.unpack_from(data)
        at = TRAILER.unpack_from(data, len(data) - len(END) - TRAILER.size)[1]
        return n, n_ids, *struct.unpack_from("<q", data, at), *struct.unpack_from("<q", data, at + 8 * (n - 1))

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.end_id, n, self.n_ids = HEADER.unpack_from(data)
        self.payload_at, keys_at, function_at, entries_at, total = TRAILER.unpack_from(data, len(data) - len(END) - TRAILER.size)
        if magic != MAGIC or data[-len(END):] != END or total != len(data) - len(END):
            raise ValueError("not a whole token-id shard")
        self.data = data
        self.keys = np.frombuffer(data, "<i8", n, keys_at)
        self.counts = np.frombuffer(data, "<i8", n, keys_at + 8 * n)
        self.index = ShardIndex.unpack(data[function_at:entries_at], data[entries_at:total - TRAILER.size])

    def ids(self, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self.data, f"<u{self.width}", n, self.payload_at + start * self.width)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """key, start in the shard, ids of each document, every key found through the index."""
        entries = self.index.find(self.keys)
        seen: dict[int, int] = {}
        for key, n, records, start in zip(self.keys.tolist(), self.counts.tolist(), entries["records"].tolist(), entries["start"].tolist()):
            if not records:
                raise ValueError(f"key {key} is not in its shard's index")
            if records > 1:
                start, seen[key] = start + seen.get(key, 0), seen.get(key, 0) + n
            yield None if key == NULL_KEY else key, start, self.ids(start, n)


def id_width(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_str(vocabulary).get_vocab_size() <= 1 << 16 else 4


def write_token_store(docs: DataFrame, vocabulary_path: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs (doc_id, text), append end_id to each and write shards below path/shards, in ascending doc_id order,
    and their directory below path/directory.

    The texts are dealt into ranges of (doc_id, hash of the text), sorted there, encoded and packed as they
    stream by; a task holds one shard of at most shard_ids ids (or one document, if that is longer).
    Null text has no ids but the end id; documents without doc_id come first and have one common key;
    repeated doc_ids are all kept, side by side in the order of their texts' hashes; an empty table gives
    no shard; other columns are ignored.
    """
    vocabulary = read_vocabulary(vocabulary_path)
    width = id_width(vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end = end_id.to_bytes(width, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = shipped.value
        encode, keys, parts, size = held(("library", hash(text), width), lambda: LibraryEncoder(text, width, 2 * TABLE_BYTES)).encode, [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = encode(text) + end
                if keys and size + len(ids) > shard_ids * width:
                    yield pa.RecordBatch.from_arrays([pa.array([pack_shard(keys, parts, width, end_id)], pa.binary())], ["shard"])
                    keys, parts, size = [], [], 0
                keys.append(key)
                parts.append(ids)
                size += len(ids)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([pack_shard(keys, parts, width, end_id)], pa.binary())], ["shard"])

    dealt = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
             .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text"))
    write_blobs(map_arrow(dealt, pack, "shard binary"), "shard", f"{path}/shards", END)
    spark = docs.sparkSession
    _directory(spark, path).write.parquet(f"{path}/directory")


def _directory(spark: SparkSession, path: str) -> DataFrame:
    """file, n_docs, n_ids, low, high (keys) and start (ids of all shards before) of each shard."""
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = zip(*(Shard.head(memoryview(x.as_buffer())) for x in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in heads)], ["file", "n_docs", "n_ids", "low", "high"])

    shards = staged(map_arrow(_contents(spark, path), heads, "file string, n_docs long, n_ids long, low long, high long"), "heads")
    shards = shards.withColumns({"part": F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"), "turn": F.regexp_extract("file", r"-c(\d+)(\.[^-]*)?$", 1).cast("long")})
    # ids before a shard: those of all parts before (a window with a row a part) and of its part's shards before
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("inside", inside).join(parts, "part").select("file", "n_docs", "n_ids", "low", "high", (F.col("before") + F.col("inside")).alias("start"))


def shard_list(spark: SparkSession, path: str) -> DataFrame:
    """The directory: file, n_docs, n_ids, low, high (keys) and start (ids of all shards before) of each shard."""
    return spark.read.parquet(f"{path}/directory")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return read_blobs(spark, f"{path}/shards").where(F.col("length") > len(END)).select("file", "content")


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files and their directory.

    Null keys come back as null, repeated keys as often as they were written, a store of nothing gives no rows.
    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [(key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, start, ids in Shard(content).documents()]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), *(pa.array(x, pa.int64()) for x in zip(*found))], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = map_arrow(_contents(spark, path), rows, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    starts = shard_list(spark, path).select("file", F.col("start").alias("shard_start"))
    return docs.join(starts, "file").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


class TokenStore:
    """Keyed access from the driver. A key costs the directory's row groups that may hold it, one entry and one range of
    ids; a shard's hash function (about 4 bits a document) is read at the first key that falls into it, and kept."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.shards = shard_list(spark, path).select("file", "low", "high")
        self.open: dict[str, tuple[int, int, int, PerfectHash]] = {}
        self.bytes_read = 0

    def _read(self, file: str, offset: int, length: int) -> bytes:
        self.bytes_read += length
        return read_range(self.spark, f"{self.path}/shards/{file}", offset, length)

    def _function(self, file: str) -> tuple[int, int, int, PerfectHash]:
        """Width of an id, places of the payload and of the entries, hash function."""
        if file not in self.open:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/shards/{file}")
            size = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getLen()
            payload_at, _, function_at, entries_at, _ = TRAILER.unpack(self._read(file, size - len(END) - TRAILER.size, TRAILER.size))
            width = HEADER.unpack(self._read(file, 0, HEADER.size))[1]
            self.open[file] = width, payload_at, entries_at, PerfectHash.unpack(self._read(file, function_at, entries_at - function_at), 0)[0]
        return self.open[file]

    def get(self, key: int) -> list[list[int]]:
        """The ids of all documents with this key, each with its end id; documents of one key in one shard come joined."""
        out = []
        for row in self.shards.where((F.col("low") <= key) & (F.col("high") >= key)).orderBy("low").collect():
            width, payload_at, entries_at, function = self._function(row["file"])
            slot = int(function.slots(np.array([key]))[0])
            if slot < 0:
                continue
            entry = np.frombuffer(self._read(row["file"], entries_at + slot * ENTRY.itemsize, ENTRY.itemsize), ENTRY)[0]
            if entry["mark"] == int(mixed(np.array([key]), 255)[0]) & 0xFFFFFFFF:
                raw = self._read(row["file"], payload_at + int(entry["start"]) * width, int(entry["n"]) * width)
                out.append(np.frombuffer(raw, f"<u{width}").tolist())
        return out


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tuned(spark)
    path = fresh_path(spark, "token-store")
    write_token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_token_store(spark, path)
