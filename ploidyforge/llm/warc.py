"""WARC archives with deduplicated payloads and a two-level capture index.

Archives are files of gzip members, one per record. The index sorts captures by reversed-host URL key and
packs them into compressed blocks of a bounded number of lines; a sparse directory has the first key, file,
offset and length of each block. A look-up searches the first keys of the index files and then the directory of one
file by bisection, reads one range of an index file, and then one range of an archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow, read_blobs, read_range, staged, table, tuned, utf8, write_blobs

ARCHIVE_BYTES, BLOCK_LINES, INDEX_BYTES = 8 << 20, 3000, 8 << 20
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
DATE = "2024-01-01T00:00:00Z"
SALTS = 16
#: Keys of an index file that a task looks up together.
HELD_KEYS = 50_000
CAPTURE = "url_key string, page_id long, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
CAPTURE_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
REST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"


def url_key(url: str) -> str:
    """Reversed host, then path and query: 'com,example,a)/x?y'. Scheme, user, port and fragment are left out."""
    host, rest = re.match(HOST, url), re.match(REST, url)
    if not host:
        return ")" + url
    return ",".join(reversed(host[1].lower().split("."))) + ")" + (rest[1] or "/")


def url_key_column(url):
    host, rest = F.lower(F.regexp_extract(url, HOST, 1)), F.regexp_extract(url, REST, 1)
    made = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(url.rlike(HOST), made).otherwise(F.concat(F.lit(")"), url))


def gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member."""
    at, view = 0, memoryview(data)
    while at < len(data):
        reader, start, parts = zlib.decompressobj(31), at, []
        while not reader.eof:
            piece = view[at:at + 65536]
            if not piece:
                raise ValueError("a gzip member is cut off")
            parts.append(reader.decompress(piece))
            at += len(piece) - len(reader.unused_data)
        yield start, at - start, b"".join(parts)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def _field(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str, payload: bytes, winner: tuple[int, str] | None) -> bytes:
    """A response record, or a revisit of the winner's (page_id, url)."""
    digest = base32_sha1(payload)
    head = [("WARC-Type", "revisit" if winner else "response"), ("WARC-Record-ID", _record_id(page_id, url)), ("WARC-Date", DATE), ("WARC-Target-URI", _field(url)),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if winner:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(*winner)), ("WARC-Refers-To-Target-URI", _field(winner[1])), ("X-Refers-To-Page", str(winner[0]))]
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return utf8("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n") + block + b"\r\n\r\n"


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def _capture(file: str, offset: int, length: int, content: bytes) -> tuple | None:
    """A row of CAPTURE for a record; the digest of a stored payload is worked out anew."""
    if not content:
        return None
    fields, block = parsed(content)
    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if base32_sha1(payload) != said or len(payload) != size:
            raise ValueError(f"record at {file}:{offset} is damaged")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return url_key(fields["WARC-Target-URI"]), page and int(page), file, offset, length, size, said, kind, refers and int(refers)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in CAPTURE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds)], CAPTURE_NAMES)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) to archives below path, in order of URL key.

    Of rows with equal payloads (html in UTF-8, null as empty) of min_revisit_bytes or more, the one of largest
    (page_id, url) becomes a response, once, and all others revisit it; smaller payloads are always
    responses. A null url counts as ''; rows without page_id never are revisited while another row of their
    payload has one, and if none has, all are responses. An empty table gives no archive; other columns are
    ignored. Winners are found and joined, with salts, on narrow rows (digest, page_id, url); payloads move
    into the sort, where they meet what the narrow rows say.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), url_key_column(url).alias("key"))
    wanted = rows.where(F.octet_length("html") >= min_revisit_bytes) if min_revisit_bytes > 0 else rows
    narrow = staged(wanted.select("page_id", "url", "digest", "key").distinct(), "narrow")
    same = narrow.groupBy("digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("winner"), F.count("*").alias("n")).where("n > 1 and winner is not null")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    shared = same.select("digest", F.col("winner.page_id").alias("to_page"), F.col("winner.url").alias("to_url"), salts)
    told = narrow.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(shared, ["digest", "salt"])
    told = told.select("key", "page_id", "digest", "url", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("html"), "to_page", "to_url")
    told = staged(told, "told")
    every = rows.select("key", "page_id", "digest", "url", F.lit(1).alias("kind"), "html", F.lit(None).cast("long").alias("to_page"), F.lit(None).cast("string").alias("to_url")).union(told)
    dealt = every.repartitionByRange("key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest", "url", "kind")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, said, winner, before = [], 0, None, None, None
        for batch in batches:
            for page_id, url, html, digest, kind, to_page, to_url in zip(*(c.to_pylist() for c in batch.columns)):
                this = page_id, url, digest
                if kind == 0:
                    said, winner = this, (to_page, to_url)
                    continue
                body = utf8(html)
                if said != this:  # no other row has its payload; its own repetitions follow it
                    said, winner = this, (page_id, url) if page_id is not None and len(body) >= min_revisit_bytes else None
                chosen = winner is None or this[:2] == winner and this != before
                before = this
                packed = gzipped(record(page_id, url, body, None if chosen else winner))
                if kept and size + len(packed) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(kept)], pa.binary())], ["archive"])
                    kept, size = [], 0
                kept.append(packed)
                size += len(packed)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(kept)], pa.binary())], ["archive"])

    write_blobs(map_arrow(dealt.select("page_id", "url", "html", "digest", "kind", "to_page", "to_url"), pack, "archive binary"), "archive", path, EMPTY_MEMBER)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row of CAPTURE for each record of the archives below path, in a scan over all their members; none for none."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _rows([x for m in members(content) if (x := _capture(file, *m))])

    return map_arrow(read_blobs(spark, path).select("file", "content"), rows, CAPTURE)


def _at_ranges(blobs: DataFrame, ranges: DataFrame, fn, schema: str) -> DataFrame:
    """fn(file, offset, length, content of the range) for each of the ranges (file, offset, length) of the blobs (file, content).

    A file's ranges, as many as it has members, are gathered and meet its content in one task."""
    listed = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, ranges in zip(*(c.to_pylist() for c in batch.columns)):
                yield from fn(file, [(r["offset"], r["length"], content[r["offset"]:r["offset"] + r["length"]]) for r in ranges])

    return map_arrow(blobs.join(listed, "file").select("file", "content", "ranges"), run, schema)


class RangeReader:
    """Ranges of the files in a folder, read inside a task through pyarrow's file systems (local or mounted folders, HDFS,
    object stores); one file is open at a time. bytes_read counts what was read."""

    def __init__(self, folder: str) -> None:
        self.system, self.folder = FileSystem.from_uri(folder)
        self.name, self.file, self.bytes_read = None, None, 0

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.folder}/{name}")
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{name} ends within the range at {offset}")
        self.bytes_read += length
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name = self.file = None


def around(firsts: list[bytes], key: bytes) -> range:
    """Places of the sorted parts that may hold the key: the last that begins below it, and those that begin with it."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def positions(keys: list[str], directory: list[tuple[bytes, int, int]], name: str, reader: RangeReader) -> Iterator[list[tuple[str, int, int]]]:
    """(archive, offset, length) of the captures of the sorted keys in one index file, whose directory has (first key, offset,
    length) of its blocks: blocks and then lines are found by bisection, and a block is read once, if a key needs it."""
    firsts, held, lines, starts = [d[0] for d in directory], None, [], []
    for key in keys:
        wanted = key.encode()
        for k in around(firsts, wanted):
            if k != held:
                ((_, _, block),) = members(reader.read(name, *directory[k][1:]))
                held, lines = k, index_lines(block)
                starts = [x[0].encode() for x in lines]
            found = [(x[2], int(x[3]), int(x[4])) for x in lines[bisect_left(starts, wanted):bisect_right(starts, wanted)]]
            if found:
                yield found


def look_up(urls: DataFrame, archives: str, path: str) -> DataFrame:
    """A row of CAPTURE for each capture of the distinct URL keys of urls (url; null counts as '').

    First keys of the index files, one for each INDEX_BYTES of index, are held by all tasks and bisected; a key goes to the
    task of its file, or files, with that file's part of the directory. There the directory is bisected, one block read and
    its lines bisected. The record's place goes to a task that reads records, one range each, in the archives' order. Only
    keys and places move between tasks, no contents. No URLs, or an empty index, give no rows."""
    spark = urls.sparkSession
    directory = spark.read.parquet(f"{path}/directory")
    tops = sorted((r["key"].encode(), r["file"]) for r in directory.groupBy("file").agg(F.min("first_key").alias("key")).collect())
    firsts, files = [t[0] for t in tops], [t[1] for t in tops]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [url_key(_field(u or "")) for u in batch.column(0).to_pylist()]
            out = [(files[k], key) for key in keys for k in around(firsts, key.encode())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["file", "key"])

    none = F.lit(None).cast("long")
    wanted = map_arrow(urls.select(F.col("url").cast("string")), routed, "file string, key string").distinct().select("file", F.lit(1).alias("kind"), "key", none.alias("offset"), none.alias("length"))
    known = directory.select("file", F.lit(0).alias("kind"), F.col("first_key").alias("key"), "offset", "length")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file, blocks, keys = RangeReader(f"{path}/blocks"), None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            for rows in positions(keys, sorted(blocks), file, reader):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "length"])

        for batch in batches:
            for name, kind, key, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if name != file:
                    if keys:
                        yield from found()
                    file, blocks, keys = name, [], []
                if kind == 0:
                    blocks.append((key.encode(), offset, length))
                else:
                    keys.append(key)
                    if len(keys) == HELD_KEYS:
                        yield from found()
                        keys = []
        if keys:
            yield from found()
        reader.close()

    dealt = wanted.union(known).repartition(n, "file").sortWithinPartitions("file", "kind", "key")
    spots = staged(map_arrow(dealt, placed, "file string, offset long, length long"), "places")

    def captured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(archives)
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                ((_, _, content),) = members(reader.read(name, offset, length))
                rows.append(_capture(name, offset, length, content))
            yield _rows(rows)
        reader.close()

    return map_arrow(spots.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset"), captured, CAPTURE)


def write_index(spark: SparkSession, archives: str, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Index the archives: sorted captures in compressed blocks below path/blocks, the directory in path/directory."""
    dealt = read_archives(spark, archives).select("url_key", "page_id", "file", "offset", "length").repartitionByRange("url_key", "page_id", "file", "offset").sortWithinPartitions("url_key", "page_id", "file", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, blocks, size = [], [], 0
        for batch in batches:
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(f"{key}\t{'' if page_id is None else page_id}\t{file}\t{offset}\t{length}\n")
                if len(lines) == block_lines:
                    blocks.append(gzipped(utf8("".join(lines))))
                    lines, size = [], size + len(blocks[-1])
                    if size > INDEX_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(blocks)], pa.binary())], ["blocks"])
                        blocks, size = [], 0
        if lines:
            blocks.append(gzipped(utf8("".join(lines))))
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(blocks)], pa.binary())], ["blocks"])

    write_blobs(map_arrow(dealt, pack, "blocks binary"), "blocks", f"{path}/blocks", EMPTY_MEMBER)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [(c.split(b"\t", 1)[0].decode(), file, at, n) for at, n, c in members(content) if c]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 4, [pa.string(), pa.string(), pa.int64(), pa.int64()])], ["first_key", "file", "offset", "length"])

    map_arrow(read_blobs(spark, f"{path}/blocks").select("file", "content"), heads, "first_key string, file string, offset long, length long").write.parquet(f"{path}/directory")


def index_lines(content: bytes) -> list[list[str]]:
    return [x.split("\t") for x in content.decode().split("\n")[:-1]]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """url_key, page_id, file, offset, length of every capture in the index, from the blocks that the directory names."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def rows(file: str, ranges: list) -> Iterator[pa.RecordBatch]:
        for _, _, packed in ranges:
            for _, _, block in members(packed):
                found = [(k, int(p) if p else None, f, int(o), int(n)) for k, p, f, o, n in index_lines(block)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*found)) or [[]] * 5, kinds)], CAPTURE_NAMES[:5])

    directory = spark.read.parquet(f"{path}/directory").select("file", "offset", "length")
    return _at_ranges(read_blobs(spark, f"{path}/blocks").select("file", "content"), directory, rows, "url_key string, page_id long, file string, offset long, length long")


class CaptureIndex:
    """Look-ups from the driver, by two bisections: over the first keys of the index files (one for each INDEX_BYTES of
    index, held in the driver), then over the directory rows of the files found."""

    def __init__(self, spark: SparkSession, archives: str, path: str) -> None:
        self.spark, self.archives, self.path = spark, archives, path
        self.directory = spark.read.parquet(f"{path}/directory")
        self.files = sorted((r["key"].encode(), r["file"]) for r in self.directory.groupBy("file").agg(F.min("first_key").alias("key")).collect())
        self.bytes_read = 0

    @staticmethod
    def _around(rows: list[tuple], key: bytes) -> list[tuple]:
        """Rows (sorted by first key) that may hold the key."""
        return [rows[k] for k in around([r[0] for r in rows], key)]

    def _blocks(self, key: bytes) -> list[tuple]:
        names = [name for _, name in self._around(self.files, key)]
        if not names:
            return []
        rows = self.directory.where(F.col("file").isin(names)).collect()
        return self._around(sorted((r["first_key"].encode(), r["file"], r["offset"], r["length"]) for r in rows), key)

    def _range(self, path: str, offset: int, length: int) -> bytes:
        self.bytes_read += length
        return read_range(self.spark, path, offset, length)

    def get(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Named fields and payload of every capture of a URL; a revisit has the payload b''."""
        key, out = url_key(_field(url)), []
        for _, file, offset, length in self._blocks(key.encode()):
            for _, _, block in members(self._range(f"{self.path}/blocks/{file}", offset, length)):
                for k, _, archive, at, n in index_lines(block):
                    if k == key:
                        (_, _, content), *_ = members(self._range(f"{self.archives}/{archive}", int(at), int(n)))
                        fields, body = parsed(content)
                        out.append((fields, body.partition(b"\r\n\r\n")[2]))
        return out


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    archives, index = fresh_path(spark, "archives"), fresh_path(spark, "captures")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, archives)
    write_index(spark, archives, index)
    return look_up(pages, archives, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
w as (select x, max(page_id) as top from p group by x),
digits as (select x, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (k // 4) + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31)::int + 1, 1) for k in range(32)], '') as b32 from w)
select page_id, strlen(h)::bigint as payload_bytes, b32 as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from p join w using (x) join digits using (x)
"""
