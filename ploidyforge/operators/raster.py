"""Heatmaps as PNG files: tasks colour and deflate bands of rows, which are joined without being unpacked.

A PNG holds one zlib stream. Deflated pieces that end on a full flush may follow one another in it, and the stream's checksum is
put together from theirs, so a picture of any number of cells is made by tasks and written piece by piece.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calls import heatmap_order
from .profiles import map_profiles
from .ranks import ranked

#: Bytes of pixels of a band, rows of the chromosome strip, columns between two panels.
BAND_BYTES, STRIP_ROWS, GAP = 4 << 20, 8, 6
GREY, STRIP = (190, 190, 190), ((40, 40, 40), (160, 160, 160))
ADLER = 65521
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def colours(x: np.ndarray, limit: float) -> np.ndarray:
    """RGB of values: red above 0, blue below, white at 0, full at limit and beyond; grey where there is none."""
    t = np.clip(np.nan_to_num(x) / limit, -1, 1)
    fade = np.floor(255 * (1 - np.abs(t)) + 0.5).astype(np.uint8)
    full = np.full(t.shape, 255, np.uint8)
    out = np.stack([np.where(t >= 0, full, fade), fade, np.where(t <= 0, full, fade)], -1)
    out[np.isnan(x)] = GREY
    return out


def scanlines(pixels: np.ndarray) -> bytes:
    """Rows of RGB (rows, width, 3) as a PNG has them, each after a filter byte."""
    flat = pixels.reshape(len(pixels), -1)
    return np.concatenate([np.zeros((len(flat), 1), np.uint8), flat], 1).tobytes()


def deflated(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH)


def joined_adler(a: int, b: int, length: int) -> int:
    """Adler-32 of two pieces one after another, from that of each and the length of the second."""
    low_a, low_b = a & 0xFFFF, b & 0xFFFF
    low = (low_a + low_b - 1) % ADLER
    high = ((a >> 16) + (b >> 16) + length * (low_a - 1)) % ADLER
    return high << 16 | low


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def bands(rows: DataFrame, limit: float) -> DataFrame:
    """first (place of its first row), n, packed, adler, length of bands of rows (place, panels: arrays of values, drawn from
    left to right with a gap between them), ordered by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for panels in batch.column(1).to_pylist():
                parts = []
                for k, v in enumerate(panels):
                    parts += [np.full((GAP, 3), GREY, np.uint8)] * (k > 0) + [colours(np.array([np.nan if x is None else x for x in v], float), limit)]
                lines.append(np.concatenate(parts))
            step = max(1, BAND_BYTES // max(1, lines[0].size)) if lines else 1
            for at in range(0, len(lines), step):
                raw = scanlines(np.stack(lines[at:at + step]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([len(lines[at:at + step])], pa.int64()), pa.array([deflated(raw)], pa.binary()), pa.array([zlib.adler32(raw)], pa.int64()), pa.array([len(raw)], pa.int64())], ["first", "n", "packed", "adler", "length"])

    dealt = rows.select("place", "panels").repartitionByRange("place").sortWithinPartitions("place")
    return map_profiles(dealt, run, "first long, n long, packed binary, adler long, length long")


def strip(chroms: list[int], panels: int) -> np.ndarray:
    """Rows above the cells: chromosomes in turn dark and light."""
    turn = np.cumsum(np.diff(np.array(chroms), prepend=chroms[:1]) != 0) % 2
    own = np.array(STRIP, np.uint8)[turn]
    parts = [own if k % 2 == 0 else np.full((GAP, 3), GREY, np.uint8) for k in range(2 * panels - 1)]
    return np.repeat(np.concatenate(parts)[None], STRIP_ROWS, 0)


def write_png(rows: DataFrame, chroms: list[int], panels: int, path: str, limit: float) -> tuple[int, int]:
    """Write rows (place, panels) under a strip of their bins' chromosomes; (width, height). Bands come to the driver one
    partition at a time and go to the file; it has its name only when it is whole."""
    spark = rows.sparkSession
    height, width = rows.count() + STRIP_ROWS, panels * len(chroms) + (panels - 1) * GAP
    raw = scanlines(strip(chroms, panels))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    system = target.getFileSystem(conf)
    out = system.create(part)
    try:
        out.write(bytearray(SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"\x78\x9c" + deflated(raw))))
        adler = zlib.adler32(raw)
        for band in bands(rows, limit).toLocalIterator():
            out.write(bytearray(chunk(b"IDAT", bytes(band["packed"]))))
            adler = joined_adler(adler, band["adler"], band["length"])
        out.write(bytearray(chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + chunk(b"IEND", b"")))  # an empty last block
    finally:
        out.close()
    system.delete(target, True)
    if not system.rename(part, target):
        raise OSError(f"{path} can't be written")
    return width, height


def profiles(result, batch: str) -> DataFrame:
    """cell_idx, cell, v: the profiles of a batch's cells by bin."""
    long = result.cna.where(F.col("batch") == batch).groupBy("cell_idx").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("p"))
    return long.join(result.cells.where(F.col("batch") == batch).select("cell_idx", "cell"), "cell_idx").select("cell_idx", "cell", F.col("p.x").alias("v"))


def bins_of(result, batch: str) -> list[tuple]:
    """(chrom, start) of each place: a table of some 12,000 bins, or of a batch's genes."""
    places = result.places.where(F.col("batch") == batch) if "batch" in result.places.columns else result.places
    start = "chrompos" if "chrompos" in places.columns else "start"
    return [(r["chrom"], r[start]) for r in places.orderBy("place").select("chrom", start).collect()]


def _ordered(drawn: DataFrame, prediction: DataFrame) -> DataFrame:
    """drawn (cell_idx, cell, panels) with place: by prediction, then name, cells without one last."""
    order = heatmap_order(drawn.select("cell_idx", "cell"), prediction.select("cell_idx", "prediction"))
    return drawn.join(order.select("cell_idx", F.col("place").cast("long").alias("place")), "cell_idx")


def plot(result, batch: str, path: str, limit: float = 0.5) -> tuple[int, int]:
    """Heatmap of a batch: a row a cell, by prediction and name, a column a bin."""
    drawn = profiles(result, batch).select("cell_idx", "cell", F.array("v").alias("panels"))
    return write_png(_ordered(drawn, result.prediction.where(F.col("batch") == batch)), [c for c, _ in bins_of(result, batch)], 1, path, limit)


def _shared(a, b, batch: str) -> tuple[list[int], DataFrame]:
    """(chromosomes of the bins, which must be the same; cell, cell_idx of the first, v, w of the cells that both have)."""
    index = bins_of(a, batch)
    if index != bins_of(b, batch):
        raise ValueError("the two results have different bins")
    other = profiles(b, batch).select("cell", F.col("v").alias("w"))
    return [c for c, _ in index], profiles(a, batch).join(other, "cell")


def plot_compared(a, b, batch: str, path: str, sort_by: str = "first", limit: float = 0.5) -> tuple[int, int]:
    """Two results of a batch side by side, on the cells that both have, in the order of the first's or the second's calls."""
    if sort_by not in ("first", "second"):
        raise ValueError("sort_by must be first or second")
    chroms, both = _shared(a, b, batch)
    called = (a if sort_by == "first" else b).prediction.where(F.col("batch") == batch).select("cell", "prediction")
    mine = both.select("cell_idx", "cell").join(called, "cell")
    return write_png(_ordered(both.select("cell_idx", "cell", F.array("v", "w").alias("panels")), mine), chroms, 2, path, limit)


def plot_delta(a, b, batch: str, path: str, limit: float = 0.25) -> tuple[int, int]:
    """The first result less the second, on the cells that both have, in order of their names."""
    chroms, both = _shared(a, b, batch)
    drawn = both.select("cell_idx", "cell", F.array(F.zip_with("v", "w", lambda x, y: x - y)).alias("panels"))
    return write_png(ranked(drawn, ["cell", "cell_idx"]), chroms, 1, path, limit)
