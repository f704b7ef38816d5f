"""Compressed columns in a NumPy archive, read by tasks: ranges of entries where members are stored, one stream where deflated."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of an Arrow batch, and of a task where ranges can be read.
ENTRIES, TASK_ENTRIES = 1 << 18, 1 << 22


@contextmanager
def _archive(path: str) -> Iterator[zipfile.ZipFile]:
    from pyarrow import fs

    files, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with files.open_input_file(inside) as raw, zipfile.ZipFile(raw) as archive:
        yield archive


class Member:
    """A one-dimensional array of an archive, of which only stretches are held."""

    def __init__(self, archive: zipfile.ZipFile, name: str) -> None:
        self.file = archive.open(f"{name}.npy")
        version = np.lib.format.read_magic(self.file)
        shape, _, self.dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(self.file)
        if len(shape) != 1 or self.dtype.hasobject:
            raise ValueError(f"{name} is no array of one dimension and plain values")
        self.size, self.begin = shape[0], self.file.tell()

    def stretches(self, start: int, stop: int) -> Iterator[np.ndarray]:
        if start:
            self.file.seek(self.begin + start * self.dtype.itemsize)
        for at in range(start, stop, ENTRIES):
            n = min(ENTRIES, stop - at)
            got = self.file.read(n * self.dtype.itemsize)
            if len(got) != n * self.dtype.itemsize:
                raise ValueError("an array of the archive ends early")
            yield np.frombuffer(got, self.dtype)


def ranges(path: str) -> list[tuple[int, int]]:
    """Entries [start, stop) of each task, from the archive's directory and an array's header: all in one where the members
    are deflated, as such a stream can be read from its begin only."""
    with _archive(path) as archive:
        size = Member(archive, "indices").size
        stored = all(archive.getinfo(f"{m}.npy").compress_type == zipfile.ZIP_STORED for m in ("indices", "data"))
    step = TASK_ENTRIES if stored else max(1, size)
    return [(at, min(size, at + step)) for at in range(0, size, step)] or [(0, 0)]


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """gene_idx, cell_idx, umi of the stored entries, zeros included. A task holds the column offsets (8 bytes a cell) and one
    stretch of entries. The file must be within reach of the executors."""
    parts = ranges(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                with _archive(path) as archive:
                    ends = Member(archive, "indptr")
                    ends = np.concatenate([np.zeros(0, ends.dtype), *ends.stretches(0, ends.size)])
                    genes, values, at = Member(archive, "indices"), Member(archive, "data"), start
                    if genes.size != values.size or not ends.size or ends[-1] != genes.size:
                        raise ValueError("data, indices and indptr of the archive don't fit together")
                    for g, v in zip(genes.stretches(start, stop), values.stretches(start, stop)):
                        cell = np.searchsorted(ends, np.arange(at, at + len(g)), side="right") - 1
                        at += len(g)
                        yield pa.RecordBatch.from_arrays([pa.array(g.astype("int32")), pa.array(cell.astype("int32")), pa.array(v.astype(float))], ["gene_idx", "cell_idx", "umi"])

    spans = spark.createDataFrame(parts, "start long, stop long").repartitionByRange(len(parts), "start")
    return spans.mapInArrow(run, "gene_idx int, cell_idx int, umi double")


def names(spark: SparkSession, path: str, member: str, kind: str) -> DataFrame:
    """<kind>_idx, <kind>: the names of an axis in order, read in stretches by one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                with _archive(path) as archive:
                    axis, at = Member(archive, member), 0
                    for part in axis.stretches(0, axis.size):
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part), dtype="int32")), pa.array([str(x) for x in part], pa.string())], [f"{kind}_idx", kind])
                        at += len(part)

    return spark.range(1, numPartitions=1).select(F.col("id")).mapInArrow(run, f"{kind}_idx int, {kind} string")
