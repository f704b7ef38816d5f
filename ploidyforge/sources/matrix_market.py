"""Matrix Market files as a Spark data source: byte ranges are tasks, and a range of genes is left out of the rest where it is read.

    spark.dataSource.register(MatrixMarket)
    spark.read.format("matrix_market").option("geneFrom", 100).option("geneTo", 200).load("counts.mtx")

With spark.sql.python.filterPushdown.enabled and the option pushGenes, comparisons of gene_idx in a query reach the tasks in the
same way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a split, and of a piece that a task parses at once.
SPLIT_BYTES, PIECE_BYTES = 32 << 20, 2 << 20
SCHEMA = "gene_idx int, cell_idx int, umi double"


class Span(InputPartition):
    """Bytes start to end of the file: the lines that begin there."""

    def __init__(self, start: int, end: int) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


def head(stream) -> tuple[int, int, tuple[int, int, int]]:
    """(place of the first entry, numbers in a line, (genes, cells, entries)) from the lines before the entries."""
    data = b""
    while True:
        piece = stream.read(1 << 16)
        data += piece
        at = 0
        while (end := data.find(b"\n", at)) >= 0 or (not piece and at < len(data)):
            end = len(data) if end < 0 else end
            line = data[at:end].strip()
            if line and not line.startswith(b"%"):
                first = data[:data.find(b"\n")].lower().split()
                if b"array" in first or any(x in first for x in (b"symmetric", b"skew-symmetric", b"hermitian", b"complex")):
                    raise ValueError("only general coordinate matrices of real or whole numbers can be read")
                return min(end + 1, len(data)), 2 if b"pattern" in first else 3, tuple(map(int, line.split()))
            at = end + 1
        if not piece:
            raise ValueError("the file has no line of sizes")


def whole_lines(stream, start: int, end: int, first: int) -> Iterator[bytes]:
    """The lines that begin in [start, end), in pieces of whole lines; first is where the entries begin."""
    at = start if start == first else start - 1
    stream.seek(at)
    rest, skip = b"", start > first  # a line that runs into the span belongs to the one before
    while True:
        piece = stream.read(PIECE_BYTES)
        data, origin = rest + piece, at - len(rest)
        at += len(piece)
        if skip:
            cut = data.find(b"\n")
            if cut < 0:
                if not piece:
                    return
                rest = data
                continue
            data, origin, skip = data[cut + 1:], origin + cut + 1, False
        if origin >= end:
            return
        # the last line that begins before the end runs on beyond it
        stop = data.find(b"\n", max(0, end - 1 - origin)) if origin + len(data) >= end else -1
        if stop >= 0:
            yield data[:stop + 1]
            return
        cut = len(data) if not piece else data.rfind(b"\n") + 1
        if cut:
            yield data[:cut]
        if not piece:
            return
        rest = data[cut:]


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.low, self.high = int(options.get("genefrom", 0)), int(options.get("geneto", 1 << 31))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def _open(self):
        system, path = FileSystem.from_uri(self.path)
        return system.open_input_file(path)

    def partitions(self) -> list[Span]:
        with self._open() as stream:
            size = stream.size()
            self.first, self.fields, self.shape = head(stream)
        return [Span(at, min(at + self.split, size)) for at in range(self.first, size, self.split)] if self.low < self.high else []

    def read(self, span: Span | None) -> Iterator[pa.RecordBatch]:
        if span is None:  # Spark's only task where there are no spans
            return
        with self._open() as stream:
            first, fields, (genes, cells, _) = head(stream)
            for lines in whole_lines(stream, span.start, span.end, first):
                numbers = np.array(lines.split(), float).reshape(-1, fields)
                gene, cell = numbers[:, 0].astype(np.int32) - 1, numbers[:, 1].astype(np.int32) - 1
                if len(numbers) and (gene.min() < 0 or gene.max() >= genes or cell.min() < 0 or cell.max() >= cells):
                    raise ValueError("an entry lies outside the matrix")
                own = (gene >= self.low) & (gene < self.high)
                umi = numbers[:, 2] if fields == 3 else np.ones(len(numbers))
                yield pa.RecordBatch.from_arrays([pa.array(gene[own]), pa.array(cell[own]), pa.array(umi[own])], ["gene_idx", "cell_idx", "umi"])


class PushingReader(Reader):
    """The reader for sessions that push filters; Spark refuses it in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("gene_idx",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            else:
                yield f


class MatrixMarket(DataSource):
    """Entries of a Matrix Market file: gene_idx and cell_idx from 0, umi. Options: geneFrom and geneTo (the latter not
    included), splitBytes, pushGenes (true where the session pushes filters to Python sources). The path is one that pyarrow's file systems know (a folder that all tasks see, hdfs://, s3://)."""

    @classmethod
    def name(cls) -> str:
        return "matrix_market"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushingReader if options.get("pushgenes") == "true" else Reader)(options)


def read_entries(spark: SparkSession, path: str, genes: tuple[int, int] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """gene_idx, cell_idx, umi of a file, of the genes in [from, to) if these are given; each byte is read by one task."""
    spark.dataSource.register(MatrixMarket)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("matrix_market").option("splitBytes", split_bytes).option("pushGenes", pushes)
    if genes is not None:
        reader = reader.option("geneFrom", genes[0]).option("geneTo", genes[1])
    return reader.load(path)
