"""Annotated matrices in HDF5 containers (.h5ad): tasks read ranges of cells, or of genes where the matrix is stored by gene.

The driver opens the file for the shape and the names of its parts only. Names, batch labels and entries are read by tasks,
so that the file must lie where they can open it. What opens it is a parameter, h5py if there is none; anything will do
that gives nodes like those of h5py (attrs, keys, slices)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the stored matrix (cells, or genes) that are in memory at a time.
ROWS = 256


def open_local(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading h5ad files needs the h5py package") from e
    return h5py.File(path, "r")


def is_group(node) -> bool:
    return hasattr(node, "keys")


def text(value) -> str:
    return value.decode() if isinstance(value, bytes) else str(value)


def column(node, lo: int, hi: int) -> list[str | None]:
    """The values lo to hi of a column of obs or var as text: plain, categorical or nullable; None where one is missing."""
    if not is_group(node):
        return [text(x) for x in node[lo:hi]]
    if "codes" in node.keys():
        names = [text(x) for x in node["categories"][:]]
        return [names[k] if k >= 0 else None for k in node["codes"][lo:hi].tolist()]
    return [None if gone else text(x) for x, gone in zip(node["values"][lo:hi], node["mask"][lo:hi])]


def names(file, axis: str, lo: int, hi: int) -> list[str | None]:
    return column(file[axis][text(file[axis].attrs["_index"])], lo, hi)


def shape(node) -> tuple[int, int]:
    return tuple(int(x) for x in (node.attrs["shape"] if is_group(node) else node.shape))


def by_gene(node) -> bool:
    return is_group(node) and text(node.attrs["encoding-type"]).startswith("csc")


def entries(node, lo: int, hi: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other index, value) of the non-zero entries of the stored rows lo to hi. Repeated entries are added up; they
    share their row, so none lies in another range."""
    if not is_group(node):
        block = np.asarray(node[lo:hi], float)
        row, other = np.nonzero(block)
        return row + lo, other, block[row, other]
    ptr = np.asarray(node["indptr"][lo:hi + 1], np.int64)
    cut = slice(int(ptr[0]), int(ptr[-1]))
    key = np.repeat(np.arange(lo, hi, dtype=np.int64), np.diff(ptr)) * width + np.asarray(node["indices"][cut], np.int64)
    key, back = np.unique(key, return_inverse=True)
    value = np.bincount(back, np.asarray(node["data"][cut], float), len(key))
    some = value != 0
    return key[some] // width, key[some] % width, value[some]


def read_h5ad(spark: SparkSession, path: str, batch_key: str | None = None, layer: str | None = None, opener: Callable | None = None, rows: int = ROWS, obs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """counts (batch, gene_idx, cell_idx, umi), genes and cells of an annotated matrix (cells x genes).

    Entries come from X, or from a layer; a layer or batch_key that is not there is a KeyError. Cells without a batch label
    have a null batch, the others the label as text; without batch_key all cells are of the batch 'all'. With obs, cells have
    all columns of obs as text, those named like columns of cells with 'obs_' before. Nothing is shuffled but for batch
    labels of a matrix stored by gene, which are joined by cell."""
    opener = opener or open_local
    file = opener(path)
    if layer is not None and layer not in (file["layers"].keys() if "layers" in file.keys() else ()):
        raise KeyError(layer)
    if batch_key is not None and batch_key not in file["obs"].keys():
        raise KeyError(batch_key)

    def stored(f):
        return f["X"] if layer is None else f["layers"][layer]

    n_cells, n_genes = shape(stored(file))
    flip = by_gene(stored(file))
    more = [text(x) for x in file["obs"].attrs["column-order"]] if obs else []
    if hasattr(file, "close"):
        file.close()

    def labels(f, lo: int, hi: int) -> list[str | None]:
        return ["all"] * (hi - lo) if batch_key is None else column(f["obs"][batch_key], lo, hi)

    def ranges(n: int, fn: Callable, schema: str) -> DataFrame:
        """fn(file, lo, hi) for each range of n, in tasks that open the file once."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = None
            for batch in batches:
                for lo in batch.column(0).to_pylist():
                    f = f or opener(path)
                    yield fn(f, lo, min(lo + rows, n))
            if hasattr(f, "close"):
                f.close()

        parts = max(1, min(-(-n // rows), 100_000))
        return spark.range(0, n, rows, parts).mapInArrow(run, schema)

    own = ["batch", "cell_idx", "cell"]
    shown = own + [f"obs_{x}" if x in own else x for x in more]

    def axis(name: str, f, lo: int, hi: int) -> pa.RecordBatch:
        found = [pa.array(range(lo, hi), pa.int32()), pa.array(names(f, name, lo, hi), pa.string())]
        if name == "var":
            return pa.RecordBatch.from_arrays(found, ["gene_idx", "gene"])
        return pa.RecordBatch.from_arrays([pa.array(labels(f, lo, hi), pa.string()), *found, *(pa.array(column(f["obs"][x], lo, hi), pa.string()) for x in more)], shown)

    def counted(f, lo: int, hi: int) -> pa.RecordBatch:
        row, other, value = entries(stored(f), lo, hi, n_cells if flip else n_genes)
        gene, cell = (row, other) if flip else (other, row)
        made = [pa.array(gene.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(value)]
        if flip:
            return pa.RecordBatch.from_arrays(made, ["gene_idx", "cell_idx", "umi"])
        return pa.RecordBatch.from_arrays([pa.array(labels(f, lo, hi), pa.string()).take(pa.array(row - lo)), *made], ["batch", "gene_idx", "cell_idx", "umi"])

    genes = ranges(n_genes, lambda f, lo, hi: axis("var", f, lo, hi), "gene_idx int, gene string")
    cells = ranges(n_cells, lambda f, lo, hi: axis("obs", f, lo, hi), ", ".join(f"`{x}` {'int' if x == 'cell_idx' else 'string'}" for x in shown))
    if not flip:
        return ranges(n_cells, counted, "batch string, gene_idx int, cell_idx int, umi double"), genes, cells
    counts = ranges(n_genes, counted, "gene_idx int, cell_idx int, umi double")
    if batch_key is None:
        return counts.select(F.lit("all").alias("batch"), "*"), genes, cells
    return counts.join(cells.select("cell_idx", "batch"), "cell_idx").select("batch", "gene_idx", "cell_idx", "umi"), genes, cells
