"""Per-cell profiles: variance stabilisation, centring, smoothing, consensus, distances between cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_ranks, exact_mean

#: Bytes of the slices of an Arrow batch that a step works on.
SLICE_BYTES = 8 << 20


def vst(x: Column) -> Column:
    """Variance-stabilised count: log(sqrt(x) + sqrt(x + 1)); 0 for 0, so tables stay sparse."""
    return F.log(F.sqrt(x) + F.sqrt(x + 1))


def centred(sparse: DataFrame, n_genes: int) -> DataFrame:
    """batch, cell_idx, mean: mean over all n_genes genes of a sparse table's values x (absent ones are 0)."""
    return sparse.groupBy("batch", "cell_idx").agg((F.sum("x") / n_genes).alias("mean"))


def gains(n: int, obs_var: float = 0.16, state_var: float = 0.001, prior: float = 1e7) -> tuple[np.ndarray, np.ndarray]:
    """Filter and smoother gains of a local-level model; they depend on its length only."""
    k, j, c = np.empty(n), np.empty(n), prior
    for t in range(n):
        r = c + state_var
        if t:
            j[t - 1] = c / r
        k[t] = r / (r + obs_var)
        c = r - k[t] * r
    return k, j


def kalman_smooth(x: np.ndarray, obs_var: float = 0.16, state_var: float = 0.001) -> np.ndarray:
    """Smoothed levels of the rows of x (series, time): filter forwards, Rauch-Tung-Striebel backwards."""
    x = np.ascontiguousarray(np.atleast_2d(np.asarray(x, float)).T)  # time first: a step is one contiguous row
    k, j = gains(len(x), obs_var, state_var)
    level = np.zeros(x.shape[1])
    out = np.empty_like(x)
    for t in range(len(x)):
        level = level + k[t] * (x[t] - level)
        out[t] = level
    for t in range(len(x) - 2, -1, -1):
        out[t] += j[t] * (out[t + 1] - out[t])
    return out.T


def array_column(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's arrays of one length as (rows, length)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def map_profiles(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow; fn gets the batches, which Spark bounds, in slices of SLICE_BYTES or one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, SLICE_BYTES))
                for at in range(0, batch.num_rows, step):
                    yield batch.slice(at, step)
        return fn(pieces())

    return df.mapInArrow(run, schema)


def smooth_profiles(counts: DataFrame, n_genes: int | None, obs_var: float = 0.16, state_var: float = 0.001) -> DataFrame:
    """batch, cell_idx, v, seen: stabilised, centred, smoothed and recentred profile of each cell, and where it has counts.

    counts (batch, cell_idx, pos, umi, and n, the genes of the batch, if n_genes is None) is gathered by cell as
    sparse arrays; one pass through Arrow densifies a batch of cells and does all four steps on it, so each
    profile crosses to Python once."""
    width = F.lit(n_genes) if n_genes is not None else F.first("n")
    sparse = counts.where("umi <> 0").groupBy("batch", "cell_idx").agg(F.collect_list("pos").alias("pos"), F.collect_list("umi").alias("umi"), width.cast("int").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(4).to_numpy()
            for n in np.unique(widths):
                every = batch.filter(pa.array(widths == n))
                # slices are cut by what they become: sparse rows are much shorter than profiles
                step = max(1, SLICE_BYTES // (8 * max(int(n), 1)))
                for own in (every.slice(at, step) for at in range(0, len(every), step)):
                    places, umi = own.column(2), own.column(3).flatten().to_numpy(zero_copy_only=False)
                    offsets = places.offsets.to_numpy()
                    rows = np.repeat(np.arange(len(own)), np.diff(offsets))
                    dense = np.zeros((len(own), n))
                    dense[rows, places.flatten().to_numpy(zero_copy_only=False)] = np.log(np.sqrt(umi) + np.sqrt(umi + 1))
                    dense -= exact_mean(dense)[:, None]
                    dense = kalman_smooth(dense, obs_var, state_var)
                    dense -= exact_mean(dense)[:, None]
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), array_column(dense), places], ["batch", "cell_idx", "v", "seen"])

    return map_profiles(sparse.select("batch", "cell_idx", "pos", "umi", "n"), run, "batch string, cell_idx int, v array<double>, seen array<int>")


def consensus(long: DataFrame, *keys: str) -> DataFrame:
    """Median by keys and pos (exact, interpolating)."""
    return long.groupBy(*keys, "pos").agg(F.median("x").alias("median"))


def gene_spread(long: DataFrame) -> DataFrame:
    """gene_idx, n, median (exact, interpolating), sd of the values x of each gene. Values are dealt by gene once and sorted
    there: the median's two middle values are found by place, so no table of values is kept for a gene."""
    by_gene = Window.partitionBy("gene_idx")
    placed = long.select("gene_idx", "x").withColumns({"nth": F.row_number().over(by_gene.orderBy("x")), "n": F.count("*").over(by_gene)})
    middle = (F.col("nth") == F.floor((F.col("n") + 1) / 2)) | (F.col("nth") == F.ceil((F.col("n") + 1) / 2))
    return placed.groupBy("gene_idx").agg(F.count("*").alias("n"), F.avg(F.when(middle, F.col("x"))).alias("median"), F.stddev_samp("x").alias("sd"))


def ranked(long: DataFrame) -> DataFrame:
    """Values by cell replaced by their ranks, ties sharing the mean rank."""
    order, ties = Window.partitionBy("cell_idx").orderBy("x"), Window.partitionBy("cell_idx", "x")
    return long.withColumn("x", F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0)


def standardised(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows of x (spearman: their ranks) centred and of length 1, so that their products are correlations."""
    if metric == "spearman":
        x = np.apply_along_axis(average_ranks, 1, x)
    x = x - x.mean(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distance_matrix(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances between the rows of x by one Gram product."""
    x = np.asarray(x, float)
    if metric != "euclidean":
        x = standardised(x, metric)
        d = 1 - x @ x.T
    else:
        x = x - x.mean(0)
        squares = (x * x).sum(1)
        d = np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * (x @ x.T), 0))
    np.fill_diagonal(d, 0)
    return d
