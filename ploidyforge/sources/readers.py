"""Readers: every source ends as counts (batch, gene_idx, cell_idx, umi), genes (gene_idx, gene), cells (batch, cell_idx, cell)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settled
from . import npz
from .h5ad import read_h5ad  # noqa: F401 - one of the readers


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line (from 0) of a text file. A split's lines are numbered as they are read; the lines of the splits before it,
    by place in the file, are added (a window with a row a split)."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    lines = settled(raw, "lines")
    splits = lines.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.withColumn("before", before), ["file", "at"]).select("value", (F.col("before") + F.col("id") - F.col("first")).alias("line"))


def from_triplets(triplets: DataFrame, batch: str = "all") -> DataFrame:
    """Counts from (gene_idx, cell_idx, umi), with batch if it is there; repeated places are added up, zeros dropped."""
    named = triplets if "batch" in triplets.columns else triplets.withColumn("batch", F.lit(batch))
    return (named.groupBy(F.col("batch").cast("string").alias("batch"), F.col("gene_idx").cast("int").alias("gene_idx"), F.col("cell_idx").cast("int").alias("cell_idx"))
            .agg(F.sum(F.col("umi").cast("double")).alias("umi")).where("umi <> 0"))


def from_matrix(spark: SparkSession, matrix, genes=None, cells=None, batch: str = "all") -> tuple[DataFrame, DataFrame, DataFrame]:
    """From a pandas frame (genes x cells), a scipy-like sparse matrix with names, or annotated cells (cells x genes)."""
    import numpy as np
    import pandas as pd

    if isinstance(matrix, pd.DataFrame):
        genes, cells, values = list(map(str, matrix.index)), list(map(str, matrix.columns)), matrix.to_numpy(float)
        g, c = np.nonzero(values)
        umi = values[g, c]
    elif hasattr(matrix, "obs_names") and hasattr(matrix, "X"):
        return from_matrix(spark, matrix.X.T, list(map(str, matrix.var_names)), list(map(str, matrix.obs_names)), batch)
    elif hasattr(matrix, "tocoo"):
        coo = matrix.tocoo()
        g, c, umi = coo.row, coo.col, coo.data.astype(float)
    elif isinstance(matrix, np.ndarray) and genes is not None:
        g, c = np.nonzero(matrix)
        umi = matrix[g, c].astype(float)
    else:
        raise TypeError(f"counts can't be read from {type(matrix).__name__}")
    counts = spark.createDataFrame(pd.DataFrame({"gene_idx": g.astype("int32"), "cell_idx": c.astype("int32"), "umi": umi}))
    return from_triplets(counts, batch), axis(spark, genes, "gene"), axis(spark, cells, "cell", batch)


def axis(spark: SparkSession, names, kind: str, batch: str | None = None) -> DataFrame:
    rows = spark.createDataFrame([(k, str(x)) for k, x in enumerate(names)], f"{kind}_idx int, {kind} string")
    return rows if batch is None else rows.select(F.lit(batch).alias("batch"), f"{kind}_idx", kind)


def read_table(spark: SparkSession, path: str, batch: str = "all") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A text table with cells in the header and genes in the first column: tabs for .tsv and .txt, else commas."""
    sep = "\t" if path.endswith((".tsv", ".txt", ".tsv.gz", ".txt.gz")) else ","
    lines = numbered_lines(spark, path).select("line", F.split("value", sep, -1).alias("f"))
    head = lines.where("line = 0").first()["f"]
    body = lines.where("line > 0")
    # the header may lack a name for the gene column
    width = body.select(F.size("f")).first()
    names = head[1:] if width is None or len(head) == width[0] else head
    strip = lambda c: F.regexp_replace(c, '^"|"$', "")
    genes = body.select((F.col("line") - 1).cast("int").alias("gene_idx"), strip(F.col("f")[0]).alias("gene"))
    cells = axis(spark, [x.strip('"') for x in names], "cell", batch)
    values = body.select((F.col("line") - 1).cast("int").alias("gene_idx"), F.posexplode(F.slice("f", 2, len(names))).alias("cell_idx", "umi"))
    return from_triplets(values.withColumn("umi", F.col("umi").cast("double")), batch), genes, cells


def read_mtx(spark: SparkSession, matrix: str, genes: str, cells: str, batch: str = "all") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A Matrix Market file (coordinates from 1) with a file of gene and one of cell names, one name a line."""
    lines = numbered_lines(spark, matrix).where(~F.col("value").startswith("%"))
    size = lines.orderBy("line").first()["line"]
    f = F.split(F.trim("value"), r"\s+")
    triplets = lines.where(F.col("line") > size).select((f[0].cast("int") - 1).alias("gene_idx"), (f[1].cast("int") - 1).alias("cell_idx"), f[2].cast("double").alias("umi"))
    g = numbered_lines(spark, genes).select(F.col("line").cast("int").alias("gene_idx"), F.trim(F.split("value", "\t")[0]).alias("gene"))
    c = numbered_lines(spark, cells).select(F.lit(batch).alias("batch"), F.col("line").cast("int").alias("cell_idx"), F.trim(F.split("value", "\t")[0]).alias("cell"))
    return from_triplets(triplets, batch), g, c


def read_npz(spark: SparkSession, path: str, batch: str = "all") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compressed columns (data, indices, indptr) with genes and cells, read by tasks; the driver sees the directory only."""
    counts, genes, cells = npz.triplets(spark, path), npz.names(spark, path, "genes", "gene"), npz.names(spark, path, "cells", "cell")
    return from_triplets(counts, batch), genes, cells.select(F.lit(batch).alias("batch"), "cell_idx", "cell")


def read_labelled(spark: SparkSession, path: str, batch: str = "all") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A tab table with a header of cells, a line of published calls, a line that is skipped, then genes; of repeated genes
    the first stays. Also returns (cell_idx, call)."""
    lines = numbered_lines(spark, path).select("line", F.split("value", "\t", -1).alias("f"))
    cells = lines.where("line = 0").select(F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("cell_idx", "cell")).select(F.lit(batch).alias("batch"), "cell_idx", "cell")
    calls = lines.where("line = 1").select(F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("cell_idx", "call"))
    body = lines.where("line > 2").select((F.col("line") - 3).cast("int").alias("gene_idx"), F.col("f")[0].alias("gene"), F.slice("f", F.lit(2), F.size("f")).alias("v"))
    first = body.groupBy("gene").agg(F.min("gene_idx").alias("gene_idx"))
    kept = body.join(first, ["gene", "gene_idx"], "left_semi")
    counts = kept.select("gene_idx", F.posexplode("v").alias("cell_idx", "umi"))
    return from_triplets(counts, batch), kept.select("gene_idx", "gene"), cells, calls
