"""Filters on sparse counts (batch, gene_idx, cell_idx, umi), gene annotation and chromosome coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_zeros(counts: DataFrame) -> DataFrame:
    return counts.where("umi <> 0")


def cell_depth(counts: DataFrame) -> DataFrame:
    """batch, cell_idx, n_genes: genes with a count per cell."""
    return drop_zeros(counts).groupBy("batch", "cell_idx").agg(F.count("*").alias("n_genes"))


def deep_cells(counts: DataFrame, min_genes: int = 200) -> DataFrame:
    """Cells with min_genes genes or more; if only one cell of a batch is below, it stays as well. A batch without any cell
    of more than min_genes genes has none."""
    by_batch = Window.partitionBy("batch")
    marked = cell_depth(counts).withColumns({"below": F.sum(F.when(F.col("n_genes") < min_genes, 1).otherwise(0)).over(by_batch), "deepest": F.max("n_genes").over(by_batch)})
    return marked.where(((F.col("n_genes") >= min_genes) | (F.col("below") <= 1)) & (F.col("deepest") > min_genes)).drop("below", "deepest")


def depth_filter(counts: DataFrame, min_genes: int = 200) -> DataFrame:
    return drop_zeros(counts).join(deep_cells(counts, min_genes).select("batch", "cell_idx"), ["batch", "cell_idx"], "left_semi")


def gene_rates(counts: DataFrame, n_cells: DataFrame | None = None) -> DataFrame:
    """batch, gene_idx, rate: share of the batch's cells in which a gene has a count."""
    counts = drop_zeros(counts)
    if n_cells is None:
        n_cells = counts.select("batch", "cell_idx").distinct().groupBy("batch").agg(F.count("*").alias("n_cells"))
    found = counts.groupBy("batch", "gene_idx").agg(F.count("*").alias("n"))
    return found.join(n_cells, "batch").select("batch", "gene_idx", (F.col("n") / F.col("n_cells")).alias("rate"))


def common_genes(counts: DataFrame, low_dr: float = 0.05, n_cells: DataFrame | None = None) -> DataFrame:
    """Genes with a rate above low_dr; all genes of a batch where none is. n_cells (batch, n_cells): as for gene_rates."""
    rates = gene_rates(counts, n_cells)
    some = rates.groupBy("batch").agg(F.max((F.col("rate") > low_dr).cast("int")).alias("any"))
    return rates.join(some, "batch").where((F.col("rate") > low_dr) | (F.col("any") == 0)).drop("any")


def frequent_genes(counts: DataFrame, up_dr: float = 0.1) -> DataFrame:
    """Genes with a rate of up_dr or more (the second filter)."""
    return gene_rates(counts).where(F.col("rate") >= up_dr)


def gene_filter(counts: DataFrame, low_dr: float = 0.05) -> DataFrame:
    return drop_zeros(counts).join(common_genes(counts, low_dr).select("batch", "gene_idx"), ["batch", "gene_idx"], "left_semi")


def quality_flag(n_genes: Column, bound: int = 7000) -> Column:
    return F.when(n_genes < bound, "low data quality").otherwise("data quality is ok")


def annotate(genes: DataFrame, annotation: DataFrame, key: str = "symbol", *by: str) -> DataFrame:
    """by, gene_idx, gene, symbol, chrom, abspos, start, end, pos of the genes that the annotation knows, in genomic order.

    genes (by, gene_idx, gene): the first gene of a name counts. annotation (src_idx, symbol, <key>, chrom, abspos, start,
    end): genes are found by key, and of the rows found the first of a symbol counts. The order is abspos, then the genes'
    own order. All this by the columns by (such as batch), each with its own genes."""
    first = Window.partitionBy(*by, "gene").orderBy("gene_idx")
    mine = genes.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    more = [c for c in ("ensembl_gene_id", "band") if c in annotation.columns]
    theirs = annotation.select("src_idx", F.col(key).alias("gene"), F.col("symbol"), "chrom", "abspos", "start", "end", *more)
    found = mine.join(theirs, "gene")  # annotation tables are a few MB: Spark broadcasts the smaller side by its size
    head = Window.partitionBy(*by, "symbol").orderBy("src_idx", "gene_idx")
    kept = found.withColumn("rn", F.row_number().over(head)).where("rn = 1").drop("rn", "src_idx")
    return kept.withColumn("pos", (F.row_number().over(Window.partitionBy(*by).orderBy("abspos", "gene_idx")) - 1).cast("int"))


def without_anti(genes: DataFrame, anti: DataFrame | None, name: str = "gene", pattern: str = "^HLA-") -> DataFrame:
    """genes without names that match pattern or are listed in anti (one column of the same name; None lists nothing)."""
    kept = genes.where(~F.coalesce(F.col(name).rlike(pattern), F.lit(False)))
    return kept if anti is None else kept.join(anti.select(name), name, "left_anti")


def chromosome_runs(counts: DataFrame) -> DataFrame:
    """batch, cell_idx, run, chrom, run_genes: runs of one chromosome among a cell's expressed genes.

    counts has chrom and pos besides. One shuffle by cell serves the windows and the aggregate."""
    by_cell = Window.partitionBy("batch", "cell_idx").orderBy("pos")
    turned = drop_zeros(counts).withColumn("turn", (F.col("chrom") != F.lag("chrom", 1).over(by_cell)).cast("int"))
    runs = turned.withColumn("run", F.sum(F.coalesce("turn", F.lit(0))).over(by_cell))
    return runs.groupBy("batch", "cell_idx", "run").agg(F.first("chrom").alias("chrom"), F.count("*").alias("run_genes"))


def covered_cells(counts: DataFrame, n_chrom: int, ngene_chr: int = 5) -> DataFrame:
    """Cells with 3 genes or more, n_chrom runs or more, and ngene_chr genes or more in the shortest run."""
    runs = chromosome_runs(counts).groupBy("batch", "cell_idx").agg(F.sum("run_genes").alias("n_genes"), F.count("*").alias("n_runs"), F.min("run_genes").alias("shortest"))
    return runs.where((F.col("n_genes") >= 3) & (F.col("n_runs") >= n_chrom) & (F.col("shortest") >= ngene_chr))


def not_defined(all_cells: DataFrame, final_cells: DataFrame) -> DataFrame:
    """Cells that the depth filter kept and that are not in the result."""
    return all_cells.join(final_cells.select("batch", "cell_idx"), ["batch", "cell_idx"], "left_anti")
