"""Reference tables: gene annotation, bins, genes to leave out. They are inputs; none is shipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILES = {"hg20": "hg20_gene_anno.parquet", "mm10": "mm10_gene_anno.parquet"}
BINS, CYCLE = "hg20_220kb_bins.parquet", "hg20_cycle_genes.txt"
SYMBOL = {"hg20": "hgnc_symbol", "mm10": "mgi_symbol"}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def data_dir(spark: SparkSession, *folders: str) -> str:
    """The first folder that exists."""
    for folder in folders:
        if folder and _exists(spark, folder):
            return folder
    raise FileNotFoundError(f"no reference data in {folders}")


def annotation(spark: SparkSession, folder: str, genome: str = "hg20") -> DataFrame:
    """src_idx, symbol, ensembl_gene_id, chrom, abspos, start, end, and band if it is there, in the file's order."""
    if genome not in FILES:
        raise NotImplementedError(f"no annotation for genome {genome!r}")
    raw = spark.read.parquet(f"{folder}/{FILES[genome]}")
    return raw.select((F.row_number().over(Window.orderBy("_metadata.file_path", "_metadata.row_index")) - 1).cast("long").alias("src_idx"), F.col(SYMBOL[genome]).alias("symbol"), "ensembl_gene_id", *(c for c in ("band",) if c in raw.columns), F.col("chromosome_name").cast("int").alias("chrom"),
                      F.col("abspos").cast("long").alias("abspos"), F.col("start_position").cast("long").alias("start"), F.col("end_position").cast("long").alias("end"))


def bins(spark: SparkSession, folder: str) -> DataFrame:
    """bin_idx, chrom, chrompos, abspos in order of abspos."""
    raw = spark.read.parquet(f"{folder}/{BINS}")
    return raw.select((F.row_number().over(Window.orderBy("abspos")) - 1).cast("int").alias("bin_idx"), F.col("chrom").cast("int").alias("chrom"), F.col("chrompos").cast("long").alias("chrompos"), F.col("abspos").cast("long").alias("abspos"))


def cycle_genes(spark: SparkSession, folder: str) -> DataFrame:
    """gene: trimmed lines that are not blank."""
    return spark.read.text(f"{folder}/{CYCLE}").select(F.trim("value").alias("gene")).where("gene <> ''")
