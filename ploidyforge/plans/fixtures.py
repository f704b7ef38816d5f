"""Tables of the engine's model made from the driver's tables: counts, genes, bins, series, labelings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_CHROM, GENES_PER_BIN = 20, 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return (lines.groupBy(F.col("l_partkey").cast("int").alias("gene_idx"), F.col("l_suppkey").cast("int").alias("cell_idx")).agg(F.sum("l_quantity").alias("umi"))
            .select(F.lit("all").alias("batch"), "gene_idx", "cell_idx", "umi"))


def n_genes(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "part").count()


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_idx, chrom, start, end, pos, abspos: genes laid out evenly on N_CHROM chromosomes."""
    n = n_genes(spark, sf_dir)
    p, per = F.col("p_partkey"), n // N_CHROM
    rel = p % per
    return read(spark, sf_dir, "part").select(p.cast("int").alias("gene_idx"), (F.floor(p / per) + 1).cast("int").alias("chrom"), (rel * 1000).alias("start"), (rel * 1000 + 500).alias("end"), p.cast("int").alias("pos"), p.alias("abspos"))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bin_idx, chrom, chrompos, abspos: GENES_PER_BIN genes wide, with two bins of chromosome 24 that runs leave out."""
    each = n_genes(spark, sf_dir) // N_CHROM // GENES_PER_BIN
    own = spark.range(N_CHROM * each).select(F.col("id").cast("int").alias("bin_idx"), (F.floor(F.col("id") / each) + 1).cast("int").alias("chrom"), ((F.col("id") % each + 1) * GENES_PER_BIN * 1000).alias("chrompos"), ((F.col("id") + 1) * GENES_PER_BIN).alias("abspos"))
    extra = spark.range(2).select((F.col("id") + N_CHROM * each).cast("int"), F.lit(24), (F.col("id") + 1) * 5000, (F.col("id") + 1) * 5 + N_CHROM * each * 5)
    return own.union(extra)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with chrom and pos of their genes."""
    return counts(spark, sf_dir).join(genes(spark, sf_dir).select("gene_idx", "chrom", "pos"), "gene_idx")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_idx, cluster, pos, x from the embeddings."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("cell_idx"), (F.col("label") + 1).alias("cluster"), F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch, cell_idx, v from the embeddings."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.lit("all").alias("batch"), F.col("vec_id").cast("int").alias("cell_idx"), F.col("embedding").cast("array<double>").alias("v"))


def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("cell_idx"), (F.col("label") + 1).alias("cluster"))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files: file streams need a folder, so a single file is picked out of its own."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    files = spark.readStream.schema(read(spark, sf_dir, name).schema)
    return files.parquet(f"{sf_dir}/{name}.parquet") if folder else files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
