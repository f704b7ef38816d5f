"""The results of a cohort as one container of Parquet tables: what is known of each cell (obs), its profile (obsm), and the
positions and samples that all cells share (uns).

    obs/             a row a cell: its own columns, then pred, batch and warnings (with a prefix if one is given)
    obsm/cna/        batch, cell_idx, cna: the profile as one array in the order of the bins; only cells that have one
    uns/bins/        place, chrom, chrompos, abspos
    uns/per_batch/   batch, status, n_cells_in, n_cells_out, elapsed_min, warnings, reason, error
    uns/summary/     one row, written last: a container without it is not whole
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.batch import label
from .sinks import CNA_TYPES

STORAGES = ("obsm", "none")


@dataclass
class Cohort:
    """A container as read back; cna and bins are None if it has no profiles."""

    obs: DataFrame
    cna: DataFrame | None
    bins: DataFrame | None
    per_batch: DataFrame
    summary: dict

    def matrix(self) -> DataFrame:
        """obs with the column cna, in place of its own one of that name, for every cell; NaN in all places for cells
        without a profile."""
        if self.cna is None:
            raise ValueError("this container has no profiles")
        kind = self.cna.schema["cna"].dataType
        blank = F.array_repeat(F.lit(float("nan")), self.summary["n_places"]).cast(kind)
        key = self.summary["batch_column"]
        profiles = self.cna.withColumnRenamed("batch", key)
        return self.obs.drop("cna").join(profiles, [key, "cell_idx"], "left").withColumn("cna", F.coalesce("cna", blank))


def checked(cna_storage: str, cna_dtype: str) -> None:
    if cna_storage not in STORAGES:
        raise ValueError(f"cna_storage must be one of {STORAGES}, not {cna_storage!r}")
    if cna_dtype not in CNA_TYPES:
        raise ValueError(f"cna_dtype must be one of {CNA_TYPES}, not {cna_dtype!r}")


def observations(result, prefix: str = "") -> DataFrame:
    """All cells with their own columns, and pred ('not.defined' without a call), batch (a missing one as text) and warnings
    (joined by commas; empty for cells that were not reported). A column of one of these names is replaced."""
    pred, batch, warned = (prefix + x for x in ("pred", "batch", "warnings"))
    own = [c for c in result.cells.columns if c not in (pred, warned) and c != "batch"]
    cells = result.cells.select(label("batch").alias("batch"), *[F.col(f"`{c}`") for c in own if c != batch])
    said = result.meta.where("status = 'ok'").select("batch", F.concat_ws(", ", "warnings").alias(warned))
    called = result.called.select("batch", "cell_idx", F.col("prediction").alias(pred)).join(said, "batch", "left")
    joined = cells.join(called, ["batch", "cell_idx"], "left").withColumns({pred: F.coalesce(pred, F.lit("not.defined")), warned: F.coalesce(warned, F.lit(""))})
    return joined.withColumnRenamed("batch", batch)


def per_batch(result) -> DataFrame:
    ok = F.col("status") == "ok"
    return result.meta.select("batch", "status", F.col("n_cells").alias("n_cells_in"), F.when(ok, F.col("n_cells_out")).alias("n_cells_out"), (F.col("seconds") / 60).alias("elapsed_min"), "warnings",
                              F.when(F.col("status") == "skipped_too_small", F.col("note")).alias("reason"), F.when(F.col("status") == "error", F.col("note")).alias("error"))


def write_cohort(result, path: str, cna_storage: str = "obsm", cna_dtype: str = "float32", prefix: str = "") -> dict:
    """Write the results of plans.pipeline.run or run_batches, over a container that is there; returns its summary.

    The summary's counts (n_cells, n_called, n_profiles, n_places) are observed in the passes that write the tables.
    Profiles that differ in length from each other or from the bins are an error, before the container is whole. With
    cna_storage='none' there are no profiles and no bins. Results over genes, whose places differ by sample, have no
    common bins and can be stored with 'none' only."""
    checked(cna_storage, cna_dtype)
    if cna_storage == "obsm" and "batch" in result.places.columns:
        raise ValueError("profiles over genes have no common places: use cna_storage='none' or the tables of to_parquet")
    spark = result.cells.sparkSession
    for gone in ("uns/summary", "obsm", "uns/bins"):
        _drop(spark, f"{path}/{gone}")
    seen = Observation()
    obs = observations(result, prefix)
    obs.observe(seen, F.count("*").alias("n_cells"), F.count_if(F.col(f"`{prefix}pred`") != "not.defined").alias("n_called")).write.mode("overwrite").parquet(f"{path}/obs")
    summary = {"batch_column": f"{prefix}batch", "n_cells": 0, "n_called": 0, "n_profiles": 0, "n_places": 0} | seen.get
    per_batch(result).write.mode("overwrite").parquet(f"{path}/uns/per_batch")
    if cna_storage == "obsm":
        seen, rows = Observation(), Observation()
        kind = "array<float>" if cna_dtype == "float32" else "array<double>"
        profiles = result.profiles.select("batch", "cell_idx", F.col("cna").cast(kind).alias("cna"))
        profiles.observe(seen, F.count("*").alias("n_profiles"), F.min(F.size("cna")).alias("least"), F.max(F.size("cna")).alias("most")).write.mode("overwrite").parquet(f"{path}/obsm/cna")
        result.places.orderBy("place").observe(rows, F.count("*").alias("n_places")).write.mode("overwrite").parquet(f"{path}/uns/bins")
        summary |= {"n_profiles": seen.get["n_profiles"]} | rows.get
        if summary["n_profiles"] and not seen.get["least"] == seen.get["most"] == summary["n_places"]:
            raise ValueError(f"profiles have {seen.get['least']} to {seen.get['most']} places, the bins {summary['n_places']}")
    spark.createDataFrame([tuple(summary.values())], "batch_column string, n_cells long, n_called long, n_profiles long, n_places long").coalesce(1).write.mode("overwrite").parquet(f"{path}/uns/summary")
    return summary


def read_cohort(spark: SparkSession, path: str) -> Cohort:
    """A container that write_cohort has finished; another path is an error of Spark's reader."""
    summary = spark.read.parquet(f"{path}/uns/summary").first().asDict()
    have = _there(spark, f"{path}/obsm/cna")
    cna, bins = (spark.read.parquet(f"{path}/{x}") for x in ("obsm/cna", "uns/bins")) if have else (None, None)
    return Cohort(spark.read.parquet(f"{path}/obs"), cna, bins, spark.read.parquet(f"{path}/uns/per_batch"), summary)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    at, system = _path(spark, path)
    return system.exists(at)


def _drop(spark: SparkSession, path: str) -> None:
    at, system = _path(spark, path)
    system.delete(at, True)
