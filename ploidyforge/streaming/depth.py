"""Depth counters that follow a stream of counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import own_dir


def depth_stream(counts: DataFrame) -> DataFrame:
    """batch, cell_idx, n_genes, umi over a stream of counts: a running aggregate in Spark's state store. The state of a cell
    is the set of its genes, so n_genes is exact when places repeat."""
    return counts.where("umi <> 0").groupBy("batch", "cell_idx").agg(F.size(F.collect_set("gene_idx")).cast("long").alias("n_genes"), F.sum("umi").alias("umi"))


def windowed_depth(counts: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """start, batch, cell_idx, umi by windows of the column ts, with a watermark that bounds the state."""
    timed = counts.withWatermark("ts", late).where("umi <> 0")
    return timed.groupBy(F.window("ts", window).alias("w"), "batch", "cell_idx").agg(F.sum("umi").alias("umi")).select(F.col("w.start").alias("start"), "batch", "cell_idx", "umi")


def drained(spark: SparkSession, stream: DataFrame, *keys: str) -> DataFrame:
    """Run a stream over all input there is and return its rows, the last one of each keys.

    Every micro-batch appends the rows that it changed to a Parquet table in the shared folder; nothing gathers in the driver."""
    folder = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, turn: int) -> None:
        rows.withColumn("turn", F.lit(turn)).write.mode("overwrite").parquet(f"{folder}/rows/part={turn}")

    schema = stream.select(*stream.columns, F.lit(0).alias("turn")).schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/rows/part=none")
    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(schema).parquet(f"{folder}/rows/*")
    others = F.struct(*[c for c in stream.columns if c not in keys])
    return found.groupBy(*keys).agg(F.max_by(others, "turn").alias("x")).select(*keys, "x.*")
