"""Sinks: Parquet tables keyed by batch and cell first; tab files and h5ad for small results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import own_dir

CNA_TYPES = ("float32", "float64")


def to_parquet(result, path: str, cna_dtype: str = "float32") -> None:
    """prediction, cna (partitioned by batch), merges, meta and bins below path."""
    if cna_dtype not in CNA_TYPES:
        raise ValueError(f"cna_dtype must be one of {CNA_TYPES}")
    kind = "float" if cna_dtype == "float32" else "double"
    result.prediction.write.mode("overwrite").parquet(f"{path}/prediction")
    result.cna.withColumn("x", F.col("x").cast(kind)).write.mode("overwrite").partitionBy("batch").parquet(f"{path}/cna")
    result.merges.write.mode("overwrite").parquet(f"{path}/merges")
    result.meta.write.mode("overwrite").parquet(f"{path}/meta")
    if result.bins is not None:
        result.bins.write.mode("overwrite").parquet(f"{path}/bins")


def wide_cna(result, batch: str) -> DataFrame:
    """The positions (chrom, chrompos, abspos of a bin; for genes the seven annotation columns) and a column per cell of one
    batch. A table as wide as the batch has cells, for small results; to_txt writes the same without such columns."""
    named = result.cna.where(F.col("batch") == batch).join(result.cells.select("batch", "cell_idx", "cell"), ["batch", "cell_idx"])
    names = [r[0] for r in named.select("cell", "cell_idx").distinct().orderBy("cell_idx").collect()]
    wide = named.groupBy("place").pivot("cell", names).agg(F.first("x"))
    return _places(result, batch).join(wide, "place").orderBy("place").drop("place")


def _places(result, batch: str) -> DataFrame:
    return result.places.where(F.col("batch") == batch).drop("batch") if "batch" in result.places.columns else result.places


def _field(c: Column) -> Column:
    """A field of a tab-separated line, in quotes if it has a tab, a quote or a line end; null as an empty one."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[\t\n\r"]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def wide_lines(result, batch: str) -> tuple[DataFrame, DataFrame]:
    """(one row: the header; place, value: a line for each place) of the table that wide_cna has as columns.

    The values of a place are gathered as one array in order of the cells, so a line is as long as the batch has cells and
    no plan is as wide. A place that lacks some cell's value is an error."""
    values = result.cna.where(F.col("batch") == batch).select("cell_idx", "place", "x")
    mine = result.cells.where(F.col("batch") == batch).join(values.select("cell_idx").distinct(), "cell_idx", "left_semi")
    places = _places(result, batch)
    own = [c for c in places.columns if c != "place"]
    names = F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", _field(F.col("cell")).alias("cell")))), lambda c: c["cell"])
    header = mine.agg(F.concat_ws("\t", *[F.lit(c) for c in own], names).alias("value"), F.count("*").alias("n"))
    rows = values.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("cell_idx", "x"))).alias("v")).join(places, "place")
    n = header.first()["n"]
    dense = F.when(F.size("v") == n, F.transform("v", lambda c: c["x"].cast("string"))).otherwise(F.raise_error(F.lit("a place has no value of some cell")))
    return header.select("value"), rows.select("place", F.concat_ws("\t", *[_field(F.col(c)) for c in own], dense).alias("value"))


def one_file(header: DataFrame, lines: DataFrame, order: str, path: str) -> None:
    """Write header (one row of value) and lines (order, value) as one text file, over one that is there.

    Ordered parts are written by tasks below the shared folder and appended to the file one after another in buffers of a
    megabyte; the file has its name only when it is whole."""
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = f"{own_dir(spark)}/lines-{uuid.uuid4().hex}"
    header.coalesce(1).write.text(f"{folder}/head")
    lines.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(f"{folder}/body")
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    system = target.getFileSystem(conf)
    out = system.create(part)
    try:
        for kind in ("head", "body"):
            found = jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
            there = found.getFileSystem(conf)
            for name in sorted(f.getPath().getName() for f in there.listStatus(found) if f.getPath().getName().startswith("part-")):
                part_in = there.open(jvm.org.apache.hadoop.fs.Path(found, name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part_in, out, 1 << 20, False)
                part_in.close()
    finally:
        out.close()
    system.delete(target, True)
    if not system.rename(part, target):
        raise OSError(f"{path} can't be written")
    gone = jvm.org.apache.hadoop.fs.Path(folder)
    gone.getFileSystem(conf).delete(gone, True)


def to_txt(result, batch: str, name: str, folder: str) -> tuple[str, str]:
    """<name>_prediction.txt and <name>_CNA_results.txt, tab-separated files of one batch, whatever its size."""
    prefix = f"{folder}/{name + '_' if name else ''}"
    paths = f"{prefix}prediction.txt", f"{prefix}CNA_results.txt"
    rows = result.prediction.where(F.col("batch") == batch).select("cell_idx", F.concat_ws("\t", _field(F.col("cell")), _field(F.col("prediction"))).alias("value"))
    one_file(rows.sparkSession.range(1).select(F.lit("cell.names\tcall").alias("value")), rows, "cell_idx", paths[0])
    one_file(*wide_lines(result, batch), "place", paths[1])
    return paths


def to_h5ad(result, batch: str, path: str) -> None:
    """Cells x bins with obs and var; needs the optional anndata package."""
    try:
        import anndata
    except ImportError as e:
        raise ImportError("writing h5ad files needs the anndata package") from e
    wide = wide_cna(result, batch).toPandas()
    cells = [r[0] for r in result.cells.where(F.col("batch") == batch).select("cell").collect() if r[0] in wide]
    obs = result.prediction.where(F.col("batch") == batch).toPandas().set_index("cell").reindex(cells)
    var = wide[[c for c in wide if c not in set(cells)]].rename(index=str)
    anndata.AnnData(wide[cells].to_numpy().T, obs=obs, var=var).write_h5ad(path)
