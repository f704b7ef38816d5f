"""Readers, sinks, command line, streaming, heatmap data."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ploidyforge import cli
from ploidyforge.config import Config
from ploidyforge.operators import calls, heatmap, qc, segments
from ploidyforge.plans import pipeline
from ploidyforge.plans.batch import batch_status
from ploidyforge.sources import readers, reference, sinks
from ploidyforge.streaming import depth

from .planted import planted

FRAME = pd.DataFrame([[1, 0, 3], [0, 2, 0]], index=["GA", "GB"], columns=["c1", "c2", "c3"])
TRIPLETS = [(0, 0, 1.0), (0, 2, 3.0), (1, 1, 2.0)]


def rows(df, *c):
    return sorted(tuple(r) for r in df.select(*c).collect())


def check(read):
    counts, genes, cells = read[:3]
    assert rows(counts, "gene_idx", "cell_idx", "umi") == TRIPLETS
    assert rows(genes, "gene_idx", "gene") == [(0, "GA"), (1, "GB")] and rows(cells, "cell_idx", "cell") == [(0, "c1"), (1, "c2"), (2, "c3")]


def test_readers(spark, tmp_path):
    check(readers.from_matrix(spark, FRAME))
    check(readers.from_matrix(spark, FRAME.to_numpy(), FRAME.index, FRAME.columns))
    with pytest.raises(TypeError):
        readers.from_matrix(spark, {"a": 1})
    FRAME.to_csv(tmp_path / "x.csv")
    check(readers.read_table(spark, str(tmp_path / "x.csv")))
    FRAME.to_csv(tmp_path / "x.tsv", sep="\t")
    check(readers.read_table(spark, str(tmp_path / "x.tsv")))
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n2 3 3\n1 1 1\n1 3 3\n2 2 2\n")
    (tmp_path / "g.txt").write_text("GA\nGB\n")
    (tmp_path / "c.txt").write_text("c1\nc2\nc3\n")
    check(readers.read_mtx(spark, str(tmp_path / "m.mtx"), str(tmp_path / "g.txt"), str(tmp_path / "c.txt")))
    np.savez(tmp_path / "s.npz", data=[1, 2, 3], indices=[0, 1, 0], indptr=[0, 1, 2, 3], shape=[2, 3], genes=["GA", "GB"], cells=["c1", "c2", "c3"])
    check(readers.read_npz(spark, str(tmp_path / "s.npz")))
    (tmp_path / "geo.txt").write_text("\tc1\tc2\tc3\ncall\tN\tT\tN\nskip\t0\t0\t0\nGA\t1\t0\t3\nGB\t0\t2\t0\nGA\t9\t9\t9\n")
    labelled = readers.read_labelled(spark, str(tmp_path / "geo.txt"))
    check(labelled)
    assert rows(labelled[3], "cell_idx", "call") == [(0, "N"), (1, "T"), (2, "N")]
    with pytest.raises(ImportError):
        readers.read_h5ad(spark, "none.h5ad")


def reference_folder(spark, folder, tables):
    anno = tables.annotation.orderBy("src_idx").select("abspos", F.col("chrom").alias("chromosome_name"), F.col("start").alias("start_position"), F.col("end").alias("end_position"), "ensembl_gene_id", F.col("symbol").alias("hgnc_symbol"))
    anno.coalesce(1).write.parquet(f"{folder}/{reference.FILES['hg20']}")
    tables.bins.withColumn("abspos", F.col("bin_idx").cast("long")).coalesce(1).write.parquet(f"{folder}/{reference.BINS}")
    (folder / reference.CYCLE).write_text("G5\n\n  G6  \n")


def test_reference_tables(spark, tmp_path):
    tables = planted(spark, normal=2, tumour=2, genes=220)
    reference_folder(spark, tmp_path, tables)
    folder = reference.data_dir(spark, str(tmp_path / "absent"), str(tmp_path))
    assert reference.annotation(spark, folder).count() == 220 and rows(reference.cycle_genes(spark, folder), "gene") == [("G5",), ("G6",)]
    assert reference.bins(spark, folder).columns == ["bin_idx", "chrom", "chrompos", "abspos"]
    with pytest.raises(NotImplementedError):
        reference.annotation(spark, folder, "hg99")
    with pytest.raises(FileNotFoundError):
        reference.data_dir(spark, str(tmp_path / "absent"))


def test_command_line_writes_what_the_function_gives(spark, tmp_path, capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip()
    tables = planted(spark, genes=1500)
    reference_folder(spark, tmp_path, tables)
    pdf = tables.counts.toPandas()
    wide = pd.DataFrame(0, index=[f"G{k}" for k in range(1500)], columns=[r["cell"] for r in tables.cells.orderBy("cell_idx").collect()])
    wide.values[pdf.gene_idx, pdf.cell_idx] = pdf.umi
    wide.to_csv(tmp_path / "x.csv")
    args = ["run", str(tmp_path / "x.csv"), "--reference", str(tmp_path), "--output-dir", str(tmp_path / "out"), "--sam-name", "S", "--sampler", "exact", "--mc", "100", "--min-breaks", "5", "--ks-cut", "0.3"]
    assert cli.main(args, spark) == 0
    got = spark.read.csv(str(tmp_path / "out/S_prediction.txt"), sep="\t", header=True)
    assert got.count() == 120 and set(got.columns) == {"cell.names", "call"}
    cna = spark.read.csv(str(tmp_path / "out/S_CNA_results.txt"), sep="\t", header=True)
    assert cna.columns[:3] == ["chrom", "chrompos", "abspos"] and len(cna.columns) == 123
    for name, df in (("counts", tables.counts), ("genes", tables.genes), ("cells", tables.cells)):
        df.write.parquet(str(tmp_path / f"in/{name}.parquet"))
    assert cli.main(["run-batches", str(tmp_path / "in"), "--reference", str(tmp_path), "--output-dir", str(tmp_path / "many"), "--min-cells-per-batch", "1000"], spark) == 0
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "many/prediction")).select("prediction").collect()} == {"not.defined"}
    with pytest.raises(ValueError):
        sinks.to_parquet(None, "x", "int8")


def test_filters_keep_their_edge_rules(spark):
    def counts(depths):
        return spark.createDataFrame([("b", g, c, 1.0) for c, n in enumerate(depths) for g in range(n)], "batch string, gene_idx int, cell_idx int, umi double")

    assert rows(qc.deep_cells(counts([5, 6, 2]), 5), "cell_idx") == [(0,), (1,), (2,)]  # a single shallow cell stays
    assert rows(qc.deep_cells(counts([5, 6, 2, 3]), 5), "cell_idx") == [(0,), (1,)]
    c = counts([4, 2])
    assert rows(qc.common_genes(c, 0.5), "gene_idx") == [(0,), (1,)] and rows(qc.frequent_genes(c, 0.5), "gene_idx") == [(0,), (1,), (2,), (3,)]
    assert len(rows(qc.common_genes(c, 1.0), "gene_idx")) == 4  # none passes: all stay
    zero = c.withColumn("umi", F.when(F.col("gene_idx") == 0, 0.0).otherwise(1.0))
    assert rows(qc.cell_depth(zero), "cell_idx", "n_genes") == [(0, 3), (1, 1)]


def test_edges_of_bins_and_duplicates(spark):
    bins = spark.createDataFrame([(0, 1, 10, 1), (1, 1, 20, 2), (2, 2, 10, 3), (3, 24, 5, 4)], "bin_idx int, chrom int, chrompos long, abspos long")
    genes = spark.createDataFrame([(0, 1, 8, 12), (1, 2, 2, 4)], "gene_idx int, chrom int, start long, end long")
    edges = segments.bin_edges(bins)
    members = segments.genes_in_bins(genes, edges)
    assert rows(members, "bin_idx", "gene_idx") == [(0, 0), (1, 0)]  # on the edge: both; chromosome 2's first bin is empty
    assert rows(segments.nearest_filled(edges, members), "bin_idx", "source") == [(0, 0), (1, 1), (2, 1)]
    g = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A")], "gene_idx int, gene string")
    a = spark.createDataFrame([(0, "B", 1, 7, 0, 1), (1, "A", 1, 7, 0, 1), (2, "A", 9, 1, 0, 1)], "src_idx int, symbol string, chrom int, abspos int, start int, end int")
    assert rows(qc.annotate(g, a), "gene_idx", "chrom", "pos") == [(0, 1, 0), (1, 1, 1)]


def test_metrics_of_equal_and_different_calls(spark):
    one = spark.createDataFrame([(k, "aneuploid" if k < 6 else "c1:diploid:low.conf") for k in range(10)], "cell int, p string").withColumn("p", calls.plain_label(F.col("p")))
    table = calls.contingency(one, one.withColumnRenamed("p", "q"), "p", "q")
    got = calls.agreement(table).first()
    assert (got["n"], got["accuracy"], got["ari"], got["kappa"], got["fmi"]) == (10, 1, 1, 1, 1)


def test_heatmap_data(spark):
    cells = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "cell_idx int, cell string")
    prediction = spark.createDataFrame([(0, "diploid"), (1, "diploid")], "cell_idx int, prediction string")
    cna = spark.createDataFrame([(k, p, float(k)) for k in range(3) for p in range(2)], "cell_idx int, place int, x double")
    assert rows(heatmap.ordered_matrix(cna, cells, prediction).where("place = 0"), "row", "cell") == [(1, "a"), (2, "b"), (3, "c")]
    long = cna.withColumnRenamed("place", "pos")
    assert {r["delta"] for r in heatmap.compared(long, long).collect()} == {0.0}


def test_missing_batch_labels_are_a_batch(spark):
    cells = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "batch string, cell_idx int")
    assert rows(batch_status(cells, 2), "batch", "status") == [("None", "ok"), ("a", "skipped_too_small")]


def test_depth_stream(spark, tmp_path):
    spark.createDataFrame([("b", g, c, float(g)) for c in range(3) for g in range(c + 2)], "batch string, gene_idx int, cell_idx int, umi double").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("batch string, gene_idx int, cell_idx int, umi double").parquet(str(tmp_path / "s"))
    assert rows(depth.drained(spark, depth.depth_stream(stream), "batch", "cell_idx"), "cell_idx", "n_genes") == [(0, 1), (1, 2), (2, 3)]


def test_too_few_genes_is_reported(spark):
    tables = planted(spark, normal=20, tumour=20, genes=60)
    meta = pipeline.run(tables, Config(min_gene_per_cell=10, ngene_chr=1, sampler="expected"), on_error="skip").meta.first()
    assert meta["status"] == "error" and meta["note"]


def test_wide_files_of_many_cells(spark, tmp_path):
    """20,000 cells: one file, a line a bin, written without a plan as wide as the cells."""
    from types import SimpleNamespace

    n, bins = 20_000, 12
    cells = spark.range(n).select(F.lit("s").alias("batch"), F.col("id").cast("int").alias("cell_idx"), F.when(F.col("id") == 7, "odd\tname").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("cell"))
    cna = spark.range(n * bins).select(F.lit("s").alias("batch"), (F.col("id") % n).cast("int").alias("cell_idx"), F.floor(F.col("id") / n).cast("int").alias("place"), (F.col("id") / 7.0).alias("x"))
    places = spark.range(bins).select(F.col("id").cast("int").alias("place"), (F.col("id") + 1).alias("chrom"), (F.col("id") * 10).alias("chrompos"), (F.col("id") * 100).alias("abspos"))
    result = SimpleNamespace(cna=cna.repartition(5), cells=cells.where("cell_idx <> 9999999"), places=places, prediction=cells.withColumn("prediction", F.lit("diploid")))
    for _ in range(2):  # a file that is there is replaced
        paths = sinks.to_txt(result, "s", "S", str(tmp_path))
    assert all(os.path.isfile(p) for p in paths) and sorted(p for p in os.listdir(tmp_path) if not p.startswith(".")) == ["S_CNA_results.txt", "S_prediction.txt"]
    with open(paths[1], newline="\n") as f:
        lines = f.read().split("\n")
    assert len(lines) == bins + 2 and lines[-1] == ""
    assert lines[0].startswith("chrom\tchrompos\tabspos\tc0\tc1\t") and '\t"odd\tname"\t' in lines[0]
    for k in range(bins):
        row = lines[k + 1].split("\t")
        assert row[:3] == [str(k + 1), str(10 * k), str(100 * k)] and len(row) == n + 3
        assert float(row[3]) == k * n / 7.0 and float(row[-1]) == (k * n + n - 1) / 7.0
    with open(paths[0]) as f:
        said = f.read().split("\n")
    assert said[:2] == ["cell.names\tcall", "c0\tdiploid"] and len(said) == n + 2
    result.cna = cna.where("not (cell_idx = 5 and place = 3)")
    with pytest.raises(Exception, match="no value of some cell"):
        sinks.to_txt(result, "s", "T", str(tmp_path))
