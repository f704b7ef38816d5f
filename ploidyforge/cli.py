"""Command line: version, run (one sample), run-batches and run-h5ad (many)."""

from __future__ import annotations

import argparse
import sys

from . import __version__
from .config import DISTANCES, GENOMES, SAMPLERS, Config
from .sources import cohort


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ploidyforge", description="Copy-number profiles and calls from single-cell counts, on Spark.")
    kinds = top.add_subparsers(dest="command", required=True)
    kinds.add_parser("version", help="print the version")
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--reference", required=True, help="folder of annotation, bins and cell-cycle genes")
    shared.add_argument("--sam-name", default="")
    shared.add_argument("--output-dir", default=".")
    shared.add_argument("--id-type", default="Symbol")
    shared.add_argument("--genome", choices=GENOMES, default="hg20")
    shared.add_argument("--distance", choices=DISTANCES, default="euclidean")
    shared.add_argument("--sampler", choices=SAMPLERS, default="exact")
    shared.add_argument("--cell-line", action=argparse.BooleanOptionalAction, default=False)
    shared.add_argument("--norm-cell-names", nargs="*", default=None)
    for name, kind in (("ngene-chr", int), ("min-gene-per-cell", int), ("low-dr", float), ("up-dr", float), ("win-size", int), ("ks-cut", float), ("seed", int), ("mc", int), ("min-breaks", int)):
        shared.add_argument(f"--{name}", type=kind, default=getattr(Config, name.replace("-", "_")))
    one = kinds.add_parser("run", parents=[shared], help="one sample from a text table or Matrix Market file")
    one.add_argument("counts", help=".csv, .tsv, .txt or .mtx")
    one.add_argument("--genes", help="gene names of a .mtx")
    one.add_argument("--cells", help="cell names of a .mtx")
    one.add_argument("--output-h5ad", action=argparse.BooleanOptionalAction, default=False)
    many = kinds.add_parser("run-batches", parents=[shared], help="all batches of Parquet tables counts, genes and cells")
    many.add_argument("tables", help="folder with counts.parquet, genes.parquet, cells.parquet")
    annotated = kinds.add_parser("run-h5ad", parents=[shared], help="all batches of an annotated matrix, into one container")
    annotated.add_argument("--adata", required=True, help="the .h5ad file, where all executors can open it")
    annotated.add_argument("--batch-key", required=True, help="the column of obs that holds the batch labels")
    annotated.add_argument("--layer", default=None, help="the layer with raw counts; X if none is given")
    annotated.add_argument("--output", required=True, help="folder of the container")
    annotated.add_argument("--cna-storage", choices=cohort.STORAGES, default="obsm")
    annotated.add_argument("--cna-dtype", choices=cohort.CNA_TYPES, default="float32")
    annotated.add_argument("--prefix", default="", help="of the columns that obs gains")
    for kind in (many, annotated):
        kind.add_argument("--min-cells-per-batch", type=int, default=100)
        kind.add_argument("--on-error", choices=("skip", "raise"), default="skip")
    return top


def config(args: argparse.Namespace) -> Config:
    names = Config.__dataclass_fields__
    given = {k: v for k, v in vars(args).items() if k in names}
    if given.get("norm_cell_names") is not None:
        given["norm_cell_names"] = tuple(given["norm_cell_names"])
    return Config(**given)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    cfg = config(args)
    from pyspark.sql import SparkSession

    from .plans.pipeline import Tables, run, run_batches
    from .sources import readers, reference, sinks

    spark = spark or SparkSession.builder.appName("ploidyforge").getOrCreate()
    folder = reference.data_dir(spark, args.reference)
    anno = reference.annotation(spark, folder, cfg.genome)
    human = cfg.genome == "hg20"
    bins = reference.bins(spark, folder) if human else None
    anti = reference.cycle_genes(spark, folder) if human else None
    if args.command == "run":
        read = readers.read_mtx(spark, args.counts, args.genes, args.cells) if args.counts.endswith(".mtx") else readers.read_table(spark, args.counts)
        result = run(Tables(*read, anno, bins, anti), cfg)
        sinks.to_txt(result, "all", cfg.sam_name, cfg.output_dir)
        if cfg.output_h5ad:
            sinks.to_h5ad(result, "all", f"{cfg.output_dir}/{cfg.sam_name or 'sample'}.h5ad")
        return 0
    if args.command == "run-h5ad":
        read = readers.read_h5ad(spark, args.adata, args.batch_key, args.layer, obs=True)
        result = run_batches(Tables(*read, anno, bins, anti), cfg, args.min_cells_per_batch, args.on_error)
        cohort.write_cohort(result, args.output, args.cna_storage, args.cna_dtype, args.prefix)
        return 0
    tables = [spark.read.parquet(f"{args.tables}/{x}.parquet") for x in ("counts", "genes", "cells")]
    sinks.to_parquet(run_batches(Tables(*tables, anno, bins, anti), cfg, args.min_cells_per_batch, args.on_error), args.output_dir)
    return 0


if __name__ == "__main__":
    sys.exit(main())
