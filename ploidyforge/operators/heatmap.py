"""Ordered matrices for drawings, and the drawings if matplotlib is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calls import cna_delta, heatmap_order


def ordered_matrix(cna: DataFrame, cells: DataFrame, prediction: DataFrame) -> DataFrame:
    """row (place of the cell), cell, prediction, place (bin), x: what a heatmap draws."""
    order = heatmap_order(cells, prediction).withColumnRenamed("place", "row")
    return cna.select("cell_idx", "place", "x").join(order, "cell_idx").select("row", "cell", "prediction", "place", "x")


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """cell_idx, pos, left, right, delta on shared cells and bins."""
    both = cna_delta(left, right)
    return both.join(left.select("cell_idx", "pos", F.col("x").alias("left")), ["cell_idx", "pos"]).withColumn("right", F.col("left") - F.col("delta"))


def draw(matrix: DataFrame, path: str, chroms: list[int] | None = None, title: str = "", limit: float = 0.5) -> None:
    """A PNG of an ordered matrix, with a strip of chromosomes above; needs the optional matplotlib package."""
    try:
        import matplotlib
    except ImportError as e:
        raise ImportError("drawing needs the matplotlib package") from e
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    wide = matrix.toPandas().pivot(index="row", columns="place", values="x")
    figure, axes = plt.subplots(2, 1, figsize=(12, 8), gridspec_kw={"height_ratios": [1, 30]}, squeeze=True)
    if chroms is not None:
        axes[0].imshow([[c % 2 for c in chroms]], aspect="auto", cmap="gray")
    axes[0].set_axis_off()
    axes[0].set_title(title)
    axes[1].imshow(wide.to_numpy(), aspect="auto", cmap="RdBu_r", vmin=-limit, vmax=limit, interpolation="nearest")
    figure.savefig(path)
    plt.close(figure)
