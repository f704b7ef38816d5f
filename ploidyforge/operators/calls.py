"""Diploid and aneuploid calls, and measures of agreement between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked


def readjusted(long: DataFrame, diploid: DataFrame, share: float = 0.25) -> DataFrame:
    """cell_idx, pos, x: values relative to the diploid cells, small ones set to the cell's mean, recentred.

    ratio = x - mean over diploid cells, centred by cell; base and sd are the diploid cells' mean and sample sd of
    the ratio by position; where |ratio - base| <= share * sd the cell's mean ratio stands instead."""
    chosen = diploid.select("cell_idx").withColumn("dip", F.lit(True))
    marked = long.join(chosen, "cell_idx", "left").withColumn("dip", F.coalesce("dip", F.lit(False)))
    by_cell, by_pos = Window.partitionBy("cell_idx"), Window.partitionBy("pos")

    def over_diploid(fn, c):
        return fn(F.when(F.col("dip"), F.col(c))).over(by_pos)

    ratio = marked.withColumn("ratio", F.col("x") - over_diploid(F.avg, "x"))
    ratio = ratio.withColumn("ratio", F.col("ratio") - F.avg("ratio").over(by_cell))
    judged = ratio.withColumn("near", F.abs(F.col("ratio") - over_diploid(F.avg, "ratio")) <= share * over_diploid(F.stddev_samp, "ratio"))
    put = judged.withColumn("y", F.when(F.col("near"), F.avg("ratio").over(by_cell)).otherwise(F.col("ratio")))
    return put.select("cell_idx", "pos", (F.col("y") - F.avg("y").over(by_cell)).alias("x"))


def wasserstein(medians: DataFrame) -> DataFrame:
    """a, b, d: mean absolute difference of two groups' sorted profiles (grp, pos, median), for a < b."""
    turn = medians.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy("median")))
    left, right = turn.select(F.col("grp").alias("a"), "rn", F.col("median").alias("x")), turn.select(F.col("grp").alias("b"), "rn", F.col("median").alias("y"))
    return left.join(right, "rn").where("a < b").groupBy("a", "b").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("d"))


def nearer_call(to_diploid: Column, to_aneuploid: Column) -> Column:
    return F.when(to_diploid < to_aneuploid, "diploid").otherwise("aneuploid")


def low_confidence(call: Column, flagged: Column) -> Column:
    """c1:diploid:low.conf and c2:aneuploid:low.conf where the baseline is not certain."""
    return F.when(flagged & (call == "diploid"), "c1:diploid:low.conf").when(flagged & (call == "aneuploid"), "c2:aneuploid:low.conf").otherwise(call)


def plain_label(label: Column) -> Column:
    """A call without c1:, c2: and :low.conf."""
    return F.regexp_replace(F.regexp_replace(label, "^c[12]:", ""), ":low\\.conf$", "")


def contingency(a: DataFrame, b: DataFrame, left: str, right: str, on: str = "cell") -> DataFrame:
    return a.join(b, on).groupBy(F.col(left).alias("x"), F.col(right).alias("y")).agg(F.count("*").cast("double").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def agreement(table: DataFrame, positive: str = "aneuploid") -> DataFrame:
    """n, accuracy, ari, kappa of a contingency table (x, y, n), and fmi of positive against all else.

    The table has a row per pair of labels; its margins are windows over it."""
    t = table.withColumns({"rx": F.sum("n").over(Window.partitionBy("x")), "cy": F.sum("n").over(Window.partitionBy("y"))})
    first_x, first_y = F.row_number().over(Window.partitionBy("x").orderBy("y")) == 1, F.row_number().over(Window.partitionBy("y").orderBy("x")) == 1
    t = t.withColumns({"fx": first_x, "fy": first_y})
    p, q = F.col("x") == positive, F.col("y") == positive
    total = t.agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0.0)).alias("hit"),
        F.sum(_pairs(F.col("n"))).alias("nij"), F.sum(F.when(F.col("fx"), _pairs(F.col("rx"))).otherwise(0.0)).alias("ai"), F.sum(F.when(F.col("fy"), _pairs(F.col("cy"))).otherwise(0.0)).alias("bj"),
        F.sum(F.when(F.col("x") == F.col("y"), F.col("rx") * F.col("cy")).otherwise(0.0)).alias("chance"),
        F.sum(F.when(p & q, F.col("n")).otherwise(0.0)).alias("pp"), F.sum(F.when(p & ~q, F.col("n")).otherwise(0.0)).alias("pn"), F.sum(F.when(~p & q, F.col("n")).otherwise(0.0)).alias("np"), F.sum(F.when(~p & ~q, F.col("n")).otherwise(0.0)).alias("nn"))
    n, by_chance = F.col("n"), F.col("ai") * F.col("bj") / _pairs(F.col("n"))
    ari = (F.col("nij") - by_chance) / ((F.col("ai") + F.col("bj")) / 2 - by_chance)
    pe = F.col("chance") / (n * n)
    together = _pairs(F.col("pp")) + _pairs(F.col("pn")) + _pairs(F.col("np")) + _pairs(F.col("nn"))
    rows, cols = _pairs(F.col("pp") + F.col("pn")) + _pairs(F.col("np") + F.col("nn")), _pairs(F.col("pp") + F.col("np")) + _pairs(F.col("pn") + F.col("nn"))
    return total.select("n", (F.col("hit") / n).alias("accuracy"), ari.alias("ari"), ((F.col("hit") / n - pe) / (1 - pe)).alias("kappa"), (together / F.sqrt(rows * cols)).alias("fmi"))


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_cells and median, mean, min of the per-cell Pearson and Spearman correlation of two long tables (cell_idx, pos, x).

    Only shared cells and positions count; an undefined correlation counts 0."""
    from .profiles import ranked

    both = a.select("cell_idx", "pos", F.col("x").alias("xa")).join(b.select("cell_idx", "pos", F.col("x").alias("xb")), ["cell_idx", "pos"])
    ra = ranked(both.select("cell_idx", "pos", F.col("xa").alias("x"))).withColumnRenamed("x", "ra")
    rb = ranked(both.select("cell_idx", "pos", F.col("xb").alias("x"))).withColumnRenamed("x", "rb")

    def corr(x, y):
        c = F.corr(x, y)
        return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)

    by_cell = both.join(ra, ["cell_idx", "pos"]).join(rb, ["cell_idx", "pos"]).groupBy("cell_idx").agg(corr("xa", "xb").alias("pearson"), corr("ra", "rb").alias("spearman"))
    return by_cell.agg(F.count("*").alias("n_cells"), *[f(c).alias(f"{name}_{c}") for c in ("pearson", "spearman") for name, f in (("median", F.median), ("mean", F.avg), ("min", F.min))])


def heatmap_order(cells: DataFrame, prediction: DataFrame) -> DataFrame:
    """cell_idx, cell, prediction, place: by prediction, then name; cells without prediction last."""
    joined = cells.join(prediction.select("cell_idx", "prediction"), "cell_idx", "left")
    keyed = joined.select("cell_idx", "cell", "prediction", F.coalesce("prediction", F.lit("zzz")).alias("kind"))
    return ranked(keyed, ["kind", "cell", "cell_idx"]).select("cell_idx", "cell", "prediction", F.col("place").cast("int").alias("place"))


def cna_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """cell_idx, pos, delta on shared cells and bins."""
    return a.select("cell_idx", "pos", F.col("x").alias("xa")).join(b.select("cell_idx", "pos", F.col("x").alias("xb")), ["cell_idx", "pos"]).select("cell_idx", "pos", (F.col("xa") - F.col("xb")).alias("delta"))
