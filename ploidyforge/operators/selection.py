"""Exact medians of groups of any size by counting passes over value ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

#: Values of a group that an aggregate may buffer, and ranges a pass counts.
SMALL, RANGES = 10_000, 256


def medians(long: DataFrame, keys: list[str], value: str = "x", small: int = SMALL, ranges: int = RANGES, most: int | None = None) -> DataFrame:
    """keys, median: the exact median (the mean of the two middle values) of value by keys.

    Groups of small values or fewer are left to Spark's median, which holds them. In larger ones a pass counts the values
    of the range that is left in equal parts, for all groups at once, and keeps the part with the wanted rank, narrowed to
    its least and largest value; it ends when these are one, or when few values are left. So a task holds a
    count for each part, however large a group is. Values are finite; nulls don't count, and a group of nulls has none.
    most: a number of values that no group exceeds, if one is known; groups are not counted where it is small."""
    held = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    if most is None:
        most = held.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= small:
        return held.groupBy(*keys).agg(F.median("x").alias("median"))
    held = settled(held, "values")
    sizes = settled(held.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "sizes")
    large = sizes.where(F.col("n") > small)
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    on = reduce(lambda x, y: x & y, same)
    mine = [F.col(f"v.{k}").alias(k) for k in keys]
    plain = held.alias("v").join(large.alias("s"), on, "left_anti").groupBy(*keys).agg(F.median("x").alias("median"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.expr("(n - 1) div 2").alias("rank")), F.struct(F.lit(1).alias("which"), F.expr("n div 2").alias("rank")))).alias("w")
    open_ = settled(large.select(*keys, "n", "lo", "hi", both).select(*keys, "w.which", "w.rank", "n", "lo", "hi"), "open")
    found = []
    while True:
        found.append(open_.where("lo = hi").select(*keys, "which", F.col("lo").alias("x")))
        few = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") <= small))
        inside = held.alias("v").join(few.alias("s"), on & F.col("v.x").between(F.col("s.lo"), F.col("s.hi")))
        taken = inside.groupBy(*mine, F.col("s.which").alias("which")).agg(F.array_sort(F.collect_list("v.x")).alias("all"), F.first("s.rank").alias("rank"))
        found.append(taken.select(*keys, "which", F.element_at("all", F.col("rank").cast("int") + 1).alias("x")))
        open_ = open_.where((F.col("lo") < F.col("hi")) & (F.col("n") > small))
        if open_.isEmpty():
            break
        inside = held.alias("v").join(open_.alias("s"), on & F.col("v.x").between(F.col("s.lo"), F.col("s.hi")))
        x, lo, hi = F.col("v.x"), F.col("s.lo"), F.col("s.hi")
        # a difference beyond the doubles is taken in halves
        share = F.when(hi - lo < float("inf"), (x - lo) / (hi - lo)).otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2))
        part = F.least(F.floor(share * ranges), F.lit(ranges - 1)).alias("part")
        counts = inside.groupBy(*mine, F.col("s.which").alias("which"), F.col("s.rank").alias("rank"), part).agg(F.count("*").alias("n"), F.min("v.x").alias("lo"), F.max("v.x").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "which").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = counts.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        open_ = settled(ranked.select(*keys, "which", (F.col("rank") - F.col("before")).alias("rank"), "n", "lo", "hi"), "open")
    middle = reduce(DataFrame.unionByName, found).groupBy(*keys).agg((F.sum(F.col("x") / 2)).alias("median"))
    return plain.unionByName(middle)
