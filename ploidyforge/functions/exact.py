"""Sums, means and deviations that don't depend on the order of their terms.

A double is a whole number m of 53 bits times a power of two. Terms are grouped by that power and their m summed as whole
numbers, in two halves, so partial sums merge in any order; a group's total is put together as one large whole number and
rounded once.
"""

from __future__ import annotations

from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the lower half of a number's 53 bits; least exponent of a double; its place above the smallest double.
HALF, LEAST, DOWN = 27, -1022, 1074


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def exponent(x: Column) -> Column:
    """e with 2**e <= |x| < 2**(e + 1); the least exponent for smaller ones, 0 included."""
    size = F.abs(x)
    rough = F.greatest(F.least(F.coalesce(F.floor(F.log2(F.nullif(size, F.lit(0.0)))), F.lit(LEAST)), F.lit(1023)), F.lit(LEAST)).cast("int")
    y = size / _power(rough)
    return F.when((y >= 2) & (rough < 1023), rough + 1).when((y < 1) & (rough > LEAST), rough - 1).otherwise(rough)


def _gathered(groups: pd.Series, deviations: bool) -> pd.DataFrame:
    out = []
    for parts in groups:
        n = total = squares = 0
        for p in parts:
            up = p["e"] - 52 + DOWN
            n += p["n"]
            total += ((int(p["high"]) << HALF) + int(p["low"])) << up
            if deviations:
                squares += ((int(p["hh"]) << 2 * HALF) + (int(p["hl"]) << HALF + 1) + int(p["ll"])) << 2 * up
        sd = None
        if deviations and n > 1:
            # the variance is (n squares - total^2) / (n (n - 1)) in units of 4**-DOWN; its root to 80 bits more than a double's
            over, under = n * squares - total * total, n * (n - 1)
            more = max(0, 280 - over.bit_length() + under.bit_length() + 1) // 2
            sd = isqrt((over << 2 * more) // under) / (1 << DOWN + more) if over else 0.0
        out.append((n, total / (1 << DOWN) if n else None, total / (n << DOWN) if n else None, sd))
    return pd.DataFrame(out, columns=["n", "total", "mean", "sd"])


def exact_stats(long: DataFrame, keys: list[str], value: str = "x", deviations: bool = True) -> DataFrame:
    """keys, n, total, mean, sd (sample; null for one value): each rounded once from its exact value, so equal bit for bit
    however the rows are partitioned and in whatever order they come.

    Values are finite; nulls don't count. A group has a row for each exponent of its values, 2,046 at most, before it is
    put together. A total beyond the doubles is an error."""
    known = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x")).withColumn("e", exponent(F.col("x")))
    m = (F.col("x") / _power(F.col("e")) * F.lit(float(1 << 52))).cast("long")
    split = known.withColumn("m", m).withColumns({"high": F.shiftright("m", HALF), "low": F.col("m").bitwiseAND((1 << HALF) - 1)})
    sums = [F.count("*").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")]
    if deviations:
        wide = {c: F.col(c).cast("decimal(20,0)") for c in ("hh", "hl", "ll")}
        split = split.withColumns({"hh": F.col("high") * F.col("high"), "hl": F.col("high") * F.col("low"), "ll": F.col("low") * F.col("low")})
        sums += [F.sum(x).alias(c) for c, x in wide.items()]
    parts = split.groupBy(*keys, "e").agg(*sums)
    fields = ["e", "n", "high", "low"] + (["hh", "hl", "ll"] if deviations else [])

    @F.pandas_udf("n long, total double, mean double, sd double")
    def gathered(groups: pd.Series) -> pd.DataFrame:
        return _gathered(groups, deviations)

    whole = parts.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("parts")).withColumn("s", gathered("parts"))
    return whole.select(*keys, "s.n", "s.total", "s.mean", "s.sd")
