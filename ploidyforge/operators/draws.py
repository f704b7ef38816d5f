"""Seeded streams side by side: the first draws of a stream for every row's seed, as DataFrame functions.

Words of the seeding generator follow from the seed in closed form, and a stream's first 227 numbers depend on these words
alone, so draws are expressions over (seed, place): no state, no order, no shuffle. Draws equal those of functions.rstream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.rstream import BIG, TWO32, RStream

#: Numbers of a stream that don't depend on earlier ones.
FIRST = 624 - 397
#: Words of the seeding generator before those of a stream's state.
SKIPPED = 51
WORD = 0xFFFFFFFF


def _step(n: int) -> tuple[int, int]:
    """Factor and summand, modulo 2^32, of n steps of the seeding generator."""
    a, c = 1, 0
    for _ in range(n):
        a, c = a * 69069 & WORD, (c * 69069 + 1) & WORD
    return a, c


def _after(seed: Column, step: Column) -> Column:
    """The generator's word some steps after seed; the product is taken in halves, so that it fits a long."""
    a, s = step["a"], seed.bitwiseAND(F.lit(WORD))
    high = F.shiftleft((F.shiftright(a, 16) * s).bitwiseAND(F.lit(0xFFFF)), 16)
    return (high + a.bitwiseAND(F.lit(0xFFFF)) * s + step["c"]).bitwiseAND(F.lit(WORD))


def _listed(n: int, steps: list) -> list[Column]:
    """For each of n places its number and the generator's steps to the words it needs."""
    def literal(pair: tuple[int, int]) -> Column:
        return F.struct(F.lit(pair[0]).cast("long").alias("a"), F.lit(pair[1]).cast("long").alias("c"))

    return [F.struct(F.lit(k + 1).alias("k"), *[literal(_step(f(k))).alias(f"s{i}") for i, f in enumerate(steps)]) for k in range(n)]


def words(seeds: DataFrame, n: int) -> DataFrame:
    """seed, k (from 1), word: the seeding generator's first n words for each row's seed (a long). A null seed gives null
    words; repeated seeds are kept, each with the same words; an empty table gives no rows."""
    at = seeds.select(F.col("seed").cast("long").alias("seed"), F.explode(F.array(*_listed(n, [lambda k: k + 1]))).alias("p"))
    return at.select("seed", F.col("p.k").alias("k"), _after(F.col("seed"), F.col("p.s0")).alias("word"))


def _uniform(seed: Column, place: Column) -> Column:
    """The uniform at a place, whose steps lead to the three words that it is made of."""
    a, b, c = (_after(seed, place[f"s{i}"]) for i in range(3))
    joined = a.bitwiseAND(F.lit(0x80000000)).bitwiseOR(b.bitwiseAND(F.lit(0x7FFFFFFF)))
    return c.bitwiseXOR(F.shiftright(joined, 1)).bitwiseXOR(b.bitwiseAND(F.lit(1)) * F.lit(0x9908B0DF))


def _tempered(df: DataFrame, name: str) -> DataFrame:
    """The column as a uniform in place of a raw word: the generator's tempering (fixed values), scaled into (0, 1)."""
    y = F.col(name)
    df = df.withColumn(name, y.bitwiseXOR(F.shiftright(y, 11)))
    for shift, mask in ((7, 0x9D2C5680), (15, 0xEFC60000)):
        df = df.withColumn(name, y.bitwiseXOR(F.shiftleft(y, shift).bitwiseAND(F.lit(mask))))
    df = df.withColumn(name, y.bitwiseXOR(F.shiftright(y, 18)))
    # greatest and least pass over nulls
    return df.withColumn(name, F.when(y.isNotNull(), F.greatest(F.lit(0.5 * TWO32), F.least(F.lit(1 - 0.5 * TWO32), y.cast("double") * TWO32))))


def _steps(first: Callable[[int], int]) -> list:
    """Steps to the words of each place's number, place k taking number first(k)."""
    return [lambda k, o=o: SKIPPED + 1 + first(k) + o for o in (0, 1, 397)]


def uniforms(seeds: DataFrame, n: int) -> DataFrame:
    """seed, k (from 1), u: the first n uniforms, FIRST at most, of the stream of each row's seed. Nulls, repeated seeds and
    empty tables as with words."""
    if not 0 < n <= FIRST:
        raise ValueError(f"1 to {FIRST} draws of a seed, not {n}")
    at = seeds.select(F.col("seed").cast("long").alias("seed"), F.explode(F.array(*_listed(n, _steps(lambda k: k)))).alias("p"))
    return _tempered(at.select("seed", "p.k", _uniform(F.col("seed"), F.col("p")).alias("u")), "u")


def _ratio(table: tuple, x: Column) -> Column:
    def poly(coefficients) -> Column:
        out = F.lit(0.0)
        for c in reversed(coefficients):
            out = out * x + F.lit(c)
        return out

    return poly(table[0]) / poly(table[1])


def qnorm(p: Column) -> Column:
    """Inverse of the standard normal distribution function for 0 < p < 1."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(stats.AS241_NEAR, r - 1.6)).otherwise(_ratio(stats.AS241_FAR, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _ratio(stats.AS241_CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def normals(seeds: DataFrame, n: int) -> DataFrame:
    """seed, k (from 1), z: the first n normal draws, FIRST / 2 at most, of the stream of each row's seed, two uniforms a
    draw. Nulls, repeated seeds and empty tables as with words."""
    if not 0 < 2 * n <= FIRST:
        raise ValueError(f"1 to {FIRST // 2} normal draws of a seed, not {n}")
    places = F.arrays_zip(*[F.array(*_listed(n, _steps(lambda k, o=o: 2 * k + o))).alias(c) for o, c in enumerate(("one", "two"))])
    at = seeds.select(F.col("seed").cast("long").alias("seed"), F.explode(places).alias("p"))
    raw = at.select("seed", F.col("p.one.k").alias("k"), *[_uniform(F.col("seed"), F.col(f"p.{c}")).alias(c) for c in ("one", "two")])
    both = _tempered(_tempered(raw, "one"), "two")
    return both.select("seed", "k", ((F.floor(BIG * F.col("one")) + F.col("two")) / BIG).alias("p")).select("seed", "k", qnorm(F.col("p")).alias("z"))


def gamma_means(rows: DataFrame, n: int) -> DataFrame:
    """seed, means (an array): for each row (seed, shapes), means of n draws of each shape and rate 1 in order, from the
    stream of the row's seed. Rows are dealt out evenly whatever their bytes, since the draws are the work, and one is drawn at
    a time. A null seed or shapes gives null means, no shapes none; shapes must be above 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = [None if s is None or shapes is None else RStream(s).gamma_means(n, [(x, 1.0) for x in shapes]).tolist() for s, shapes in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(means, pa.list_(pa.float64()))], ["seed", "means"])

    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(F.col("seed").cast("long").alias("seed"), F.col("shapes").cast("array<double>").alias("shapes")).repartition(parts)
    return dealt.mapInArrow(run, "seed long, means array<double>")
