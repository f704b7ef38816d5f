"""Draws of many seeds as plans against the stream of each seed."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ploidyforge.functions.rstream import RStream, scramble
from ploidyforge.functions.stats import qnorm
from ploidyforge.operators import draws

SEEDS = [0, 1, 7, 7, 1234, 2**31 - 1, 2**32 - 1, 2**32 + 5, -3, None]


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([(s, "x") for s in SEEDS], "seed long, k string").repartition(4)


def by_seed(df, column):
    out = {}
    for r in df.collect():
        out.setdefault(r["seed"], {}).setdefault(r["k"], []).append(r[column])
    return out


def test_words_uniforms_and_normals_equal_the_streams(seeds):
    words, u, z = by_seed(draws.words(seeds, 60), "word"), by_seed(draws.uniforms(seeds, draws.FIRST), "u"), by_seed(draws.normals(seeds, draws.FIRST // 2), "z")
    for s in set(SEEDS) - {None}:
        times = SEEDS.count(s)
        assert [words[s][k + 1] for k in range(60)] == [[w] * times for w in scramble(s, 60)]
        assert [u[s][k + 1] for k in range(draws.FIRST)] == [[float(x)] * times for x in RStream(s).uniforms(draws.FIRST)]
        assert np.allclose([z[s][k + 1][0] for k in range(draws.FIRST // 2)], RStream(s).normals(draws.FIRST // 2), rtol=1e-12, atol=1e-14)
    for got in (words, u, z):
        assert {x for rows in got[None].values() for x in rows} == {None}


def test_more_draws_than_the_state_allows_are_refused(seeds):
    for call in (lambda: draws.uniforms(seeds, draws.FIRST + 1), lambda: draws.normals(seeds, 114), lambda: draws.uniforms(seeds, 0)):
        with pytest.raises(ValueError):
            call()


def test_no_rows_and_no_python(seeds):
    for df in (draws.words(seeds, 3), draws.uniforms(seeds, 3), draws.normals(seeds, 3)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert draws.normals(seeds.where("seed = 99"), 2).count() == 0


def test_quantiles_in_the_far_tails(spark):
    p = [1e-300, 1e-20, 1e-9, 0.074999, 0.075, 0.3, 0.5, 0.925, 0.925001, 1 - 1e-12]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(draws.qnorm(F.col("p"))).collect()
    assert np.allclose([r[0] for r in got], qnorm(np.array(p)), rtol=1e-13)


def test_gamma_means_by_row(spark):
    rows = [(5, [0.5, 3.0, 40.0]), (6, []), (None, [1.0]), (7, None), (5, [0.5])]
    got = {(r["seed"], len(r["means"]) if r["means"] is not None else None): r["means"] for r in draws.gamma_means(spark.createDataFrame(rows, "seed long, shapes array<double>"), 500).collect()}
    assert got[(5, 3)] == RStream(5).gamma_means(500, [(0.5, 1.0), (3.0, 1.0), (40.0, 1.0)]).tolist() and got[(5, 1)][0] == got[(5, 3)][0]
    assert got[(6, 0)] == [] and got[(None, None)] is None and got[(7, None)] is None
    assert abs(got[(5, 3)][2] - 40) < 2
