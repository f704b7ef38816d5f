"""Selection, exact sums, keyed windows and growing prefixes against plain forms."""

from __future__ import annotations

import math
import statistics
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ploidyforge.functions.exact import exact_stats
from ploidyforge.functions.stats import ks_statistic
from ploidyforge.operators import segments, selection, trees, windows


# --- medians

@pytest.mark.parametrize("small,ranges", [(3, 2), (10, 7), (10_000, 256)])
def test_medians_of_groups_of_all_sizes(spark, small, ranges):
    rnd = np.random.default_rng(1)
    groups = {"even": rnd.normal(0, 1, 500), "odd": rnd.normal(0, 1, 333), "skewed": np.exp(rnd.normal(0, 12, 400)), "same": np.full(200, 0.1), "two": np.repeat([1.0, 2.0], 150), "ties": rnd.integers(0, 4, 301).astype(float), "one": np.array([-7.5]),
              "far": np.array([-1.7e308] * 40 + [1.7e308] * 41), "tiny": np.array([5e-324, 1e-310, 0.0, -5e-324] * 20), None: rnd.normal(5, 1, 50)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("even", None), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r["median"] for r in selection.medians(df, ["g"], small=small, ranges=ranges).collect()}
    assert got == {k: statistics.median(x.tolist()) if k != "far" else 1.7e308 for k, x in groups.items()}


def test_medians_of_no_rows(spark):
    assert selection.medians(spark.createDataFrame([], "g string, x double"), ["g"]).count() == 0


def test_bin_medians_of_large_groups(spark, monkeypatch):
    rows = [("b", c, g, float((g * 37 + c) % 101)) for c in range(3) for g in range(60)]
    long = spark.createDataFrame(rows, "batch string, cell_idx int, gene_idx int, x double")
    members = spark.createDataFrame([(g // 20, g) for g in range(60)] + [(7, g) for g in range(60)], "bin_idx int, gene_idx int")
    want = sorted(tuple(r) for r in segments.bin_medians(long, members).collect())
    monkeypatch.setattr(selection, "SMALL", 5)
    monkeypatch.setattr(selection.medians, "__defaults__", ("x", 5, 4, None))
    assert sorted(tuple(r) for r in segments.bin_medians(long, members).collect()) == want


def test_genes_meet_only_bins_near_them(spark):
    rnd = np.random.default_rng(9)
    tops = {c: np.cumsum(np.concatenate([rnd.integers(1, 40, 60), [3000], rnd.integers(0, 3, 40)])).tolist() for c in (1, 2, 23)}
    bins = [(k, c, top) for k, (c, top) in enumerate((c, top) for c, own in tops.items() for top in own)]
    genes = [(k, (1, 2, 23, 25)[k % 4], int(a), int(a + w)) for k, (a, w) in enumerate(zip(rnd.integers(0, 4500, 800), rnd.integers(0, 30, 800)))] + [(900, 1, bins[3][2], bins[3][2]), (901, 1, 0, 0), (902, 1, None, 4), (903, None, 1, 4)]
    edges = segments.bin_edges(spark.createDataFrame(bins, "bin_idx int, chrom int, chrompos int"))
    found = segments.genes_in_bins(spark.createDataFrame(genes, "gene_idx int, chrom int, start int, end int"), edges)
    want = {(b["bin_idx"], g) for b in edges.collect() for g, c, start, end in genes if start is not None and c == b["chrom"] and b["low"] <= (start + end) / 2 <= b["high"]}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 400
    # the rows that the range is tested on are those of one stretch
    assert "_own" in next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "_stretch" in line)


def test_nearest_bins_without_a_frame_to_the_end(spark):
    edges = spark.createDataFrame([(k,) for k in range(40)], "bin_idx int")
    members = spark.createDataFrame([(k, 1) for k in (3, 4, 11, 30)], "bin_idx int, gene_idx int")
    filled = segments.nearest_filled(edges, members)
    assert {r["bin_idx"]: r["source"] for r in filled.collect()} == {k: min((3, 4, 11, 30), key=lambda h: (abs(h - k), h)) for k in range(40)}
    assert "unboundedfollowing" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["source"] for r in segments.nearest_filled(edges, members.where("bin_idx < 0")).collect()} == {None}


# --- exact sums

def plain_stats(x):
    total, squares, n = sum(map(Fraction, x)), sum(Fraction(v) ** 2 for v in x), len(x)
    var = (n * squares - total * total) / (n * (n - 1)) if n > 1 else None
    return n, float(total), float(total / n), None if var is None else math.sqrt(var) if var < Fraction(10) ** 300 else None


def test_exact_stats_for_any_partitioning(spark):
    rnd = np.random.default_rng(2)
    groups = {"plain": rnd.normal(0, 1, 700), "cancel": np.concatenate([rnd.normal(0, 1e16, 200), [1e-8]]), "powers": 2.0 ** rnd.integers(-1000, 450, 200), "small": rnd.integers(-9, 9, 50) * 5e-324, "one": np.array([0.1]), "zero": np.array([0.0, -0.0, 0.0]), "edges": np.array([np.nextafter(2.0 ** k, s) for k in range(-30, 30) for s in (-np.inf, np.inf)])}
    groups["cancel"] = np.concatenate([groups["cancel"], -groups["cancel"][:-1]])
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("plain", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    seen = []
    for parts in (df.coalesce(1), df.repartition(7), df.orderBy(F.rand(3)).repartition(3)):
        seen.append({r["g"]: (r["n"], r["total"], r["mean"], r["sd"]) for r in exact_stats(parts, ["g"]).collect()})
    assert seen[0] == seen[1] == seen[2]
    for k, x in groups.items():
        n, total, mean, sd = plain_stats(x.tolist())
        assert seen[0][k][:3] == (n, total, mean)
        assert k == "small" or sd is None and seen[0][k][3] is None or math.isclose(seen[0][k][3], sd, rel_tol=1e-15)
    assert seen[0]["cancel"][1] == 1e-8 and seen[0]["zero"] == (3, 0.0, 0.0, 0.0)


def test_sums_only(spark):
    df = spark.createDataFrame([(1, 0.1)] * 10, "g int, x double")
    (row,) = exact_stats(df, ["g"], deviations=False).collect()
    assert (row["n"], row["total"], row["mean"], row["sd"]) == (10, float(10 * Fraction(0.1)), 0.1, None)


# --- windows

def test_grid_is_that_of_the_plain_form(spark):
    sizes = [(f"n{n}", n) for n in (10, 49, 50, 74, 75, 76, 99, 100, 130, 1000)]
    got = {}
    for r in windows.grid(spark.createDataFrame(sizes, "batch string, n long")).orderBy("window").collect():
        got.setdefault(r["batch"], []).append((r["first"], r["middle"], r["last"]))
    assert got == {b: p for b, n in sizes if (p := segments.window_pairs(n))}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=30), st.randoms())
def test_gap_is_the_ks_statistic(values, rnd):
    x, y = np.array(values, float), np.array(rnd.choices(range(7), k=len(values)), float)
    assert abs(windows.largest_gap(x, y) / len(x) - ks_statistic(x, y)) < 1e-12


def sample(spark, parts):
    rnd = np.random.default_rng(4)
    n, rows = 300, []
    for batch in ("s1", "s2"):
        for cluster in (1, 2):
            v = rnd.gamma(4, 0.3, n)
            if cluster == 2:
                v[100:180] *= 3
            rows.append((batch, cluster, v.tolist()))
    return spark.createDataFrame(rows, "batch string, cluster int, v array<double>").repartition(parts), rows


def test_breaks_equal_a_plain_loop_for_any_partitioning(spark):
    sizes = spark.createDataFrame([("s1", 300), ("s2", 300)], "batch string, n long")
    seen = []
    for parts in (1, 5):
        profiles, rows = sample(spark, parts)
        sums = windows.window_sums(profiles, windows.grid(sizes))
        gaps = windows.window_gaps(sums.repartition(parts), 7, 200)
        seen.append(sorted(tuple(r) for r in gaps.collect()))
        for cut, least in ((0.5, 3), (0.99, 5), (0.99, 400)):
            found = {r["batch"]: r["breaks"] for r in windows.breaks(gaps, sizes, cut, 200, least).collect()}
            for batch in ("s1", "s2"):
                want = plain_breaks(spark, [r for r in rows if r[0] == batch], cut, least)
                assert found.get(batch) == want
    assert seen[0] == seen[1] and len(seen[0]) == 4 * len(segments.window_pairs(300))


def test_window_sums_hold_no_profile_beside_a_window(spark):
    sizes = spark.createDataFrame([("s1", 300), ("s2", 300)], "batch string, n long")
    profiles, rows = sample(spark, 3)
    sums = windows.window_sums(profiles, windows.grid(sizes))
    got = {(r["batch"], r["cluster"], r["middle"]): (r["left"], r["n_left"], r["right"], r["n_right"]) for r in sums.collect()}
    for b, c, v in rows:
        for first, middle, last in segments.window_pairs(300):
            assert got[b, c, middle] == (reduce(add, v[first - 1:middle], 0.0), middle - first + 1, reduce(add, v[middle:last], 0.0), last - middle)
    # a row of the join of profiles and windows has one place of a profile, not its array
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "place#" in join and "slice(" not in plan


def plain_breaks(spark, rows, cut, least):
    names = {(r["b"], r["c"], r["w"]): r["h"] for r in spark.createDataFrame([(b, c, w) for b, c, _ in rows for w in range(len(segments.window_pairs(300)))], "b string, c int, w int").withColumn("h", F.xxhash64("b", "c", "w")).collect()}
    for share in (1.0, 0.5, 0.25):
        found = {1, 300}
        for b, c, v in rows:
            for w, (first, middle, last) in enumerate(segments.window_pairs(300)):
                draw, draws = windows.keyed_generator(7, names[b, c, w]), []
                for part in (v[first - 1:middle], v[middle:last]):
                    total = 0.0
                    for x in part:
                        total += x
                    draws.append(draw.gamma(max(total / len(part), 0.001) + total, 1 / (1.0 + len(part)), 200))
                if ks_statistic(*draws) > share * cut + 1e-12:
                    found.add(middle)
        if len(found) >= least:
            return sorted(found)
    return None


def test_levels_of_segments(spark):
    rnd = np.random.default_rng(6)
    rows = [("s1", c, rnd.normal(0, 0.3, 40).tolist()) for c in range(9)]
    relative = spark.createDataFrame(rows, "batch string, cell_idx int, v array<double>")
    broken = spark.createDataFrame([("s1", [1, 11, 26, 40])], "batch string, breaks array<int>")
    got = {r["cell_idx"]: np.array(r["v"]) for r in windows.segment_levels(relative.repartition(4), broken, 3, 4000).collect()}
    exact = {r["cell_idx"]: np.array(r["v"]) for r in windows.segment_levels(relative, broken, 3, 10, expected=True).collect()}
    again = {r["cell_idx"]: np.array(r["v"]) for r in windows.segment_levels(relative.coalesce(1), broken, 3, 4000).collect()}
    for _, c, v in rows:
        x, out = np.exp(v), np.empty(40)
        for a, b in ((0, 11), (10, 26), (25, 40)):
            out[a:b] = np.log((max(x[a:b].mean(), 0.001) + x[a:b].sum()) / (1 + b - a))
        assert np.allclose(exact[c], out - out.mean()) and np.allclose(got[c], exact[c], atol=0.05)
        assert (got[c] == again[c]).all() and len(set(got[c].tolist())) == 3


# --- growing prefixes

def test_no_more_cells_are_fitted_than_the_prefix(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    flat, odd = (lambda: rnd.normal(0, 0.01, 40).tolist()), (lambda: rnd.normal(2, 0.01, 40).tolist())
    rows = [("early", k, flat() if k % 2 else odd()) for k in range(200)] + [("late", k, flat() if k >= 37 else odd()) for k in range(200)] + [("none", k, odd()) for k in range(30)]
    profiles = spark.createDataFrame(rows, "batch string, cell_idx int, v array<double>").repartition(4)
    fitted, real = [], trees.mixtures
    monkeypatch.setattr(trees, "mixtures", lambda p, n: fitted.append({r["batch"]: r["count"] for r in p.groupBy("batch").count().collect()}) or real(p, n))
    got = {}
    for r in trees.gmm_diploid(profiles, first=8).collect():
        got.setdefault(r["batch"], []).append(r["cell_idx"])
    assert {b: sorted(c) for b, c in got.items()} == {"early": [1, 3, 5, 7, 9], "late": [37, 38, 39, 40, 41]}
    assert sum(f.get("early", 0) for f in fitted) == 16 and sum(f.get("late", 0) for f in fitted) == 64 and sum(f.get("none", 0) for f in fitted) == 30
    assert trees.gmm_diploid(profiles.where("batch = 'x'")).count() == 0


# --- smoothing

def test_smoothing_holds_a_slice_of_dense_profiles(spark, monkeypatch):
    from ploidyforge.operators import profiles

    counts = spark.createDataFrame([("s", c, p, float(1 + (c * p) % 5)) for c in range(40) for p in (c, 50 + c, 99)], "batch string, cell_idx int, pos int, umi double").coalesce(1)
    want = {r["cell_idx"]: (r["v"], r["seen"]) for r in profiles.smooth_profiles(counts, 100).collect()}
    real = profiles.kalman_smooth

    def smooth(x, *rest):
        assert x.nbytes <= 4000, "too many dense rows"
        return real(x, *rest)

    monkeypatch.setattr(profiles, "SLICE_BYTES", 4000)  # 40 sparse rows are less, 40 dense ones more
    monkeypatch.setattr(profiles, "kalman_smooth", smooth)
    assert {r["cell_idx"]: (r["v"], r["seen"]) for r in profiles.smooth_profiles(counts, 100).collect()} == want and len(want) == 40
