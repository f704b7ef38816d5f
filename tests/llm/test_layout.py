"""Centroid clustering, fill-in-middle and sharding against plain forms."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ploidyforge.llm import centroids, fill_in_middle, sharding
from ploidyforge.llm.common import fresh_path

from .samples import ODD, documents, empty, texts


# --- centroid clustering

def plain_clusters(rows, k=centroids.CLUSTERS, rounds=centroids.ROUNDS, width=centroids.WIDTH):
    """(sorted (vec_id, cluster, distance), final centroids) with whole numbers of any size."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))[:k]
    c = [v for _, v in first]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, q)), n) for n, q in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        own = [n for _, n in assigned()]
        for n in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                c[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, assigned())), key=repr), c


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"key": F.lit("clash"), "v": F.lit(1), "cluster": F.lit("x")}).repartition(3)


def some_vectors(n=160, seed=3, size=0.4):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(0, size, (6, 64))
    out = [(k, (middles[k % 6] + rnd.normal(0, 0.02 if k % 2 else 0.3, 64)).astype(np.float32).tolist()) for k in range(n)]
    out += [(k + 1000, out[5][1]) for k in range(70)]  # one vector of many rows
    out += [(7, out[9][1]), out[11], out[11], (None, out[12][1]), (None, [0.0] * 64), (2000, [-0.0] * 64), (2001, [1 / 64] * 64)]
    out += [(3000, None), (3001, []), (3002, [0.1] * 63), (3003, [0.1] * 65), (3004, [0.1] * 63 + [None]), (3005, [0.1] * 63 + [float("nan")]), (3006, [float("inf")] + [0.1] * 63), (3007, [float("-inf")] + [0.1] * 63)]
    return out


@pytest.mark.parametrize("factor", [1.0, 3e4])
def test_clusters_equal_brute_force(spark, factor):
    rows = [(i, v and [x if x is None else float(np.float32(x * factor)) for x in v]) for i, v in some_vectors()]
    got, c = centroids.clustered(vectors(spark, rows))
    want, final = plain_clusters(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert c.tolist() == final
    if factor > 1:
        assert max(abs(x) for q in final for x in q) > centroids.EXACT / 4


def test_few_vectors_and_none(spark):
    rows = some_vectors()[:5]
    got, c = centroids.clustered(vectors(spark, rows))
    assert len(c) == 5 and sorted(tuple(r) for r in got.collect()) == plain_clusters(rows)[0]
    got, c = centroids.clustered(vectors(spark, rows).where("vec_id < 0"))
    assert not len(c) and got.count() == 0 and got.columns == ["vec_id", "cluster", "distance"]
    assert centroids.clustered(vectors(spark, [(1, [0.5] * 3), (2, None)]))[0].count() == 0


def test_components_too_large_are_an_error(spark):
    with pytest.raises(PySparkException, match="too large"):
        centroids.clustered(vectors(spark, [(1, [1e30] + [0.0] * 63), (2, [0.0] * 64)]))


def test_no_nearest_centroid_is_left_out():
    rnd = np.random.default_rng(1)
    fewer = 0
    for _ in range(200):
        c = rnd.integers(-6, 6, (16, 4))
        v = rnd.integers(-3, 3, (20, 4)) + rnd.integers(-6, 6, 4)
        few = centroids.candidates(v.min(0), v.max(0), c)
        fewer += len(few) < 16
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        at, dist = centroids.nearest(v, v.min(0), v.max(0), c)
        assert at.tolist() == d.argmin(1).tolist() and dist.tolist() == d.min(1).tolist()
        assert set(at.tolist()) <= set(few.tolist())
    assert fewer > 150


@pytest.mark.parametrize("width,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(width, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width, indexing="ij"), -1).reshape(-1, width)
    keys = [k.tobytes() for k in centroids.hilbert_keys(points, bits)]
    assert len(set(keys)) == len(points)
    walk = points[sorted(range(len(points)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_blocks_hold_every_vector_once_with_its_box(spark):
    rows = some_vectors()
    zones = centroids.zone_maps(vectors(spark, rows), size=16).collect()
    ids = sorted((i for z in zones for i in z["ids"]), key=repr)
    assert ids == sorted((r[0] for r in plain_clusters(rows)[0]), key=repr)
    for z in zones:
        v = np.array(z["v"]).reshape(-1, 64)
        assert len(v) == len(z["ids"]) <= 16 and v.min(0).tolist() == z["low"] and v.max(0).tolist() == z["high"]


def test_query_11_equals_its_sql(spark):
    path = fresh_path(spark, "tables")
    rows = [r for r in some_vectors() if r[0] is not None]
    seen = set()
    rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]  # the start of repeated ids is not said in the SQL
    vectors(spark, rows).select("vec_id", "embedding").write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path.removeprefix('file://')}/embeddings.parquet/*.parquet'")
    got = centroids.op11_centroid_clustering(spark, path)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(con.execute(f"select {', '.join(columns)} from ({centroids.OP11_SQL})").fetchall())


# --- fill-in-middle

def plain_fim(doc_id, text, fim=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(lines), hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


MARKED = ["a <P> b\nc", "<S>", "x\n<M>", "<P\n>S><S\nM>", "P>\n<<\nS\n>", "\n", "\n\n\n", "no end", "end\n", "\r\n\r\n", "a\x00b\nc"]


def fim_rows():
    every = texts(30) + ODD + MARKED + ["zeile 😀\n" * 200_000, "x" * 3_000_000]
    rows = [(k, t) for k, t in enumerate(every)] + [(-5, "a\nb\nc\nd\n"), (None, "null id\nhas two lines"), (None, None), (3, every[3])]
    return rows


@pytest.mark.parametrize("fim,spm", [(100, 50), (60, 0), (0, 100)])
def test_fim_equals_plain_form_and_restores(spark, fim, spm):
    rows = fim_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "h1": F.lit(1), "output": F.lit("x")}).repartition(4)
    made = fill_in_middle.fill_in_middle(docs, fim, spm)
    assert sorted((tuple(r) for r in made.collect()), key=repr) == sorted((plain_fim(d, t, fim, spm) for d, t in rows), key=repr)
    back = fill_in_middle.restored(made).select("doc_id", "text", "form").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
    if (fim, spm) == (100, 50):
        assert {r["form"] for r in back} == {"plain", "psm", "spm"}


def test_units_of_a_batch():
    lines, parents, place, n = fill_in_middle.units(pa.array(["", "a", "a\n", "\n\nb", "x\ny"])[1:])
    assert lines.to_pylist() == ["a", "a\n", "\n", "\n", "b", "x\n", "y"]
    assert (parents.to_pylist(), place.to_pylist(), n.to_pylist()) == ([0, 1, 2, 2, 2, 3, 3], [0, 0, 0, 1, 2, 0, 1], [1, 1, 3, 2])


def test_fim_of_an_empty_table(spark):
    assert fill_in_middle.restored(fill_in_middle.fill_in_middle(empty(spark))).count() == 0


def test_query_12_equals_its_sql(spark):
    path = fresh_path(spark, "tables")
    spark.createDataFrame([r for r in fim_rows() if "\x00" not in (r[1] or "")], "doc_id long, text string").repartition(2).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path.removeprefix('file://')}/documents.parquet/*.parquet'")
    got = fill_in_middle.op12_fill_in_middle(spark, path)
    answer = con.execute(f"select {', '.join(got.columns)} from ({fill_in_middle.OP12_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(answer, key=repr)


# --- sharding

def shard_rows():
    rnd = random.Random(8)
    rows = [(k, "a" * int(rnd.paretovariate(1.3) * 30)) for k in range(3000)]
    rows += [(5000 + k, "one text of many documents") for k in range(1500)]
    return rows + [(None, f"no id {k}") for k in range(40)] + [(None, None), (9000, None), (9001, ""), (9002, "é😀"), (9003, "long " * 20_000)] + [(9004, "again")] * 30


def facts(rows):
    return collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)


def test_shards_are_whole_gapless_and_near_equal(spark):
    rows = shard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("clash"), "size": F.lit("x"), "n": F.lit(0), "virtual": F.lit(None)}).repartition(5)
    path = fresh_path(spark, "maps")
    got = sharding.sharded(docs, path).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == facts(rows)
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    assert sorted(by_shard) == list(range(16))
    assert all(sorted(r["slot"] for r in held) == list(range(len(held))) for held in by_shard.values())
    loads, largest = [sum(r["size"] for r in held) for held in by_shard.values()], max(r["size"] for r in got)
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 16 or max(loads) <= sum(loads) / 16 + largest
    # rows of a virtual slot stay together, and the same rows are dealt alike from other partitions
    assert all(len({r["shard"] for r in got if r["virtual"] == v}) == 1 for v in {r["virtual"] for r in got[:50]})
    again = sharding.sharded(docs.repartition(2), fresh_path(spark, "maps")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_versions_and_growth(spark):
    docs = spark.createDataFrame(shard_rows(), "doc_id long, text string")
    maps = sharding.SlotMaps(spark, fresh_path(spark, "maps"))
    loads = sharding.slot_loads(sharding.records(docs))
    one = maps.publish(sharding.first_map(spark), 1)
    two = maps.publish(sharding.rebalanced(one, loads), 2)
    three = maps.publish(sharding.grown(two, loads), 3)
    with pytest.raises(PySparkException):
        maps.publish(one, 2)
    spark.range(3).selectExpr("cast(id as int) as virtual", "0 as shard").write.parquet(f"{maps.path}/version=4")  # cut off
    assert maps.versions() == [1, 2, 3]
    m1, m2, m3 = ({r["virtual"]: r["shard"] for r in m.collect()} for m in (one, two, maps.latest()))
    assert len(m1) == len(m2) == len(m3) == sharding.SLOTS
    assert all(m3[v] in (m2[v], 16) for v in m2) and set(m3.values()) == set(range(17))
    size = {r["virtual"]: r["bytes"] for r in loads.collect()}

    def by_shard(m):
        out = collections.Counter()
        for v, s in m.items():
            out[s] += size[v]
        return out

    total, largest = sum(size.values()), max(size.values())
    assert max(by_shard(m2).values()) < max(by_shard(m1).values())
    # an edit moves what is too much, not all
    assert sum(size[v] for v in m1 if m1[v] != m2[v]) <= sum(max(0, b - total // 16) for b in by_shard(m1).values()) + 16 * largest
    assert by_shard(m3)[16] <= total / 17 + 16 * largest
    # a balanced map is left as it is, but for slots of no bytes
    again = {r["virtual"]: r["shard"] for r in sharding.rebalanced(two, loads).collect()}
    assert sum(size[v] for v in m2 if m2[v] != again[v]) <= 16 * largest
    assert three.count() == sharding.SLOTS


def test_written_shards_have_every_row(spark):
    rows = shard_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1))
    path = fresh_path(spark, "shards")
    mapped = sharding.first_map(spark, 4)
    sharding.write_shards(docs, mapped, path, files=2)
    back = spark.read.parquet(path)
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter(rows)
    of = {r["doc_id"]: r["shard"] for r in sharding.places(sharding.records(docs), sharding.slot_loads(sharding.records(docs)), mapped).collect()}
    assert all(of[r["doc_id"]] == r["shard"] for r in back.where("doc_id is not null").select("doc_id", "shard").collect())


def test_many_equal_rows_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 7)
    docs = spark.range(100).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.sharded(docs, fresh_path(spark, "maps")).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(100))


def test_no_rows_no_shards(spark):
    path = fresh_path(spark, "maps")
    assert sharding.sharded(empty(spark), path).count() == 0
    assert sharding.SlotMaps(spark, path).latest().count() == sharding.SLOTS


def test_sharding_runs_no_python(spark):
    plans = []
    docs = documents(spark)
    rows = sharding.records(docs)
    loads = sharding.slot_loads(rows)
    for df in (rows, loads, sharding.rebalanced(sharding.first_map(spark), loads), sharding.grown(sharding.first_map(spark), loads), sharding.places(rows, loads, sharding.first_map(spark))):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert not any(re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", p) for p in plans)


def test_query_13_columns(spark):
    path = fresh_path(spark, "tables")
    spark.createDataFrame(shard_rows(), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = sharding.op13_sharding(spark, path)
    assert dict(got.dtypes) | {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"} == dict(got.dtypes)
    assert got.where("law = 'bytes' and grown_shard is null").count() == len(shard_rows())
