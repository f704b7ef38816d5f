"""k-means rounds in whole numbers over Hilbert-ordered blocks of vectors, pruned by the blocks' boxes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, staged, table, tuned

#: Fixed values of the contract: components of a vector, their scale, centroids, rounds, seed of the start.
WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors of a block.
BLOCK = 64
#: Bits of a component in the Hilbert key, between the smallest and the largest component of all vectors.
BITS = 4
#: Components beyond this make squared distances too large for a long.
LARGEST = 1 << 26
#: Up to this size, products of components and their sums are exact in doubles.
EXACT = 1 << 22


def kept_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, v (whole numbers) of the vectors of exactly width components, none of them null or not finite."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.size(x) == width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.when(F.abs(e) * scale <= LARGEST, F.floor(e * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for squared distances of 64 bits"))))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def hilbert_keys(levels: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve as byte strings that sort in its order, of points (n, width) with bits a component.

    The transform from coordinates to the transposed index is the one of J. Skilling (2004), on all points at once."""
    x = levels.astype(np.uint32).T.copy()
    top = np.uint32(1 << (bits - 1))
    q = int(top)
    while q > 1:
        low = np.uint32(q - 1)
        for k in range(len(x)):
            high = (x[k] & np.uint32(q)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[k]) & low)
            x[0] ^= np.where(high, low, swap)
            if k:
                x[k] ^= swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    q = int(top)
    while q > 1:
        turn ^= np.where((x[-1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])  # bit, component, point
    return np.packbits(planes.reshape(bits * len(x), -1).astype(np.uint8), axis=0).T.copy()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def keyed(kept: DataFrame, low: int, high: int, width: int = WIDTH, bits: int = BITS) -> DataFrame:
    """kept with key, the vector's place on the Hilbert curve of the cube from low to high."""
    span, steps = max(high - low + 1, 1), 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = hilbert_keys((_matrix(batch.column(1), width).astype(np.int64) - low) * steps // span, bits)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], ["vec_id", "v", "key"])

    return map_arrow(kept, run, "vec_id long, v array<int>, key binary")


def blocks(ordered: DataFrame, size: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """ids, v (all components, vector by vector), low, high (the box) of each size vectors in a row of a partition."""
    def block(held: list[pa.RecordBatch]) -> list:
        v = np.concatenate([_matrix(b.column(1), width) for b in held])
        ids = [i for b in held for i in b.column(0).to_pylist()]
        return [ids, v.ravel(), v.min(0), v.max(0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            made, at = [], 0
            while at < batch.num_rows:
                piece = batch.slice(at, size - n)
                held, n, at = [*held, piece], n + piece.num_rows, at + piece.num_rows
                if n == size:
                    made.append(block(held))
                    held, n = [], 0
            if made:
                yield _rows(made)
        if held:
            yield _rows([block(held)])

    def _rows(made: list) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.int32()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], pa.list_(kind)) for k, kind in enumerate(kinds)], ["ids", "v", "low", "high"])

    return map_arrow(ordered.select("vec_id", "v"), run, "ids array<long>, v array<int>, low array<int>, high array<int>")


def zone_maps(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE, size: int = BLOCK) -> DataFrame:
    """The kept vectors as a staged table of blocks in Hilbert order. Vectors at one place of the curve are dealt by vec_id,
    so a vector that a great many rows share fills many partitions."""
    kept = kept_vectors(vectors, width, scale)
    low, high = kept.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    placed = staged(keyed(kept, low or 0, high or 0, width), "hilbert")
    tie = F.xxhash64("vec_id")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(blocks(placed.repartitionByRange(n, "key", tie).sortWithinPartitions("key", tie), size, width), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector in the box, ascending.

    The difference of two squared distances is linear over the box, so its bound is exact: a centroid goes if it is farther
    than the one nearest to the middle of the box at every corner. One as near stays, as ties go by number."""
    near = ((2 * centroids - (low + high)) ** 2).sum(1).argmin()
    step = 2 * (centroids - centroids[near])  # d(x, near) - d(x, c) = x . step + |near|^2 - |c|^2
    most = np.where(step > 0, step * high, step * low).sum(1) + (centroids[near] ** 2).sum() - (centroids ** 2).sum(1)
    return np.nonzero(most >= 0)[0]


def nearest(v: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on ties) and exact squared distance of each vector of a block."""
    few = candidates(low, high, centroids)
    c = centroids[few]
    if max(int(np.abs(low).max()), int(np.abs(high).max()), int(np.abs(c).max())) <= EXACT:
        dots = (v.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        dots = v @ c.T
    d = (v * v).sum(1)[:, None] - 2 * dots + (c * c).sum(1)
    at = d.argmin(1)
    return few[at], d[np.arange(len(v)), at]


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    for batch in batches:
        low, high = _matrix(batch.column(2), width).astype(np.int64), _matrix(batch.column(3), width).astype(np.int64)
        ids, v = batch.column(0), batch.column(1)
        for k in range(batch.num_rows):
            yield ids[k].values, v[k].values.to_numpy().reshape(-1, width).astype(np.int64), low[k], high[k]


def cluster_sums(zones: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int]]]:
    """(count, component sums) of each centroid's vectors: a row a centroid and task is summed by Spark."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for _, v, low, high in _each(batches, width):
            own = nearest(v, low, high, centroids)[0]
            for c in np.unique(own):
                mine = v[own == c]
                total[c, 0] += len(mine)
                total[c, 1:] += mine.sum(0)
        used = np.nonzero(total[:, 0])[0]
        if len(used):
            c, pos = np.repeat(used, width + 1), np.tile(np.arange(width + 1), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(total[used].ravel())], ["cluster", "pos", "x"])

    out = [[0] * (width + 1) for _ in range(k)]
    for r in map_arrow(zones, run, "cluster int, pos int, x long").groupBy("cluster", "pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[r["cluster"]][r["pos"]] = int(r["x"])
    return [(r[0], r[1:]) for r in out]


def start(vectors: DataFrame, clusters: int = CLUSTERS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The kept vectors with the smallest sha256 of 'seed:vec_id', as many as there are clusters at most."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = kept_vectors(vectors, width, scale).orderBy(digest, "vec_id", "v").limit(clusters).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(-1, width)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every kept vector; the final centroids).

    Components x count as floor(scale * x). Vectors of another width, or with a null or non-finite component, are left
    out, null vectors too. A centroid without vectors stays where it is. A null vec_id starts as the text 'null'; rows that
    share a vec_id are vectors of their own, of which those with the smaller components start first; with fewer vectors
    than clusters each starts one; an empty table gives no rows; other columns are not read. Components of which the
    scaled size is over LARGEST are an error. The driver holds the centroids and their sums only."""
    centroids = start(vectors, clusters, width, scale, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    zones = zone_maps(vectors, width, scale)
    for _ in range(rounds):
        sums = cluster_sums(zones, centroids)
        centroids = np.array([[x // n for x in total] if n else old.tolist() for (n, total), old in zip(sums, centroids)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, low, high in _each(batches, width):
            own, d = nearest(v, low, high, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return map_arrow(zones, run, "vec_id long, cluster int, distance long"), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    made, centroids = clustered(table(spark, sf_dir, "embeddings"))
    rows = staged(made, "clusters")
    by_cluster = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a centroid
    facts = [(k, by_cluster.get(k, 0), sum(by_cluster.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(k: int) -> str:
    """Assignment a{k} to the centroids c{k} and, but for the last, new centroids c{k + 1}."""
    made = f"""a{k} as (select rid, arg_min(c, (d, c)) as c, min(d) as d from (select v.rid, q.c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - q.v[i]) * (v.v[i] - q.v[i])))::bigint as d from v, c{k} q) group by rid)"""
    if k < ROUNDS:
        made += f""",
s{k} as (select a.c, i, count(*) as n, sum(v.v[i])::bigint as s from a{k} a join v using (rid), (select unnest(range(1, 65)) as i) group by 1, 2),
c{k + 1} as (select q.c, coalesce(t.v, q.v) as v from c{k} q left join (select c, list((s - ((s % n) + n) % n) // n order by i) as v from s{k} group by c) t on t.c = q.c)"""
    return made


OP11_SQL = f"""
with e as (select row_number() over () as rid, vec_id, embedding from embeddings where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select rid, vec_id, list_transform(embedding, lambda x: floor(x::double * {SCALE})::bigint) as v from e),
c0 as (select row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as c, v from v order by sha256('{SEED}:' || vec_id) limit {CLUSTERS}),
{','.join(_round_sql(k) for k in range(ROUNDS + 1))}
select vec_id, c::int as cluster, d as distance, sum(d) over (partition by c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, sha256(array_to_string(q.v, ',')) as centroid_sha256
from a{ROUNDS} join v using (rid) join c{ROUNDS} q using (c)
"""
