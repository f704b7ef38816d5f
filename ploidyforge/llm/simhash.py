"""SimHash near-duplicates by Golay-code fuzzy hashing.

The binary Golay code of length 23 is perfect: each 23-bit word is within 3 bits of exactly one codeword.
A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded with zeros). Of two
fingerprints that differ in 3 bits or fewer, at least two segments differ in 1 bit or fewer each; and if u
and v differ in one bit at most, the codeword nearest to u is within 4 bits of v. So each fingerprint is
filed under the pairs of its nearest codewords (3 keys) and looks under all pairs of codewords within 4
bits (1 or 6 a segment). Every link is found, and the full distance is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, lowered, map_arrow, quoted, staged, table, texts_of, tuned

#: Fixed value: generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEED, SHINGLE, DISTANCE = 42, 3, 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Keys with so many fingerprints more than CROWDED_TIMES the mean of random ones are searched by contraction, not joined.
CROWDED, CROWDED_TIMES = 16, 8
TILE = 4096


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator: 11 bits, 0 for codewords."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(1)
def nearby() -> np.ndarray:
    """Error patterns of weight 4 or less by syndrome: (2048, 6), the lightest first, -1 where there are fewer."""
    out, used = np.full((2048, 6), -1, np.int64), np.zeros(2048, int)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for error, s in zip(errors, syndromes(errors)):
            out[s, used[s]] = error
            used[s] += 1
    return out


def codewords(fps: np.ndarray, segment: int) -> np.ndarray:
    """Numbers (12 bits) of the codewords within 4 bits of a segment: (n, 6), the nearest first, -1 for none."""
    start, width = SEGMENTS[segment]
    words = (fps >> np.uint64(start) & np.uint64((1 << width) - 1)).astype(np.int64)
    errors = nearby()[syndromes(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def filing_keys(fps: np.ndarray) -> np.ndarray:
    """The 3 keys that each fingerprint is filed under: (n, 3)."""
    nearest = [codewords(fps, s)[:, 0] for s in range(3)]
    return np.stack([k << 24 | nearest[i] << 12 | nearest[j] for k, (i, j) in enumerate(PAIRS)], 1)


def search_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys that each fingerprint looks under, and its row number for each key."""
    near, keys, rows = [codewords(fps, s) for s in range(3)], [], []
    for k, (i, j) in enumerate(PAIRS):
        made = np.where((near[i][:, :, None] < 0) | (near[j][:, None, :] < 0), -1, k << 24 | near[i][:, :, None] << 12 | near[j][:, None, :]).reshape(len(fps), -1)
        row, col = np.nonzero(made >= 0)
        keys.append(made[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def fingerprint(text: str) -> int:
    """Majority of the bits of the XXH64 values of all 3-word shingles, repeats included; 0 without words."""
    words = lowered(text).split()
    if not words:
        return 0
    joined, size = b" ".join(words), SHINGLE
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-size])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:])], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def spanning_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same components as all links within DISTANCE among distinct fingerprints.

    Each fingerprint is compared with those that none has reached yet, so a tight group of any make costs
    about one comparison a member, and no list of pairs arises.
    """
    rest, links = fps, []
    while rest.size:
        reached, rest = [rest[0]], rest[1:]
        while reached and rest.size:
            one = reached.pop()
            hit = np.bitwise_count(rest ^ one) <= DISTANCE
            if hit.any():
                new = rest[hit]
                links += [(int(one), int(x)) for x in new]
                reached += list(new)
                rest = rest[~hit]
    return links


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(filing_keys(fps).reshape(-1)), pa.array(_signed(np.repeat(fps, 3)))], ["key", "fp"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, rows = search_keys(fps)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(_signed(fps[rows]))], ["key", "fp"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each run of rows with one group; rows come sorted by group."""
    group, held = None, []

    def out(parts):
        links = np.array(spanning_links(np.unique(np.concatenate(parts))), np.uint64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(_signed(links[:, 0].copy())), pa.array(_signed(links[:, 1].copy()))], ["a", "b"])

    for batch in batches:
        names, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = [0, *(np.nonzero(names[1:] != names[:-1])[0] + 1), len(names)]
        for at, to in zip(cuts, cuts[1:]):
            if at == to:
                continue
            if held and names[at] != group:
                yield out(held)
                held = []
            group = names[at]
            held.append(fps[at:to])
    if held:
        yield out(held)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of distinct fingerprints (fp, a staged table) at DISTANCE bits or fewer.

    Keys with few filed fingerprints are joined; crowded keys, which stand out from what so many random fingerprints
    would give and which only tight groups make, are contracted in tiles of bounded size, every two tiles of a key
    together. Links are the same whichever way a key is searched. No fingerprint gives no link.
    """
    most = CROWDED + CROWDED_TIMES * fps.count() // (1 << 24)
    filed = map_arrow(fps.select("fp"), _filed, "key long, fp long")
    searched = map_arrow(fps.select("fp"), _searched, "key long, fp long")
    crowded = staged(filed.groupBy("key").count().where(F.col("count") > most).select("key"), "crowded")
    rare = filed.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("a"))
    found = (searched.select("key", F.col("fp").alias("b")).join(rare.hint("merge"), "key")
             .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b"))
    members = staged(searched.join(crowded, "key", "left_semi"), "members")
    tiles = members.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    tiled = (members.join(tiles, "key").withColumn("mine", mine)
             .select("fp", "key", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
             .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), "fp"))
    dealt = tiled.repartition("tile").sortWithinPartitions("tile")
    return found.union(map_arrow(dealt, _contracted, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of each node of edges (a, b), by large-star and small-star
    rounds (Kiveris et al., 2014), until the edges are stars. Each half round is written to the shared folder. Loops and
    repeated edges count for nothing; no edges give no rows."""
    def ordered(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def stars(df):
        """Whether every node that has a smaller neighbour has just one, which has none itself: then these are the roots."""
        two, chained = df.groupBy("a").count().where("count > 1"), df.join(df.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        return two.isEmpty() and chained.isEmpty()

    edges = staged(ordered(edges), "edges")
    while not stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = staged(ordered(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = staged(ordered(small), "small")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp (64 bits as a signed long) of every row of docs (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return map_arrow(narrow, run, "doc_id long, text_hash long, fp long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root, component_id for every row of docs.

    component_id is the smallest doc_id among all documents reachable over links, root the smallest
    fingerprint. Null text counts as empty; texts without words have fingerprint zero and are linked like
    any other; rows with a null doc_id take part but lend no component_id (null if there is no other);
    repeated rows are kept, each with the same component; an empty table gives no rows; other columns are ignored.
    Copies share a fingerprint and are searched once.
    """
    rows = staged(fingerprints(docs), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct)).select(F.col("node").alias("fp"), "root")
    rooted = staged(distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = staged(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = staged(rooted.join(lowest, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row of smallest (doc_id, hash of the text)
    stays, with all its columns. Rows without doc_id come after the others; of rows with equal id and text the first
    by hash (128 bits) of the whole row stays. An empty table gives no rows."""
    found = near_duplicates(docs)
    # a struct puts nulls first: the flag puts rows without doc_id last
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash")).alias("k"))
    k1, k2, row, turn = free_names(docs.columns, "k1", "k2", "row", "turn")
    kept = staged(first.select(F.col("k.doc_id").alias(k1), F.col("k.text_hash").alias(k2)).distinct(), "kept")
    keyed = docs.withColumns({k1: F.col("doc_id").cast("long"), k2: F.xxhash64(F.col("text").cast("string"))}).alias("d")
    on = F.col(f"d.{k1}").eqNullSafe(F.col(f"k.{k1}")) & F.col(f"d.{k2}").eqNullSafe(F.col(f"k.{k2}"))
    chosen = keyed.join(kept.alias("k"), on, "left_semi")
    # equal ids and texts differ in other columns at most: of their rows the one of least hash stays
    whole = F.struct(*quoted(docs.columns))
    json = F.to_json(whole)
    ranked = chosen.select(k1, k2, whole.alias(row), F.struct(F.xxhash64(json), F.xxhash64(F.lit("second"), F.concat(F.lit("."), json))).alias(turn))
    least = ranked.groupBy(k1, k2).agg(F.min_by(row, turn).alias(row))
    return least.select(*[F.col(row).getField(c).alias(c) for c in docs.columns])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
