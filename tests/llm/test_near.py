"""SimHash and decontamination against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from ploidyforge.llm import decontamination, line_dedup, simhash

from .samples import documents, empty, texts


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    top = list(range(len(fps)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [root(i) for i in range(len(fps))]


def test_golay_code_is_perfect():
    table = simhash.nearby()
    assert (table[:, 0] >= 0).all() and (np.bitwise_count(table[:, 0].astype(np.uint64)) <= 3).all()
    counts = (table >= 0).sum(1)
    assert sorted(set(counts.tolist())) == [1, 6] and (counts == 1).sum() == 1 + 23 + 253


def test_every_link_is_a_candidate():
    rnd = random.Random(2)
    for _ in range(400):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 3)):
            b ^= 1 << bit
        filed = set(simhash.filing_keys(np.array([a], np.uint64))[0].tolist())
        searched = set(simhash.search_keys(np.array([b], np.uint64))[0].tolist())
        assert filed & searched


def test_spanning_links_join_what_all_links_join():
    rnd = random.Random(4)
    fps = []
    for _ in range(6):
        base = rnd.getrandbits(64)
        fps += [base ^ sum(1 << b for b in rnd.sample(range(10), rnd.randint(0, 4))) for _ in range(20)]
    fps = sorted(set(fps))
    links = simhash.spanning_links(np.array(fps, np.uint64))
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    assert len(fps) - len(links) == len(set(plain_components(fps)))


@pytest.mark.parametrize("crowded", [0, 16])
def test_near_duplicates(spark, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "TILE", 8)
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    low = {}
    for (d, _), r in zip(rows, roots):
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    expected = sorted(((d, f, low[r]) for (d, _), f, r in zip(rows, fps, roots)), key=repr)
    got = simhash.near_duplicates(docs)
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got.collect()), key=repr) == expected
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))


def test_awkward_columns_and_ties(spark):
    docs = documents(spark, extra=False).withColumnsRenamed({"lang": "meta.url", "n_chars": "__k1"})
    twice = docs.where("doc_id = 9").withColumn("meta.url", F.lit("another"))
    both = docs.union(twice)
    kept = simhash.one_of_each(both)
    assert kept.columns == both.columns and kept.where("doc_id = 9").count() == 1
    assert kept.where("doc_id = 9").collect() == simhash.one_of_each(twice.union(docs)).where("doc_id = 9").collect()
    bench = spark.createDataFrame([(1, texts(1)[0])], "item_id long, text string")
    clean = decontamination.decontaminated(both, bench)
    assert clean.columns == both.columns and both.count() > clean.count() > 0
    assert sorted(map(repr, clean.where("doc_id = 21").collect())) == sorted(map(repr, both.where("doc_id = 21").collect()))
    plain = line_dedup.drop_boilerplate(both)
    assert set(plain.columns) == {*both.columns, "n_removed"} and plain.count() == both.count()


def test_a_long_text_with_an_item_in_it(spark):
    item = " ".join(f"bench{k}" for k in range(40))
    long = " ".join(f"w{k % 9973}" for k in range(700_000))
    assert len(long) > 4_000_000
    docs = documents(spark, rows=[(1, f"{long} {item} {long[:1000]}", "en", "s", 1), (2, long, "en", "s", 1), (3, "x" * 5_000_000, "en", "s", 1)])
    got = decontamination.contained_items(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["n_shared"]) for r in got] == [(1, 7, 36)]
    assert simhash.near_duplicates(docs).count() == 3


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


def plain_matches(docs, items):
    out = []
    for d, text in docs:
        words = decontamination.words_of(text or "")
        for i, item in items:
            want = decontamination.words_of(item or "")
            if not want:
                continue
            n = min(5, len(want))
            q = {tuple(want[k:k + n]) for k in range(len(want) - n + 1)}
            have = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)}
            if 10 * len(q & have) >= 8 * len(q):
                out.append((d, i, len(q), len(q & have)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [8, 26])
def test_contained_items(spark, bits, monkeypatch):
    monkeypatch.setattr(decontamination, "FILTER_BITS", bits)  # a filter that lets nearly all pass changes nothing
    rnd = random.Random(8)
    items = [(k, " ".join(f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(1, 40)))) for k in range(25)] + [(30, ""), (31, None), (32, "one two"), (3, "again an id")]
    docs = []
    for k in range(60):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 300))]
        if k % 3 == 0:
            part = (items[k % 25][1]).upper().split()
            if k % 2 and len(part) > 10:
                part[rnd.randint(0, len(part) - 1)] = "changed"
            words[len(words) // 2:len(words) // 2] = part
        docs.append((k, ", ".join(words), "en", "s", 1))
    docs += [(100, None, None, None, None), (None, items[5][1], None, None, None), (101, "One two", "", "", 0), docs[3]]
    df = documents(spark, rows=docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contained_items(df, bench)
    expected = plain_matches([(d[0], d[1]) for d in docs], items)
    assert len(expected) > 10
    assert sorted((tuple(r) for r in got.select("doc_id", "item_id", "n_shingles", "n_shared").collect()), key=repr) == expected
    clean = decontamination.decontaminated(df, bench)
    dirty = {(d[0], d[1]) for d in docs if plain_matches([(d[0], d[1])], items)}
    assert clean.columns == df.columns and clean.count() == sum((d[0], d[1]) not in dirty for d in docs)


def test_contained_items_of_nothing(spark):
    bench = spark.createDataFrame([(1, texts(1)[0])], "item_id long, text string")
    assert decontamination.contained_items(empty(spark), bench).count() == 0
    assert decontamination.contained_items(documents(spark), bench.where("item_id < 0")).count() == 0


def test_rounds_and_blocks_of_items(spark, monkeypatch):
    """Many small filters and blocks of items find what one filter and one block do, each match once."""
    items = [(k, " ".join(f"w{k}x{j}" for j in range(3 + 3 * k))) for k in range(12)]
    docs = [(1, " ".join(t for _, t in items), "en", "s", 1), (2, items[4][1] + " " + items[9][1], "en", "s", 1), (3, "nothing of it", "en", "s", 1)]
    df = documents(spark, rows=docs + docs[1:2])
    monkeypatch.setattr(decontamination, "ROUND_VALUES", 20)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    got = decontamination.contained_items(df, spark.createDataFrame(items, "item_id long, text string"))
    want = plain_matches([(d[0], d[1]) for d in docs + docs[1:2]], items)
    assert sorted(tuple(r) for r in got.select("doc_id", "item_id", "n_shingles", "n_shared").collect()) == sorted(want) and len(want) == 16


def test_the_filter_has_all_values_and_hardly_any_other(spark):
    rnd = np.random.default_rng(2)
    values = rnd.integers(0, 1 << 64, 20_000, np.uint64)
    found = spark.createDataFrame([(v,) for v in values.view(np.int64).tolist()], "value long")
    size = decontamination.filter_size(len(values))
    assert size == 22 and decontamination.filter_size(10**9) == 26 and decontamination.filter_size(0) == 6
    bits = decontamination.filter_bits(found, size)
    assert set(decontamination.passing(bits, values)) == set(values)
    assert len(decontamination.passing(bits, rnd.integers(0, 1 << 64, 3_000_000, np.uint64))) < 5


def colliding_lines():
    """Two lines of 64 characters with one XXH64 at seed 42: in a lane, a second word makes up for a change of the first."""
    mask, p1, p2 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F
    turned = lambda x: (x << 31 | x >> 33) & mask
    lane = (42 + p1 + p2) & mask
    rnd = random.Random(1)
    letters = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,;:!?-+*/=()[]{}<>%$#@&_~^'\""
    back = pow(p2, -1, 1 << 64)
    while True:
        a, c, b = (int.from_bytes(bytes(rnd.choice(letters) for _ in range(8)), "little") for _ in range(3))
        after_a, after_c = (turned((lane + x * p2) & mask) * p1 & mask for x in (a, c))
        d = (b + (after_a - after_c) * back) & mask
        if all(x in letters for x in d.to_bytes(8, "little")):
            break
    rest = b"x" * 24
    return tuple((x.to_bytes(8, "little") + rest + y.to_bytes(8, "little") + rest).decode() for x, y in ((a, b), (c, d)))


def test_lines_that_collide_in_one_hash_differ_in_the_other(spark):
    one, two = colliding_lines()
    assert one != two and xxhash.xxh64_intdigest(one.encode(), 42) == xxhash.xxh64_intdigest(two.encode(), 42)
    rows = spark.createDataFrame([(one,), (two,)], "line string").select(line_dedup._name(F.col("line")).alias("n")).select("n.*").collect()
    assert rows[0]["h"] == rows[1]["h"] and rows[0]["g"] != rows[1]["g"]
    # neither line alone is on enough sites; together they would be
    docs = spark.createDataFrame([(k, f"start {k}\n{one if k % 2 else two}", f"s{k}") for k in range(8)], "doc_id long, text string, source string")
    assert line_dedup.boilerplate(docs).count() == 0


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(9)
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(5000, 5000), (7, 6)]
    edges += [(rnd.randrange(2000, 2060), rnd.randrange(2000, 2060)) for _ in range(40)]
    top = {n: n for e in edges for n in e}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in top if root(n) != n}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
