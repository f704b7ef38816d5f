"""Benchmark decontamination by size-partitioned containment search.

Test items are partitioned by their number of distinct shingles q. An item is contained in a document if
the document has at least need(q) of its shingles; then it has at least one of any q - need(q) + 1 of
them. Each partition keeps for its items a bottom-k MinHash sketch of just that length, so a document
without any sketch value can be no match, and no match is missed at any document length. Documents with
fewer shingles than an item's need can't hold it.

A pass over the documents finds those that may have a sketch value: a filter tells, whose size follows from the number of
values and which one document in thousands passes for nothing. A benchmark with more values than the largest filter takes
is gone through in rounds of items, each with a pass of its own. The values found are joined with the sketches, and the
candidates are verified on exact shingles, a document with a block of items at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Memo, held
from .common import free_names, map_arrow, quoted, staged, table, texts_of, tuned, utf8
from .token_store import mixed

SHINGLE, THRESHOLD = 5, 0.8
WORDS = r"[\p{L}\p{N}]+"
#: log2 of the bits of the largest filter of sketch values: 8 MB. PROBES bits stand for a value, of VALUE_BITS there are for it:
#: of values that are no sketch's, some 10 in a billion pass.
FILTER_BITS, VALUE_BITS, PROBES = 26, 128, 6
#: Sketch values in a round: as many as the largest filter takes.
ROUND_VALUES = 1 << 19
#: Bytes of item texts in a block: what a document is verified against at a time.
BLOCK_BYTES = 1 << 20
SALTS = 16
FOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str, pattern=regex.compile(WORDS)) -> list[str]:
    return pattern.findall(text.lower())


def word_hashes() -> Memo:
    return held(("words",), lambda: Memo(lambda word: xxhash.xxh64_intdigest(utf8(word))))


def folded(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word hashes."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(windows), np.uint64)
        for k in range(windows.shape[1]):
            out = (out + windows[:, k]) * FOLD
            out ^= out >> np.uint64(29)
        return out


def shingle_values(hashes: np.ndarray, length: int) -> np.ndarray:
    """The value of each run of length words, told apart by length."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    return mixed(folded(np.lib.stride_tricks.sliding_window_view(hashes, length)).view(np.int64), length)


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def needed(q: int, threshold: float) -> int:
    """Shingles that a document must share with an item of q shingles."""
    share = Fraction(str(threshold))
    return -(-q * share.numerator // share.denominator)


def distinct_items(benchmark: DataFrame) -> DataFrame:
    """item, item2 (128 bits that stand for the row), item_id, text and times of each distinct row of benchmark."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (rows.groupBy("item_id", "text").agg(F.count("*").alias("times"))
            .select(F.xxhash64("item_id", "text").alias("item"), F.xxhash64("text", "item_id").alias("item2"), "item_id", "text", "times"))


def sketches(items: DataFrame, threshold: float, size: int) -> DataFrame:
    """value, length, need, item, item2: the sketch of each item, a row per value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, item2, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                if not words:
                    continue
                length = min(size, len(words))
                values = np.unique(shingle_values(hashed(words), length))
                need = needed(len(values), threshold)
                rows += [(v, length, need, item, item2) for v in values[:len(values) - need + 1].view(np.int64).tolist()]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], ["value", "length", "need", "item", "item2"])

    return map_arrow(items.select("item", "item2", "text"), run, "value long, length int, need long, item long, item2 long")


def filter_bits(found: DataFrame, size: int) -> np.ndarray:
    """The filter: an array of 2**size bits in which PROBES bits of each value are set. Spark collects whole words of it."""
    low, high = F.col("value").bitwiseAND((1 << 32) - 1), F.shiftrightunsigned("value", 32).bitwiseOR(1)
    bits = found.select(F.explode(F.array(*[(low + high * k).bitwiseAND((1 << size) - 1) for k in range(PROBES)])).alias("bit"))
    rows = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out.view(np.uint8)


def filter_size(n_values: int) -> int:
    """log2 of the bits of a filter of n_values."""
    return max(6, min(FILTER_BITS, (n_values * VALUE_BITS).bit_length()))


def passing(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The distinct values whose bits are set."""
    mask = np.uint64(len(bits) * 8 - 1)
    for k in range(PROBES):
        at = (values & np.uint64(0xFFFFFFFF)) + ((values >> np.uint64(32)) | np.uint64(1)) * np.uint64(k) & mask
        values = values[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        if not values.size:
            break
    return np.unique(values)


def exact_matches(text: str, items: list[tuple], threshold: float, size: int) -> list[tuple]:
    """(item_id, shingles, shared, times) of each of the items (item_id, text, times) that the text contains."""
    numbers: dict[str, int] = {}
    wanted = [(item_id, [numbers.setdefault(w, len(numbers) + 1) for w in words_of(item)], times) for item_id, item, times in items]
    words, have, out = np.array([numbers.get(w, 0) for w in words_of(text)], np.int64), {}, []
    for item_id, item, times in wanted:
        length = min(size, len(item))
        if length not in have:
            windows = np.lib.stride_tricks.sliding_window_view(words, length) if len(words) >= length else np.zeros((0, length), np.int64)
            have[length] = set(map(tuple, windows[windows.all(1)].tolist()))
        shingles = set(zip(*(item[k:] for k in range(length))))
        shared = len(shingles & have[length])
        if shared >= needed(len(shingles), threshold):
            out.append((item_id, len(shingles), shared, times))
    return out


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, item_id, n_shingles, n_shared, containment: the items that each document contains.

    Words are runs of letters and digits in lower case; shingles are distinct runs of size words. A shorter
    item is one shingle of all its words, looked for among runs of as many words. An item matches if
    n_shared / n_shingles >= threshold. Null or wordless texts and items match nothing; repeated rows match
    each; null ids stay null; empty tables give no rows; other columns are ignored.

    The documents are read once for each ROUND_VALUES sketch values of the benchmark. What is broadcast is the
    filter, of 8 MB at most; the sketches and items are joined, by value and item, with salts, so that a passage that a great
    many documents hold is dealt out. A document's candidates are verified in blocks of items, so no row gathers more than
    about BLOCK_BYTES of their texts, however many a document has.
    """
    items = staged(distinct_items(benchmark), "items")
    found = staged(sketches(items, threshold, size), "sketches")
    n_values = found.count()
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds, blocks = max(1, -(-n_values // ROUND_VALUES)), max(1, -(-n_bytes // BLOCK_BYTES))
    turn = F.pmod("item", F.lit(rounds))
    parts = [_round(docs, items.where(turn == k), found.where(turn == k), filter_size(n_values), blocks, threshold, size) for k in range(rounds)]
    return reduce(DataFrame.unionAll, parts)


def _round(docs: DataFrame, items: DataFrame, found: DataFrame, bits: int, blocks: int, threshold: float, size: int) -> DataFrame:
    """contained_items of the given items, whose sketches fit one filter; block of an item by its second hash."""
    spark = docs.sparkSession
    lengths = {r["length"]: r["need"] for r in found.groupBy("length").agg(F.min("need").alias("need")).collect()}  # size rows at most
    shipped = spark.sparkContext.broadcast((filter_bits(found, bits), lengths))

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = shipped.value
        for batch in batches:
            rows, hits = [], []
            for k, text in enumerate(texts_of(batch.column(2))):
                words = words_of(text)
                hashes = hashed(words)
                got = [passing(bits, shingle_values(hashes, n)) for n, need in lengths.items() if len(words) - n + 1 >= need]
                got = np.concatenate(got) if got else np.zeros(0, np.uint64)
                if got.size:
                    rows.append(k)
                    hits.append(got.view(np.int64).tolist())
            picked = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "text_hash", "text", "hits"])

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    suspects = staged(map_arrow(narrow, suspect, "doc_id long, text_hash long, text string, hits array<long>"), "suspects")
    one = (suspects.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"), F.first("text").alias("text"), F.first("hits").alias("hits"))
           .withColumns({"doc": F.xxhash64("doc_id", "text_hash"), "doc2": F.xxhash64("text_hash", "doc_id")}))
    one = staged(one, "one")
    salt = F.pmod("doc", F.lit(SALTS))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    hits = one.select("doc", "doc2", salt.alias("salt"), F.explode("hits").alias("value"))
    pairs = staged(hits.join(found.select("value", "item", "item2", salts), ["value", "salt"]).select("doc", "doc2", "salt", "item", "item2").distinct(), "pairs")
    held_items = items.select("item", "item2", F.struct("item_id", "text", "times").alias("x"), salts)
    listed = pairs.join(held_items, ["item", "item2", "salt"]).groupBy("doc", "doc2", F.pmod("item2", F.lit(blocks)).alias("block")).agg(F.collect_list("x").alias("items"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text_hash, text, copies, items in zip(*(c.to_pylist() for c in batch.columns)):
                for item_id, n, shared, times in exact_matches(text, [(x["item_id"], x["text"], x["times"]) for x in items], threshold, size):
                    rows.append((doc_id, text_hash, item_id, n, shared, copies * times))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "text_hash", "item_id", "n_shingles", "n_shared", "times"])

    sought = one.join(listed, ["doc", "doc2"]).select("doc_id", "text_hash", "text", "copies", "items")
    matches = map_arrow(sought, verify, "doc_id long, text_hash long, item_id long, n_shingles long, n_shared long, times long")
    every = matches.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return every.select("doc_id", "text_hash", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that contain no item of benchmark, with all their columns. Null and wordless texts, rows
    without doc_id and repeated rows are judged by their text alone; an empty table gives no rows."""
    k1, k2 = free_names(docs.columns, "k1", "k2")
    found = contained_items(docs, benchmark, threshold).select(F.col("doc_id").alias(k1), F.col("text_hash").alias(k2)).distinct()
    keyed = docs.withColumns({k1: F.col("doc_id").cast("long"), k2: F.xxhash64(F.col("text").cast("string"))}).alias("d")
    on = F.col(f"d.{k1}").eqNullSafe(F.col(f"f.{k1}")) & F.col(f"d.{k2}").eqNullSafe(F.col(f"f.{k2}"))
    return keyed.join(staged(found, "found").alias("f"), on, "left_anti").select(*quoted(docs.columns))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", F.round("containment", 6).alias("containment"))


def _words_sql(view: str, key: str) -> str:
    return f"select {key}, row_number() over () as rid, regexp_extract_all(lower(text), '{WORDS}') as w from {view} where text is not null"


OP8_SQL = f"""
with i as ({_words_sql('benchmark', 'item_id')}),
ii as (select item_id, rid, w, least({SHINGLE}, len(w)) as n from i where len(w) > 0),
items as (select distinct item_id, rid, n, unnest([array_to_string(w[k:k + n - 1], ' ') for k in range(1, len(w) - n + 2)]) as s from ii),
sizes as (select rid, count(*) as q from items group by 1),
d as ({_words_sql('documents', 'doc_id')}),
docs as (select distinct doc_id, rid, n, unnest([array_to_string(w[k:k + n - 1], ' ') for k in range(1, len(w) - n + 2)]) as s
         from d, (select distinct n from ii) where len(w) >= n),
hits as (select doc_id, docs.rid as drid, item_id, items.rid as irid, count(*) as shared from docs join items using (n, s) group by all)
select doc_id, item_id, q::bigint as n_shingles, shared::bigint as n_shared, round(shared / q, 6)::double as containment
from hits join sizes on sizes.rid = irid where shared * 10 >= q * 8
"""
