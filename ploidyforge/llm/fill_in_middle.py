"""Fill-in-middle texts by line, cut and joined in batches by pyarrow.compute."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, tuned

#: Fixed values of the contract: marks, seed of the draws, shares in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50


def _draws(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers by document: the first 8-digit groups of sha256 of 'seed:doc_id' (a null id as the text 'null')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _remainder(x: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def _before(sizes: pa.Array) -> pa.Array:
    """Sum of all sizes before each."""
    return pc.subtract(pc.cumulative_sum(sizes), sizes)


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Lines with their line feeds (a last one may have none), the text each belongs to, its place there from 0; lines by text."""
    lists = pc.split_pattern(texts, "\n")
    pieces, parents, sizes = pc.list_flatten(lists), pc.list_parent_indices(lists), pc.cast(pc.list_value_length(lists), pa.int64())
    start = _before(sizes)
    place = pc.subtract(pa.array(np.arange(len(pieces), dtype=np.int64)), start.take(parents))
    last = pc.equal(pc.add(place, 1), sizes.take(parents))
    real = pc.invert(pc.and_(last, pc.equal(pieces, "")))  # what follows the last line feed is a line only if it has something
    lines = pc.if_else(last, pieces, pc.binary_join_element_wise(pieces, "\n", ""))
    bare = pc.equal(pieces.take(pc.subtract(pc.add(start, sizes), 1)), "")
    return lines.filter(real), parents.filter(real), place.filter(real), pc.subtract(sizes, pc.cast(bare, pa.int64()))


def _joined(lines: pa.Array, held: pa.Array, counts: pa.Array) -> pa.Array:
    """The held lines of each text, which has counts of them, as one string."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lines.filter(held)), "")


def _forms(batch: pa.RecordBatch, fim_percent: int, spm_percent: int) -> list[pa.Array]:
    texts = pc.fill_null(batch.column(1), "")
    h1, h2, h3, h4 = (batch.column(k) for k in range(2, 6))
    lines, parents, place, n = units(texts)
    places = pc.add(n, 1)
    x, y = _remainder(h1, places), _remainder(h2, places)
    a, b = pc.min_element_wise(x, y), pc.max_element_wise(x, y)
    in_prefix, to_middle = pc.less(place, a.take(parents)), pc.less(place, b.take(parents))
    prefix = _joined(lines, in_prefix, a)
    middle = _joined(lines, pc.and_(pc.invert(in_prefix), to_middle), pc.subtract(b, a))
    suffix = _joined(lines, pc.invert(to_middle), pc.subtract(n, b))
    marked = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))
    hundred = pa.array(np.full(len(texts), 100))
    plain = pc.or_(pc.or_(marked, pc.equal(texts, "")), pc.greater_equal(_remainder(h3, hundred), fim_percent))
    spm = pc.less(_remainder(h4, hundred), spm_percent)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    swapped = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    straight = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    output = pc.if_else(plain, texts, pc.if_else(spm, swapped, straight))
    none = pa.scalar(None, pa.int64())
    sizes = [pc.if_else(plain, none, pc.cast(pc.utf8_length(piece), pa.int64())) for piece in (prefix, middle)]
    return [batch.column(0), n, form, *sizes, output]


def fill_in_middle(docs: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain), output by row of docs.

    Prefix, middle and suffix are runs of whole lines, cut at two places drawn from a hash of the seed and doc_id, so
    results don't depend on partitions or retries. Null text counts as empty; an empty text, one that holds a mark and
    one beyond fim_percent stay plain; a null doc_id draws as the text 'null'; repeated rows fare alike; an empty table
    gives no rows; other columns are not read. A batch is cut to a few MB or one text, however long, so memory follows
    the longest text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(_forms(batch, fim_percent, spm_percent), ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_draws(seed))
    return map_arrow(drawn, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def _halves(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    cut = pc.split_pattern(texts, mark, max_splits=1)
    return pc.list_element(cut, 0), pc.list_element(cut, 1)


def original(output: pa.Array, form: pa.Array) -> pa.Array:
    """The text before the transformation. A text with a mark stays plain, so the first mark of a kind is the one put in."""
    order, parts = [], []
    for kind in ("psm", "spm", "plain"):
        own = pc.indices_nonzero(pc.equal(form, kind))
        held = output.take(own)
        order.append(own)
        if kind == "plain" or not len(held):
            parts.append(held)
            continue
        head, rest = _halves(held, SUFFIX if kind == "psm" else PREFIX)
        second, middle = _halves(rest, MIDDLE)
        first = pc.utf8_slice_codeunits(head, len(PREFIX))
        prefix, suffix = (first, second) if kind == "psm" else (second, first)
        parts.append(pc.binary_join_element_wise(prefix, middle, suffix, ""))
    return pa.concat_arrays(parts).take(pc.sort_indices(pa.concat_arrays(order)))


def restored(fims: DataFrame) -> DataFrame:
    """fims (as of fill_in_middle) with text, rebuilt from output and form, in place of output; null outputs give null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], original(batch.column(batch.num_columns - 1), batch.column(2))], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "text"]
    kept = fims.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), "output")
    return map_arrow(kept, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, text string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    back = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("restored_sha256"))


OP12_SQL = f"""
with t as (select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || coalesce(doc_id::varchar, 'null')) as h from documents),
u as (select *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') as lines, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
c as (select *, len(lines)::bigint as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as b from u),
p as (select *, array_to_string(lines[1:a], '') as prefix, array_to_string(lines[a + 1:b], '') as middle, array_to_string(lines[b + 1:], '') as suffix,
  case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {FIM_PERCENT} then 'plain' when h4 % 100 < {SPM_PERCENT} then 'spm' else 'psm' end as form from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end) as output_sha256,
sha256(case when form = 'plain' then text else prefix || middle || suffix end) as restored_sha256 from p
"""
