"""Cross-site boilerplate lines by distinct-site spread. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, quoted, staged, table

MIN_SITES, MIN_CHARS = 5, 16
#: log2 of the registers of a sketch: relative standard error 1.04 / sqrt(2**12) = 1.6 %.
LG_K = 12
#: Estimates within so many standard errors of the threshold, and at least within 1, are counted exactly.
ERRORS = 6
SALTS = 16


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")


def _name(line: Column) -> Column:
    """128 bits that stand for a line: its hash, and the hash from another seed (what comes first sets the seed of what
    follows) of the line moved on by a byte, so that what cancels out in a word of the one does not in the other."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit("second"), F.concat(F.lit("."), line)).alias("g"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, site, at (place of a line in its text, from 0), h, g of every line that counts."""
    named = F.transform(_lines(), lambda x, i: F.struct(i.alias("at"), F.length(F.trim(x)).alias("size"), _name(F.trim(x)).alias("line")))
    long = F.filter(named, lambda x: x["size"] >= MIN_CHARS)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("source").cast("string").alias("site"), F.explode(long).alias("x"))
            .select("doc_id", "text_hash", "site", F.col("x.at").alias("at"), F.col("x.line.h").alias("h"), F.col("x.line.g").alias("g")))


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash", "at"), F.lit(SALTS)))


def _every_salt(lines: DataFrame) -> DataFrame:
    """Each line once for each salt, so that its occurrences are joined in as many parts; never broadcast, as the lines
    grow with the corpus."""
    return lines.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, text_hash, at: places of lines that occur on min_sites sites or more, but for each line's first document.

    Null text has no lines, a null source is no site, an empty table gives no rows. A line of fewer than min_sites
    occurrences can't qualify and is dropped from the search first. For the rest a HyperLogLog sketch of the sites is
    made by line and salt and merged by line, so that a line of any frequency is aggregated, and joined, in parts.
    Lines whose estimate lies near the threshold are counted exactly; the estimate alone decides only where it is
    ERRORS standard errors or more away.
    """
    lines = _keyed(docs)
    often = staged(lines.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h", "g"), "often")
    key = ["h", "g", "salt"]
    hits = staged(_salted(lines).join(_every_salt(often), key, "left_semi"), "hits")
    parts = hits.groupBy(*key).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = staged(parts.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites")), "spread")
    margin = max(1.0, min_sites * ERRORS * 1.04 / 2 ** (LG_K / 2))
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("h", "g")
    exact = hits.join(_every_salt(near), key, "left_semi").select("h", "g", "site").where("site is not null").distinct().groupBy("h", "g").count().where(F.col("count") >= min_sites)
    bad = staged(spread.where(F.col("sites") > min_sites + margin).select("h", "g").union(exact.select("h", "g")), "bad")
    # the first document keeps its lines: the smallest doc_id (rows without one come last), then text hash
    where = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash")
    bad_hits = staged(hits.join(_every_salt(bad), key, "left_semi").select(*key, "doc_id", "text_hash", "at"), "bad_hits")
    first = staged(bad_hits.groupBy("h", "g").agg(F.min(where).alias("first")), "first")
    return bad_hits.join(_every_salt(first), key).where(where != F.col("first")).select("doc_id", "text_hash", "at")


def _without(lines: Column, out: Column) -> Column:
    """lines but for those at the places out (ascending): the stretches between them, one after another."""
    def stretch(i):
        begin = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(out, i) + 1)
        end = F.coalesce(F.try_element_at(out, i + 1), F.size(lines))
        return F.slice(lines, begin + 1, end - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(out)), stretch))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs (doc_id, text, source and any other columns) with boilerplate lines taken out of text, and n_removed.

    Lines are the stretches between line feeds; they are compared without spaces at their ends, and count if they
    have MIN_CHARS characters or more. A line that occurs on min_sites distinct sources or more stays only
    in its first document (smallest doc_id, then hash of the text), wherever it occurs there, and goes
    everywhere else. Null text stays null, with nothing removed; a null source is no site; rows without
    doc_id come after all others as first documents; repeated rows fare alike; a text may become empty but no
    row goes; an empty table gives no rows. Extra columns pass through (n_removed is replaced). The work on a
    text is linear in its lines, however many of them go.
    """
    k1, k2, out, lines, kept = free_names(docs.columns, "k1", "k2", "out", "lines", "kept")
    found = boilerplate(docs, min_sites).groupBy(F.col("doc_id").alias(k1), F.col("text_hash").alias(k2)).agg(F.array_sort(F.collect_set("at")).alias(out)).alias("f")
    keyed = docs.withColumns({k1: F.col("doc_id").cast("long"), k2: F.xxhash64(F.col("text").cast("string"))}).alias("d")
    on = F.col(f"d.{k1}").eqNullSafe(F.col(f"f.{k1}")) & F.col(f"d.{k2}").eqNullSafe(F.col(f"f.{k2}"))
    joined = keyed.join(found, on, "left").select(*quoted([c for c in docs.columns if c != "n_removed"], "d"), out)
    split = joined.withColumn(lines, F.when(F.col(out).isNotNull(), _lines()))
    cut = split.withColumn(kept, _without(F.col(lines), F.col(out)))
    return (cut.withColumn("n_removed", F.when(F.col(out).isNotNull(), F.size(out)).otherwise(0).cast("long"))
            .withColumn("text", F.when(F.col(out).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))).drop(out, lines, kept))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_removed", F.size(_lines()).cast("long").alias("n_lines_left"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


OP9_SQL = f"""
with d as (select doc_id, source, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines, row_number() over () as rid from documents),
l as (select rid, doc_id, source, k, lines[k] as raw, trim(lines[k], ' ') as line from (select *, unnest(range(1, len(lines) + 1)) as k from d)),
bad as (select line, min(doc_id) as first_doc from l where length(line) >= {MIN_CHARS} group by line having count(distinct source) >= {MIN_SITES}),
kept as (select rid, string_agg(raw, chr(10) order by k) as text, count(*) as n from l left join bad using (line) where bad.line is null or doc_id = first_doc group by rid)
select doc_id, (len(lines) - coalesce(n, 0))::bigint as n_removed, greatest(coalesce(n, 0), 1)::bigint as n_lines_left, md5(coalesce(kept.text, '')) as text_md5
from d left join kept using (rid)
"""
