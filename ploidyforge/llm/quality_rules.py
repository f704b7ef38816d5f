"""Rule-based quality filter as a short-circuit cascade.

What every rule costs and rejects is measured on a bounded sample; rules run in the order of rejections per
cost, and a document leaves the cascade at the first rule that rejects it. The order changes the work, never
the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, map_arrow, sql_words, table, texts_of, utf8

SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 50, 3, 50
#: Documents on which costs and rejections are estimated.
SAMPLE_DOCS = 500


class Text:
    """A text and what rules and columns share: its bytes and words, split once, and its counts, each worked out once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.bytes = utf8(text)
        self.words = self.bytes.split()  # splits at ASCII white space only
        self.n_words = len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, ASCII_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(ASCII_SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        lines = self.lines
        return len(lines) - len(set(lines))

    def n_repeat_words(self) -> int:
        """Words in windows of three words that occur twice or more."""
        n = self.n_words
        if n < WINDOW + 1:
            return 0
        numbers: dict[bytes, int] = {}
        a = np.array([numbers.setdefault(w, len(numbers)) for w in self.words], np.int64)
        _, pair = np.unique(a[:-2] * len(numbers) + a[1:-1], return_inverse=True)
        _, which, times = np.unique(pair * len(numbers) + a[2:], return_inverse=True, return_counts=True)
        starts = np.nonzero(times[which] > 1)[0]
        covered = np.zeros(n, bool)
        for k in range(WINDOW):
            covered[starts + k] = True
        return int(covered.sum())

    def letters(self, low: int, high: int) -> int:
        raw = np.frombuffer(self.bytes, np.uint8)
        return int(((raw >= low) & (raw <= high)).sum())


#: Fixed thresholds: a rule rejects a document for which it holds.
RULES = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 14 * t.n_words,
    "capitals": lambda t: 10 * (upper := t.letters(65, 90)) > 4 * (upper + t.letters(97, 122)),
    "shouting": lambda t: 10 * t.text.count("!") > t.n_words,
    "duplicate_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "ellipsis_lines": lambda t: 10 * sum(x.endswith(("...", "…")) for x in t.lines) > 3 * len(t.lines),
    "bullet_lines": lambda t: 10 * sum(x.startswith(("- ", "•")) for x in t.lines) > 9 * len(t.lines),
}


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def measured(texts: Iterable[str]) -> list[tuple[str, float, int, int]]:
    """(rule, seconds, rejected, texts judged) of each rule, on those of the texts that have words enough.

    The counts that become columns are needed whatever the rules say, so they are there before the clock starts."""
    seconds, rejected, n = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
    for text in map(Text, texts):
        if text.n_words < MIN_WORDS:
            continue
        n += 1
        text.word_chars, text.n_symbols, text.n_dup_lines  # noqa: B018
        for name, rule in RULES.items():
            began = time.perf_counter()
            rejected[name] += rule(text)
            seconds[name] += time.perf_counter() - began
    return [(name, seconds[name], rejected[name], n) for name in RULES]


def plan(found: Iterable[tuple[str, float, int, int]]) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) in the order of rejections per cost, from measured()."""
    rates = [(name, (seconds + 1e-9) / max(1, n), (rejected + 0.5) / (n + 1)) for name, seconds, rejected, n in found]
    return sorted(rates, key=lambda x: -x[2] / x[1])


def sampled(narrow: DataFrame, sample_docs: int) -> DataFrame:
    """rule, seconds, rejected, n over sample_docs of narrow (doc_id, text), chosen by hash of the id and measured by the tasks
    that read them: no text reaches the driver. No rows for an empty table."""
    # the bound comes from hashes alone
    turn = F.xxhash64("doc_id")
    edge = narrow.select(turn.alias("turn")).orderBy("turn").limit(sample_docs).agg(F.max("turn")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*measured(texts_of(batch.column(0)))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.float64(), pa.int64(), pa.int64()))], ["rule", "seconds", "rejected", "n"])

    near = narrow.where(turn <= edge) if edge is not None else narrow.where("false")
    return map_arrow(near.select("text"), run, "rule string, seconds double, rejected long, n long").groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "rejected", "n")])


def quality_rules(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    kept is false for base failures and for documents that a rule of the cascade rejects (rejected_by names the
    first in this run's order, or 'base'). Null text counts as empty (no words: a base failure), null ids stay
    null, repeated rows are judged each, an empty table gives no rows, other columns are ignored. One narrow pass,
    after a sample of sample_docs documents (by hash of the id; all rows of an id count as one) has set the order.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [name for name, _, _ in plan([tuple(r) for r in sampled(narrow, sample_docs).collect()])]  # a row a rule
    order += [name for name in RULES if name not in order]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in map(Text, texts_of(batch.column(1))):
                repeat = text.n_repeat_words()
                failed = base_failed(text.n_words, repeat)
                by = "base" if failed else next((name for name in order if RULES[name](text)), None)
                rows.append((text.n_words, text.word_chars, text.n_symbols, text.n_dup_lines, repeat, failed, by is None, by))
            cols = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"])

    return map_arrow(narrow, judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def _without(chars: str) -> str:
    return f"(length(text) - length(regexp_replace(text, '[{chars}]', '', 'g')))"


OP4_SQL = f"""
with d as (select doc_id, row_number() over () as rid, coalesce(text, '') as text from documents),
w as (select *, {sql_words('text')} as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
g as (select rid, words[k:k + 2] as three, k from (select rid, words, unnest(range(1, len(words) - 1)) as k from w)),
twice as (select g.rid, k from g join (select rid, three from g group by all having count(*) > 1) t on g.rid = t.rid and g.three = t.three),
covered as (select rid, count(distinct k + o) as n from twice, (select unnest([0, 1, 2]) as o) group by rid),
m as (select w.rid, doc_id, text, lines, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, {_without('#*$%&|<>')}::bigint as n_symbols,
      (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
      {_without('A-Z')} as upper_n, {_without('a-z')} as lower_n, {_without('!')} as bangs from w left join covered on covered.rid = w.rid),
b as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and 10 * n_symbols <= n_words and word_chars between 2 * n_words and 14 * n_words and 10 * upper_n <= 4 * (upper_n + lower_n)
   and 10 * bangs <= n_words and 2 * n_dup_lines <= len(lines)
   and 10 * len(list_filter(lines, lambda x: x like '%...' or x like '%…')) <= 3 * len(lines)
   and 10 * len(list_filter(lines, lambda x: x like '- %' or x like '•%')) <= 9 * len(lines)) as kept
from b
"""
