"""Token counts of whole texts with a whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Vocabulary, WholeTokens, held, read_vocabulary
from .common import map_arrow, table, texts_of, tuned, utf8

CONTEXT_TOKENS = 1024


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = CONTEXT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs (doc_id, text).

    No row moves: the scan feeds the counter, and the vocabulary (a file of checked size) is broadcast.
    Null text counts as empty (0 bytes, 0 tokens), a null doc_id stays null, repeated rows are counted
    each, an empty table gives no rows, other columns are ignored. Special strings inside a text are one
    token each, as the tokenizer file says. Long runs without a break are merged in O(n log n).
    """
    vocabulary = read_vocabulary(vocabulary_path)
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, Vocabulary(vocabulary).proven()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, proven = shipped.value
        tokens = held(("counts", hash(text)), lambda: WholeTokens(Vocabulary(text), proven))
        for batch in batches:
            texts = texts_of(batch.column(1))
            n = [tokens.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(utf8(t)) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tuned(spark)
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
