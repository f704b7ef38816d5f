"""BPE encoding and decoding with one dynamic program per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TABLE_BYTES, PrefixEncoder, ProvenTokens, Vocabulary, held, read_vocabulary
from .common import gathered, map_arrow, table, tuned


def encode_decode(docs: DataFrame, vocabulary_path: str, texts: bool = True, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded, n_tokens, ids_sha256, decoded_sha256 per row of docs.

    With texts=False the ids and the decoded text are left out, so that only digests leave the Python
    worker. Null text counts as empty (no ids, decoded ''), a null doc_id stays null, repeated rows are
    encoded each, an empty table gives no rows, other columns are ignored. One narrow pass over the scan;
    a worker's tables take some 2.5 table_bytes at most.
    """
    vocabulary = read_vocabulary(vocabulary_path)
    parsed = Vocabulary(vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, ProvenTokens(parsed, parsed.proven())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, proven = shipped.value
        tokens = held(("codec", hash(text)), lambda: PrefixEncoder(Vocabulary(text), proven, table_bytes))
        for batch in gathered(batches):
            ids = tokens.encode_all(batch.column(1))
            decoded = [tokens.decode(x) for x in ids]
            out = {
                "doc_id": batch.column(0).cast(pa.int64()),
                "n_tokens": pa.array(list(map(len, ids)), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            }
            if texts:
                out |= {"ids": pa.array([x.tobytes() for x in ids], pa.binary()), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if texts else "")
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tuned(spark)
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), texts=False)
