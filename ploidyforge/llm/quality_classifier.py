"""Document quality: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

The method is FTRL-proximal with per-coordinate rates (McMahan et al., 2013). A document's features are its
hashed tokens, pairs of adjacent tokens, and marks of repetition (a pair of equal tokens, or of equal tokens
around another, is one feature whatever the token), weighted by their share; a score is one sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Memo, held
from .common import crc32_remainder, map_arrow, staged, table, texts_of, tuned, utf8

#: log2 of the number of weights.
BITS = 18
#: Bound on the labelled documents that train the model, taken by hash of the id.
TRAIN_DOCS = 12_000
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 4, 0.5, 1.0, 0.2, 0.01, 8.0
ACCEPT = 0.7
FOLDS, HELD_OUT = 4, 2
#: Hashes that stand for a token right after itself, and for a token around another.
AGAIN, AROUND = np.uint32(1), np.uint32(2)
TOKENS = re.compile(r"\w+|[^\w\s]+")


def hashes() -> Memo:
    """The hash of each token."""
    return held(("hashes",), lambda: Memo(lambda token: zlib.crc32(utf8(token))))


def features(text: str) -> np.ndarray:
    """Hashed places of all tokens, token pairs and repetitions of a text, repeats included."""
    tokens = TOKENS.findall(text)
    one = np.fromiter(map(hashes().__getitem__, tokens), np.uint32, len(tokens))
    with np.errstate(over="ignore"):
        two = (one[:-1] * np.uint32(0x9E3779B1)) ^ (one[1:] * np.uint32(0x85EBCA77))
        two[one[:-1] == one[1:]] = AGAIN
        around = np.full(int((one[:-2] == one[2:]).sum()), AROUND, np.uint32)
        return (np.concatenate([one, two, around]) * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)


def logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """Weights under FTRL-proximal; the last one is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One step on a document with distinct places at, values x (bias included) and label y."""
        w = self.weights(at)
        g = (logistic(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def see(self, at: np.ndarray, times: np.ndarray, y: int) -> None:
        """One step on a document whose distinct places at occur times each."""
        self.learn(np.append(at, 1 << BITS).astype(np.int64), np.append(times * (SCALE / max(1, int(times.sum()))), 1.0), y)


def score(weights: np.ndarray, text: str) -> float:
    places = features(text)
    z = weights[-1] + (SCALE * float(weights[places].mean()) if len(places) else 0.0)
    return float(logistic(z))


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """turn, text_hash, y, places and times (distinct places and how often each occurs, packed) of the labelled texts that
    train the model, train_docs rows at most; a row has 2^BITS places at most, however long its text is.

    Distinct (doc_id, text) pairs are ranked by hash of the id, then of the text, on narrow columns; the texts of the
    chosen ones only are read again for their features."""
    wanted = (labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
              .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top")
              .where(crc32_remainder("doc_id", FOLDS) != HELD_OUT).select("doc_id", "y", F.xxhash64("doc_id").alias("turn")))
    # no more ids than rows are wanted, and each has a text at least or none: the id's rank bounds its texts' ranks
    wanted = staged(wanted.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").orderBy("turn", "doc_id").limit(train_docs), "wanted")
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id").withColumn("text_hash", F.xxhash64("text"))
    chosen = staged(known.select("doc_id", "turn", "text_hash").distinct().orderBy("turn", "doc_id", "text_hash").limit(train_docs).select("doc_id", "text_hash"), "chosen")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(t), return_counts=True) for t in texts_of(batch.column(3))]
            packed = [pa.array([x[k].astype("<u4").tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packed], ["turn", "text_hash", "y", "places", "times"])

    texts = known.join(chosen, ["doc_id", "text_hash"], "left_semi").select("turn", "text_hash", "y", "text")
    return staged(map_arrow(texts, places, "turn long, text_hash long, y int, places binary, times binary").dropDuplicates(["turn", "text_hash"]), "features")


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """Weights from labelled documents outside the held-out fold, train_docs distinct (doc_id, text) pairs at most.

    Labels other than 0 and 1 are ignored, as are ids with labels of both kinds and null ids; a repeated doc_id
    trains with each of its texts, a repeated row once; a null text is one without features. Without any label, or
    on an empty table, all weights are 0. An epoch is one task, since a step follows from the one before: it reads the
    features (not the texts) of the chosen rows, whose number is bounded, in an order set by hashes of id and text, and
    holds one batch of them beside the model; Spark sorts, and spills if need be. The driver has the model only, from
    which the next epoch starts.
    """
    featured = training_rows(docs, labels, train_docs).coalesce(1).sortWithinPartitions("turn", "text_hash")
    model = Ftrl()
    for _ in range(EPOCHS):
        shipped = docs.sparkSession.sparkContext.broadcast((model.z, model.n))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Ftrl()
            model.z, model.n = (x.copy() for x in shipped.value)
            for batch in batches:
                for y, at, times in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                    model.see(np.frombuffer(at, "<u4"), np.frombuffer(times, "<u4"), y)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (model.z, model.n)], ["z", "n"])

        made = map_arrow(featured, learn, "z binary, n binary").collect()
        if not made:
            break
        model.z, model.n = (np.frombuffer(x, "<f8") for x in made[0])
    return model.weights(slice(None))


def classify(docs: DataFrame, weights: np.ndarray, accept: float = ACCEPT) -> DataFrame:
    """doc_id, text_hash, score, predicted for every row of docs: the score reads the text alone.

    Null text counts as empty and scores as the bias does; null ids stay null; repeated rows score alike; an
    empty table gives no rows; other columns are ignored. One narrow pass; the weights have a fixed size.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        for batch in batches:
            scores = [score(w, t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= accept) for s in scores], pa.int32())], ["doc_id", "text_hash", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return map_arrow(narrow, run, "doc_id long, text_hash long, score double, predicted int")


def accepted(docs: DataFrame, weights: np.ndarray, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores accept or more."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        for batch in batches:
            yield batch.filter(pa.array([score(w, t) >= accept for t in texts_of(batch.column(at))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
