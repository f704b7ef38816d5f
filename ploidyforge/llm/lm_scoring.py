"""Language-model scores: a causal self-attention model in numpy, and a word unigram model as its base.

The attention model reads subword ids. Counts over all training text give it a start: how often each class of ids
follows each frequent id, and how the ids of a class share it after an id. One layer of causal self-attention
over a context window adds to the classes' logits what the words before tell; softmax over the classes, times
the id's share, is the probability of the next id. Windows overlap: each scores the ids that the windows before
it did not, so that every id is scored once, with context.

Texts are encoded once, the distinct words of many texts together; all later passes read the ids. The attention weights
learn from every id of the training text once: each round takes its part of the windows of all texts, every partition of
the ids learns on its own from common weights, and Spark averages the weights. Partitions, and so learners, grow with the text.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PrefixEncoder, ProvenTokens, Vocabulary, held, read_vocabulary, spread
from .common import crc32_remainder, gathered, map_arrow, staged, table, tuned

FOLDS, HELD_OUT = 7, 2
END_WORD = "\n"
#: Frequent words whose counts are broadcast; words of more bytes stand there by a hash. The others are joined.
HEAD_WORDS, HEAD_BYTES = 200_000, 64
#: Distinct words that a task counts, and bytes of them, before it hands them on.
COUNTED_WORDS, COUNTED_BYTES = 400_000, 32 << 20
#: Bytes of counted words, with 64 beside each, that a partition of the join with rare words may have on average as a hash table.
HASHED_BYTES = 64 << 20
#: Bytes of the words whose ids a task keeps for its next texts.
KNOWN_BYTES = 8 << 20
#: Bytes of ids that are scored at once.
SCORED_BYTES = 512 << 10
WINDOW, OVERLAP, WIDTH = 32, 8, 8
#: Ids with an embedding and a class table of their own, the first of them with shares of their own, and the ids
#: whose shares depend on the id before. By frequency; the last place stands for all other ids.
EMBEDDED, BEFORE, NEXT = 2048, 1024, 4096
#: Ids that are a class of their own, and bands of the others, by whether they end a word.
SINGLE, BANDS = 72, 12
ROUNDS, BATCH, HELD_WINDOWS, RATE = 2, 128, 4096, 0.2
SMOOTH_CLASS, SMOOTH_SHARE = 5.0, 20.0
N_CLASSES = SINGLE + 2 * BANDS
#: Rows of class probabilities that are held at once.
ROWS = 1024


def fold(doc_id: int | None) -> int:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS


def narrow_ids(n_ids: int) -> str:
    """The type in which ids are kept."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


class Codes:
    """Places and classes of ids from their counts: the most frequent ids are classes alone, the others lie in bands of equal
    frequency mass by whether they end a word."""

    def __init__(self, counts: np.ndarray, ends: np.ndarray) -> None:
        order = np.argsort(-counts, kind="stable")
        self.n_ids = counts.size
        self.of = np.zeros(counts.size, np.int32)
        self.of[order[:SINGLE]] = np.arange(min(SINGLE, counts.size))
        for e in (0, 1):
            rest = order[SINGLE:][ends[order[SINGLE:]] == e]
            mass = np.cumsum(counts[rest] + 0.5)
            if rest.size:
                self.of[rest] = SINGLE + e * BANDS + np.minimum(BANDS - 1, (mass - 0.25) * BANDS // mass[-1]).astype(np.int32)
        rank = np.empty(counts.size, np.int64)
        rank[order] = np.arange(counts.size)
        self.place = np.minimum(rank, EMBEDDED - 1).astype(np.int32)
        self.before = np.minimum(rank, BEFORE - 1).astype(np.int32)
        self.next = np.minimum(rank, NEXT - 1).astype(np.int32)
        self.next_ids = order[:NEXT - 1]
        total = np.bincount(self.of, counts + 0.5, N_CLASSES)
        self.share = (counts + 0.5) / total[self.of]

    def cells(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of the counters of each (id before, id): one of the class table, one of the share table."""
        return np.concatenate([self.place[before].astype(np.int64) * N_CLASSES + self.of[ids], CLASS_CELLS + self.before[before].astype(np.int64) * NEXT + self.next[ids]])


CLASS_CELLS = EMBEDDED * N_CLASSES
PAIR_CELLS = CLASS_CELLS + BEFORE * NEXT


class Prior:
    """log probability of each class after each place, and log share of an id in its class after each place."""

    def __init__(self, codes: Codes, cells: np.ndarray) -> None:
        self.codes = codes
        n = cells[:CLASS_CELLS].reshape(EMBEDDED, N_CLASSES).astype(float)
        every = n.sum(0) + 1e-3
        self.classes = np.log((n + SMOOTH_CLASS * every / every.sum()) / (n.sum(1, keepdims=True) + SMOOTH_CLASS)).astype(np.float32)
        ids = codes.next_ids
        of, share = codes.of[ids], codes.share[ids]
        rare = np.maximum(0.0, 1 - np.bincount(of, share, N_CLASSES))  # what ids without a column take of a class
        n = cells[CLASS_CELLS:].reshape(BEFORE, NEXT)[:, :len(ids)].astype(float)
        total = np.zeros((BEFORE, N_CLASSES))
        np.add.at(total.T, of, n.T)
        own = np.maximum(1e-9, 1 - rare)
        shares = (n + SMOOTH_SHARE * share / own[of]) / (total[:, of] + SMOOTH_SHARE) * own[of]
        self.shares = np.zeros((BEFORE, NEXT), np.float16)
        self.shares[:, :len(ids)] = np.log(np.maximum(shares, 1e-9))
        self.plain = np.log(codes.share).astype(np.float32)

    def log_share(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log share of each id in its class after the id before."""
        at = self.codes.next[ids]
        return np.where(at < NEXT - 1, self.shares.reshape(-1).take(self.codes.before[before] * np.int64(NEXT) + at), self.plain[ids])


def fresh_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(seed)
    draw = lambda *shape: (rnd.standard_normal(shape) * 0.25).astype(np.float32)
    return {"e": draw(EMBEDDED, WIDTH), "p": draw(WINDOW, WIDTH) * np.float32(0.2), "qkv": draw(WIDTH, 3 * WIDTH), "o": draw(WIDTH, WIDTH), "u": np.zeros((WIDTH, N_CLASSES), np.float32), "b": np.zeros(N_CLASSES, np.float32)}


MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
TRIANGLE = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def forward(w: dict[str, np.ndarray], places: np.ndarray) -> tuple:
    """States and attention of windows of embedding places (n, t), masked so that no position sees a later one."""
    t = places.shape[1]
    x = w["e"][places] + w["p"][:t]
    q, k, v = np.split(x @ w["qkv"], 3, axis=2)
    a = (q @ k.transpose(0, 2, 1)) * np.float32(WIDTH ** -0.5)
    a += MASK[:t, :t]
    a -= a.max(2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(2, keepdims=True)
    z = a @ v
    return x, q, k, v, a, z, x + z @ w["o"]


def class_log_probs(w: dict[str, np.ndarray], prior: np.ndarray, h: np.ndarray, places: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of the target classes, given states and the places before; safe at any size of the logits."""
    logits = h @ w["u"] + w["b"] + prior[places]
    logits -= logits.max(-1, keepdims=True)
    chosen = np.take_along_axis(logits, target[..., None].astype(np.int64), -1)[..., 0]
    return chosen - np.log(np.exp(logits).sum(-1))


def summed(fill, total, mask: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """exp of what fill() gives and, by total, its sums over each row (the last column of total's result); where plain exponentials would
    leave float32, the largest of each row (but for what the mask hides) is taken off first. Ratios within a row are the same."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = fill()
        np.exp(found, out=found)
        sums = total(found)
    if not (sums[..., -1].min() > 1e-30 and sums[..., -1].max() < 1e30):
        found = fill()
        found += mask
        found -= found.max(-1, keepdims=True)
        np.exp(found, out=found)
        sums = total(found)
    return found, sums


def gradients(w: dict[str, np.ndarray], prior: np.ndarray, places: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradient of the weighted mean cross-entropy of the target classes, that of the embeddings for the used ones only.

    Biases and row sums ride in the matrix products as one more column of ones, and rows are scaled where they are
    narrow, so that the wide arrays (classes, attention) are passed over as rarely as can be."""
    n, t = places.shape
    d, kind, scaled = WIDTH, w["u"].dtype, w["u"].dtype.type(WIDTH ** -0.5)
    flat = lambda m: m.reshape(n * t, -1)
    one = lambda m, last: np.hstack([m, np.full((len(m), 1), last, kind)])
    turned = lambda m: m.transpose(0, 2, 1)
    at, aim = places.reshape(-1), target.reshape(-1)
    x = one(w["e"], 1).take(places, axis=0)
    x += one(w["p"][:t], 0)
    wide = np.zeros((d + 1, 3 * d + 1), kind)  # to scaled queries, keys, values and a one
    wide[:d, :3 * d], wide[d, 3 * d] = w["qkv"], 1
    wide[:, :d] *= scaled
    qkv = (flat(x) @ wide).reshape(n, t, -1)
    q, k, v = qkv[..., :d], qkv[..., d:2 * d], qkv[..., 2 * d:]

    def seen(a: np.ndarray) -> np.ndarray:
        a *= TRIANGLE[:t, :t]
        return a @ v

    a, z = summed(lambda: q @ turned(k), seen, MASK[:t, :t])
    inverse = 1 / z[..., d:]
    z = z[..., :d] * inverse
    h = flat(x) + flat(z) @ one(w["o"], 0)
    u, back, ones = np.vstack([w["u"], w["b"]]), np.ascontiguousarray(w["u"].T), np.ones((N_CLASSES, 1), kind)
    scale = (weight.reshape(-1) / max(1.0, float(weight.sum()))).astype(kind)
    dh, found = np.empty((n * t, d), kind), np.zeros_like(u.T)
    for lo in range(0, n * t, ROWS):
        to = slice(lo, lo + ROWS)
        likely, sums = summed(lambda to=to: (h[to] @ u).__iadd__(prior.take(at[to], axis=0)), lambda e: e @ ones)
        likely.reshape(-1)[np.arange(0, likely.size, N_CLASSES) + aim[to]] -= sums[:, 0]
        part = scale[to, None] / sums
        found += likely.T @ (h[to] * part)
        np.multiply(likely @ back, part, out=dh[to])
    g = {"u": found[:, :d].T, "b": found[:, d], "o": flat(z).T @ dh}
    dz = np.empty((n, t, d + 1), kind)
    dz[..., :d] = (dh @ w["o"].T).reshape(n, t, d) * inverse
    np.negative(np.einsum("ijk,ijk->ij", dz[..., :d], z), out=dz[..., d])
    da = dz @ turned(v)
    da *= a
    dx = dh
    for to, left, right in ((0, da, k), (d, turned(da), q), (2 * d, turned(a), dz[..., :d])):  # scaled queries, keys, values
        part = flat(left @ right)
        wide[:d, to:to + d], back = flat(x)[:, :d].T @ part, wide[:d, to:to + d].T.copy()
        dx += part @ back
    g["qkv"] = wide[:d, :3 * d]
    g["qkv"][:, :d] *= scaled
    g["p"] = np.zeros_like(w["p"])
    g["p"][:t] = dx.reshape(n, t, d).sum(0)
    order = np.argsort(at.astype(np.uint16), kind="stable")  # sixteen bits are sorted by counting
    used = at.take(order)
    first = np.concatenate([[0], np.flatnonzero(used[1:] != used[:-1]) + 1])
    g["e"] = np.add.reduceat(dx.take(order, axis=0), first, axis=0)
    return g, used.take(first)


def learn(w: dict[str, np.ndarray], prior: np.ndarray, places: np.ndarray, target: np.ndarray, weight: np.ndarray, speed: dict[str, np.ndarray]) -> None:
    """One AdaGrad step in place."""
    found, used = gradients(w, prior, places, target, weight)
    for name, g in found.items():
        if name != "e":
            speed[name] += g * g
            w[name] -= np.float32(RATE) * g / np.sqrt(speed[name] + np.float32(1e-8))
            continue
        so_far = speed[name].take(used, axis=0) + g * g
        speed[name][used] = so_far
        w[name][used] = w[name].take(used, axis=0) - np.float32(RATE) * g / np.sqrt(so_far + np.float32(1e-8))


def packed(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in sorted(w)]).astype(np.float32)


def unpacked(data: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.asarray(data[at:at + like[k].size], np.float32).reshape(like[k].shape).copy()
        at += like[k].size
    return out


class Stream:
    """Id sequences back to back, each with its end, and the id before each."""

    def __init__(self, texts: list[np.ndarray], end: int) -> None:
        self.lengths = np.array([len(x) + 1 for x in texts], np.int64)
        self.ids = np.full(int(self.lengths.sum()), end, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        inner = np.ones(self.ids.size, bool)
        inner[self.ends - 1] = False
        if texts:
            self.ids[inner] = np.concatenate(texts)
        self.before = np.empty_like(self.ids)
        self.before[1:] = self.ids[:-1]
        self.before[self.starts] = end

    def windows(self, step: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, turn in its text, first position) of windows of WINDOW ids each step apart, the first length long."""
        n = 1 + -(-np.maximum(0, self.lengths - length) // step)
        owner = np.repeat(np.arange(len(n)), n)
        turn = np.arange(owner.size) - np.repeat(np.cumsum(n) - n, n)
        return owner, turn, self.starts[owner] + turn * step


class Scorer:
    """The forward pass for scoring only, with few passes over memory: attention and classes are summed as plain
    exponentials (weights are small; should one overflow, the batch is done again in the careful form). Only positions
    that a window scores ask, and a block of them looks no further than to its own end."""

    def __init__(self, w: dict[str, np.ndarray], prior: Prior) -> None:
        self.w, self.prior = w, prior
        qkv = w["qkv"].copy()
        qkv[:, :WIDTH] *= np.float32(WIDTH ** -0.5)
        # what a place adds to queries, keys and values, with the embedding itself before it and a one behind, and the same by position
        self.by_place = np.hstack([w["e"], w["e"] @ qkv, np.ones((EMBEDDED, 1))]).astype(np.float32)
        self.by_position = np.hstack([w["p"], w["p"] @ qkv, np.zeros((WINDOW, 1))]).astype(np.float32)
        self.after = prior.classes + w["b"]
        self.ones = np.ones(w["u"].shape[1], np.float32)

    def states(self, places: np.ndarray, begin: int) -> np.ndarray:
        """States of the positions from begin on."""
        x = self.by_place.take(places, axis=0)
        x += self.by_position
        d, half = WIDTH, (begin + WINDOW) // 2
        out = x[:, begin:, :d].copy()
        for lo, hi in ((begin, half), (half, WINDOW)):
            a = x[:, lo:hi, d:2 * d] @ x[:, :hi, 2 * d:3 * d].transpose(0, 2, 1)
            np.exp(a, out=a)
            a *= TRIANGLE[lo:hi, :hi]
            z = a @ x[:, :hi, 3 * d:]
            out[:, lo - begin:hi - begin] += ((z[..., :d] / z[..., d:]).reshape(-1, d) @ self.w["o"]).reshape(-1, hi - lo, d)
        return out

    def __call__(self, places: np.ndarray, begin: int, scored: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probability of the target class at the scored positions, numbered among those from begin on."""
        asked = places[:, begin:].reshape(-1).take(scored)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            logits = self.states(places, begin).reshape(-1, WIDTH).take(scored, axis=0) @ self.w["u"]
            logits += self.after.take(asked, axis=0)
            chosen = logits[np.arange(len(target)), target]
            np.exp(logits, out=logits)
            out = chosen - np.log(logits @ self.ones)
        if np.isfinite(out).all():
            return out
        return class_log_probs(self.w, self.prior.classes, forward(self.w, places)[-1][:, begin:].reshape(-1, WIDTH)[scored], asked, target)

    def texts(self, texts: list[np.ndarray], at_once: int = 80) -> np.ndarray:
        """log10 probability of each id sequence with its end, by batches of overlapping windows."""
        codes = self.prior.codes
        stream = Stream(texts, codes.n_ids - 1)
        owner, turn, first = stream.windows(WINDOW - OVERLAP, WINDOW)
        total = np.zeros(len(texts))
        source, target, share = codes.place[stream.before], codes.of[stream.ids], self.prior.log_share(stream.before, stream.ids)
        for begin, every in ((0, np.flatnonzero(turn == 0)), (OVERLAP, np.flatnonzero(turn))):
            for lo in range(0, every.size, at_once):
                now = every[lo:lo + at_once]
                at = first[now, None] + np.arange(WINDOW)
                scored = np.flatnonzero(at[:, begin:] < stream.ends[owner[now], None])
                chosen = at[:, begin:].reshape(-1).take(scored)
                logs = self(source.take(at, mode="clip"), begin, scored, target.take(chosen)) + share.take(chosen)
                total += np.bincount(owner[now].repeat(WINDOW - begin).take(scored), logs, len(texts))
        return total / math.log(10)


class Words:
    """The words of texts, A-Z in lower case: each as the number of a distinct word, with the number of its text."""

    def __init__(self, texts: pa.Array) -> None:
        parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        found = parts.flatten().dictionary_encode()
        self.distinct = found.dictionary
        self.numbers = found.indices.to_numpy()
        self.owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        nothing = pc.index(self.distinct, "").as_py()  # before the first space and behind the last
        if nothing >= 0:
            some = self.numbers != nothing
            self.numbers, self.owner = self.numbers[some], self.owner[some]


class KnownIds:
    """Ids of distinct words by the encoder, each worked out once for many chunks of texts: those of the chunks before are kept up to
    KNOWN_BYTES of words, then those of the last chunk only."""

    def __init__(self, encoder: PrefixEncoder, kind: str) -> None:
        self.encoder = encoder
        self.words, self.flat, self.sizes = pa.array([], pa.string()), np.zeros(0, kind), np.zeros(0, np.int64)

    def stretches(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each word has."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        at[new] = len(self.words) + np.arange(len(new))
        fresh = distinct.take(pa.array(new))
        flat, sizes = self.encoder.stretches(fresh)
        self.words, self.flat, self.sizes = pa.concat_arrays([self.words, fresh]), np.concatenate([self.flat, flat.astype(self.flat.dtype)]), np.concatenate([self.sizes, sizes])
        found, given = spread(self.flat, self.sizes, at, np.zeros(len(at), np.int64), 1)[0], self.sizes.take(at)
        if self.words.nbytes > KNOWN_BYTES:
            self.words, self.flat, self.sizes = distinct, found, given
        return found, given


WORD_COUNT = pa.struct([("word", pa.string()), ("n", pa.int64())])


def runs(sizes: np.ndarray, most: int = 64 << 10) -> np.ndarray:
    """Where runs of items begin, and where the last one ends: the items of a run begin within most bytes."""
    number = (np.cumsum(sizes) - sizes) // most
    return np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(sizes)]])


def few_ids(packs: pa.Array) -> Iterator[pa.Array]:
    """Runs of packed texts of SCORED_BYTES or one text: the arrays of windows take many times the ids."""
    ends = np.cumsum(pc.binary_length(packs).to_numpy())
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SCORED_BYTES, "right")))
        yield packs.slice(lo, hi - lo)
        lo = hi


def encoded(docs: DataFrame, shipped, kind: str, n_ids: int) -> DataFrame:
    """One pass over docs (doc_id, text): a row for each with its number, doc_id, text, train and ids (packed subword ids of
    its lower-cased words); and, from training rows, partial counts: words (lists of word and n), and id with c."""
    columns = {"row": pa.int64(), "doc_id": pa.int64(), "text": pa.string(), "train": pa.bool_(), "ids": pa.binary(), "words": pa.list_(WORD_COUNT), "id": pa.int64(), "c": pa.int64()}

    def rows(n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given.get(k, pa.nulls(n, t)) for k, t in columns.items()], list(columns))

    def summed_up(waiting: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(waiting).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"]).combine_chunks()

    def counted(words: pa.Table) -> Iterator[pa.RecordBatch]:
        for x in words.to_batches(max_chunksize=20_000):
            lists = runs(pc.binary_length(x.column(0)).to_numpy() + 16)
            yield rows(len(lists) - 1, words=pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(x.columns, fields=list(WORD_COUNT))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, proven = shipped.value
        encoder = KnownIds(held(("codec", hash(text)), lambda: PrefixEncoder(Vocabulary(text), proven)), kind)
        waiting, total = [], np.zeros(n_ids, np.int64)
        for batch in gathered(batches):
            words = Words(batch.column(2))
            flat, sizes = encoder.stretches(words.distinct)
            every, offsets = spread(flat, sizes, words.numbers, words.owner, batch.num_rows)
            ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets * every.itemsize).astype(np.int32)), pa.py_buffer(every)])
            train = batch.column(3).to_numpy(zero_copy_only=False)
            times = np.bincount(words.numbers[train[words.owner]], minlength=len(sizes))
            total += np.bincount(flat, np.repeat(times, sizes), n_ids).astype(np.int64)
            total[-1] += train.sum()
            used = np.flatnonzero(times)
            waiting.append(pa.table({"word": words.distinct.take(pa.array(used)), "c": times[used]}))
            if train.any():
                waiting.append(pa.table({"word": [END_WORD], "c": [int(train.sum())]}))
            if sum(w.num_rows for w in waiting) > 2 * COUNTED_WORDS or sum(w.nbytes for w in waiting) > COUNTED_BYTES:
                waiting = [summed_up(waiting)]
                if waiting[0].num_rows > COUNTED_WORDS or 2 * waiting[0].nbytes > COUNTED_BYTES:
                    yield from counted(waiting.pop())
            yield rows(batch.num_rows, row=batch.column(0), doc_id=batch.column(1), text=batch.column(2), train=batch.column(3), ids=ids)
        if sum(w.num_rows for w in waiting):
            yield from counted(summed_up(waiting))
        used = np.nonzero(total)[0]
        yield rows(len(used), id=pa.array(used, pa.int64()), c=pa.array(total[used], pa.int64()))

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = narrow.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", (crc32_remainder("doc_id", FOLDS) != HELD_OUT).alias("train"))
    return staged(map_arrow(keyed, run, "row long, doc_id long, text string, train boolean, ids binary, words array<struct<word: string, n: long>>, id long, c long"), "encoded", compression="zstd")


def cell_counts(ids: DataFrame, codes: Codes, kind: str) -> np.ndarray:
    """The counters of Codes.cells over all training ids: a table of fixed size, whatever the corpus."""
    shipped = ids.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total, waiting, n = shipped.value, np.zeros(PAIR_CELLS, np.int64), [], 0
        for batch in batches:
            stream = Stream([np.frombuffer(x, kind) for x in batch.column(0).to_pylist()], codes.n_ids - 1)
            waiting.append(codes.cells(stream.before, stream.ids))
            n += waiting[-1].size
            if n > 4_000_000:
                total += np.bincount(np.concatenate(waiting), minlength=PAIR_CELLS)
                waiting, n = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=PAIR_CELLS)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["cell", "c"])

    found = map_arrow(ids, run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    total = np.zeros(PAIR_CELLS, np.int64)
    total[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return total


def trained(ids: DataFrame, prior: Prior, kind: str, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Attention weights from ids (packed, a training text a row): each id is predicted once, in one of the rounds.

    In a round every partition learns from common weights, by AdaGrad on its own part of the windows; Spark then
    averages the partitions' weights, each by its windows. Nothing but one set of weights reaches the driver."""
    weights, context = fresh_weights(), ids.sparkSession.sparkContext
    for turn in range(rounds):
        shipped = context.broadcast((weights, prior.codes, prior.classes))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, turn=turn) -> Iterator[pa.RecordBatch]:
            start, codes, classes = shipped.value
            w = {k: v.copy() for k, v in start.items()}
            speed, seen = {k: np.zeros_like(v) for k, v in w.items()}, 0
            rnd, waiting, n = np.random.default_rng(turn), [], 0

            def take(waiting: list) -> int:
                places, target, weight = (np.concatenate(x) for x in zip(*waiting))
                order = rnd.permutation(len(places))
                for lo in range(0, len(order), BATCH):
                    at = order[lo:lo + BATCH]
                    learn(w, classes, *(x.take(at, axis=0) for x in (places, target, weight)), speed)
                return len(places)

            for batch in batches:
                stream = Stream([np.frombuffer(x, kind) for x in batch.column(0).to_pylist()], codes.n_ids - 1)
                owner, part, first = stream.windows(WINDOW, WINDOW)
                mine = (part + stream.lengths[owner]) % rounds == turn  # the same part in every run
                at = first[mine, None] + np.arange(WINDOW)
                weight = (at < stream.ends[owner[mine], None]).astype(np.float32)
                at = np.minimum(at, stream.ids.size - 1)
                waiting.append((codes.place.take(stream.before.take(at)), codes.of.take(stream.ids.take(at)), weight))
                n += len(at)
                if n >= HELD_WINDOWS:
                    seen += take(waiting)
                    waiting, n = [], 0
            if n:
                seen += take(waiting)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([packed(w)], pa.list_(pa.float32()))], ["seen", "w"])

        made = map_arrow(ids, run, "seen double, w array<float>").select("seen", F.posexplode("w").alias("k", "x"))
        mean = made.groupBy("k").agg((F.sum(F.col("x") * F.col("seen")) / F.sum("seen")).alias("x")).toArrow()  # a row per weight
        if not mean.num_rows:
            break
        values = np.zeros(mean.num_rows, np.float32)
        values[mean.column(0).to_numpy()] = mean.column(1).to_numpy()
        weights = unpacked(values, weights)
    return weights


def head_words(words: DataFrame) -> DataFrame:
    """The most frequent words, HEAD_WORDS at most: all those with 2**k occurrences or more, for the least k that fits."""
    sizes = dict(words.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).count().collect())
    room, least = HEAD_WORDS, 64
    for k in sorted(sizes, reverse=True):
        room -= sizes[k]
        if room < 0:
            break
        least = k
    short = F.when(F.octet_length("word") <= HEAD_BYTES, F.encode("word", "UTF-8")).otherwise(F.concat(F.lit(b"\0"), F.unhex(F.sha2(F.encode("word", "UTF-8"), 256))))
    return words.where(F.floor(F.log2("c")) >= least).select(short.alias("word"), "c")


def head_key(word: bytes) -> bytes:
    return word if len(word) <= HEAD_BYTES else b"\0" + hashlib.sha256(word).digest()


class Fitted:
    """What is learned from the training rows of docs: counts of words, the prior, the attention weights; and the
    encoded texts of all rows, staged."""

    def __init__(self, docs: DataFrame, vocabulary_path: str) -> None:
        spark = docs.sparkSession
        text = read_vocabulary(vocabulary_path)
        vocabulary = Vocabulary(text)
        if not vocabulary.word_end:
            raise ValueError("the language model needs a vocabulary whose tokens mark the ends of words")
        n_ids = max(vocabulary.strings) + 2  # the last id is the end of a text
        self.kind = narrow_ids(n_ids)
        self.rows = encoded(docs, spark.sparkContext.broadcast((text, ProvenTokens(vocabulary, vocabulary.proven()))), self.kind, n_ids)
        self.words = staged(self.rows.where("words is not null").select(F.inline("words")).groupBy("word").agg(F.sum("n").alias("c")), "words")
        self.n, self.v, self.word_bytes = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first()
        counts, ends = np.zeros(n_ids, np.int64), np.zeros(n_ids, np.int8)
        for i, c in self.rows.where("id is not null").groupBy("id").agg(F.sum("c")).collect():  # a row per vocabulary id
            counts[i] = c
        for i, s in vocabulary.strings.items():
            ends[i] = s.endswith(vocabulary.word_end)
        ends[-1] = 1
        self.texts = self.rows.where("ids is not null")
        ids = self.texts.where("train").select("ids")
        codes = Codes(counts, ends)
        self.prior = Prior(codes, cell_counts(ids, codes, self.kind))
        self.weights = trained(ids, self.prior, self.kind)


def lm_scores(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Both models learn from the rows whose crc32(doc_id as text) mod 7 is not 2 (a null id counts as the text 'null').
    base_score adds log10((c + 1) / (N + V + 1)) over the words and one end; score is the attention model's
    log10 probability of the text's subword ids and end. Null text counts as empty (one token, the end),
    repeated rows count each and score alike, an empty table gives no rows, other columns are ignored; without
    training rows the base score is 0 for any word. Frequent words' counts are broadcast up to a fixed number;
    the other words of each text are joined with the counts, so that every count enters.
    """
    return scored(Fitted(docs, vocabulary_path))


def scored(fitted: Fitted) -> DataFrame:
    """The scores of the texts that fitted holds."""
    words, n, v, kind = fitted.words, fitted.n, fitted.v, fitted.kind
    below = math.log10(n + v + 1)
    head = head_words(words).toArrow().combine_chunks()
    names = pa.concat_arrays([pa.array([], pa.binary()), *(c.cast(pa.binary()) for c in head.column(0).chunks)])
    model = words.sparkSession.sparkContext.broadcast((fitted.weights, fitted.prior, names, np.log10(head.column(1).to_numpy() + 1.0) - below))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, prior, head, logs = model.value
        scorer = Scorer(weights, prior)
        for batch in gathered(batches):
            words, n = Words(batch.column(2)), batch.num_rows
            keys = words.distinct.cast(pa.binary())
            long = pc.greater(pc.binary_length(keys), HEAD_BYTES)
            if pc.any(long).as_py():
                keys = pc.replace_with_mask(keys, long, pa.array([head_key(x) for x in keys.filter(long).to_pylist()], pa.binary()))
            at = pc.fill_null(pc.index_in(keys, value_set=head), -1).to_numpy()[words.numbers]
            known = at >= 0
            # (text, word) of the words that are not in the head, each pair once
            pairs, times = np.unique(words.owner[~known] * max(1, len(keys)) + words.numbers[~known], return_counts=True)
            owner, number = np.divmod(pairs, max(1, len(keys)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32())
            cols = {
                "row": batch.column(0), "doc_id": batch.column(1),
                "n_tokens": pa.array(np.bincount(words.owner, minlength=n) + 1, pa.int64()),
                "head_known": pa.array(np.bincount(words.owner[known], minlength=n), pa.int64()),
                "head_score": pa.array(np.bincount(words.owner[known], logs[at[known]], n), pa.float64()),
                "rare": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([words.distinct.take(pa.array(number)), pa.array(times, pa.int64())], fields=list(WORD_COUNT))),
            }
            del words, keys, at, known, pairs, owner, number
            cols["score"] = pa.array(np.concatenate([scorer.texts([np.frombuffer(x, kind) for x in ids.to_pylist()]) for ids in few_ids(batch.column(3))]), pa.float64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    kept = staged(map_arrow(fitted.texts.select("row", "doc_id", "text", "ids"), run, "row long, doc_id long, n_tokens long, head_known long, head_score double, rare array<struct<word: string, n: long>>, score double"), "scored")
    # where a partition's counts fit a hash table, nothing is sorted for the join
    fits = fitted.word_bytes <= HASHED_BYTES * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = F.coalesce("c", F.lit(0))
    rest = (kept.select("row", F.inline("rare")).join(words.hint("shuffle_hash") if fits else words, "word", "left").groupBy("row")
            .agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * (F.log10(c + 1) - F.lit(below))).alias("rare_score")))
    joined = kept.join(staged(rest, "rest"), "row", "left")
    end_c = words.where(F.col("word") == END_WORD).select("c").first()
    end_c = end_c[0] if end_c else 0
    return joined.select(
        "doc_id", (crc32_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(end_c > 0))).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rare_score", F.lit(0.0)) + F.lit(math.log10(end_c + 1) - below)).alias("base_score"), "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tuned(spark)
    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
