"""Line dedup, quality rules and classifier, language model, WARC."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ploidyforge.llm import line_dedup, lm_scoring, quality_classifier, quality_rules, warc
from ploidyforge.llm.common import fresh_path

from .samples import ODD, documents, empty, pairs, texts

DATA = "/root/testdata/sf0.01"


# --- line dedup

def line_rows():
    common, rare = "This line is on very many sites.", "This line is on only a few sites."
    rows = [(k, "\n".join([f"Document {k} has a line of its own", common] + [rare] * (k % 12 < 2) + ["short"]), "en", f"s{k % 6}", 0) for k in range(30)]
    return rows + [(40, None, None, None, None), (41, "", "", "", 0), (None, common, None, "s0", 0), (None, f"  {common}  \n\n", None, None, 0), rows[7], rows[7], (0, common, "en", "s9", 0), (2, f"{common}\n{common}", "", None, 0)]


def plain_dedup(rows, sites=5):
    spread, first = {}, {}
    key = lambda r: (r[0] is None, r[0] or 0)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            line = line.strip(" ")
            if len(line) >= line_dedup.MIN_CHARS:
                spread.setdefault(line, set()).update({r[3]} - {None})
                first[line] = min(first.get(line, key(r)), key(r))
    bad = {x for x, s in spread.items() if len(s) >= sites}
    return bad, first, key


def test_line_dedup(spark):
    rows = [r for r in line_rows() if r[0] != 0 or r[3] != "s9"]  # one text for the smallest id: the first document is plain
    bad, first, key = plain_dedup(rows)
    assert len(bad) == 1
    expected = sorted(((r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if x.strip(" ") not in bad or first[x.strip(" ")] == key(r))) for r in rows), key=repr)
    docs = documents(spark, rows=rows)
    got = line_dedup.drop_boilerplate(docs)
    assert pairs(got, "doc_id", "text") == expected
    assert set(got.columns) == set(docs.columns)
    assert got.where("n_removed > 0").count() > 20


def test_line_dedup_ties_and_nothing(spark):
    got = line_dedup.drop_boilerplate(documents(spark, rows=line_rows()))
    assert got.count() == len(line_rows())
    assert sum("very many" in (r["text"] or "") for r in got.collect()) == 1  # id 0 has two texts: the hash decides
    assert line_dedup.drop_boilerplate(empty(spark)).count() == 0


def test_line_dedup_is_native(spark):
    plan = line_dedup.drop_boilerplate(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- rules

def test_rules_against_plain_counts(spark):
    docs = documents(spark)
    for r in quality_rules.quality_rules(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").where("doc_id <> 12 and doc_id <> 6").collect():
        text = r["text"] or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        three = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        covered = {k + o for k in range(len(words) - 2) for o in range(3) if three[tuple(words[k:k + 3])] > 1}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert r["kept"] == (not r["base_failed"] and not any(rule(quality_rules.Text(text)) for rule in quality_rules.RULES.values()))
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_order_follows_rejections_per_cost():
    plan = quality_rules.plan(quality_rules.measured([" ".join(["word***"] * 60)] * 20))
    rates = [share / cost for _, cost, share in plan]
    assert rates == sorted(rates, reverse=True) and {n for n, *_ in plan} == set(quality_rules.RULES)


# --- classifier

@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_classifier_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality_classifier.op2_quality_classifier(spark, DATA).join(labels, "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert held[1] > 50 and held[0] >= 0.95
    assert got.where("(predicted = 1) <> (score >= 0.7) or score < 0 or score > 1 or score is null").count() == 0


def plain_ftrl(rows, epochs=quality_classifier.EPOCHS):
    """FTRL-proximal with dictionaries: rows of ({feature: value}, label) in order; weights by feature."""
    q = quality_classifier
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= q.L1:
            return 0.0
        return -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
                n[i] += g * g
    return weight


def plain_features(text):
    tokens = quality_classifier.TOKENS.findall(text)
    one = [zlib.crc32(t.encode()) for t in tokens]
    found = list(one)
    for a, b in zip(one, one[1:]):
        found.append(1 if a == b else (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF))
    found += [2 for a, b in zip(one, one[2:]) if a == b]
    places = Counter((f * 0xC2B2AE3D & 0xFFFFFFFF) >> (32 - quality_classifier.BITS) for f in found)
    total = max(1, sum(places.values()))
    return {k: c * quality_classifier.SCALE / total for k, c in places.items()} | {1 << quality_classifier.BITS: 1.0}


def test_classifier_against_dictionaries(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(k * 3, k % 2) for k in range(30)], "doc_id long, quality int")
    rows = quality_classifier.training_rows(docs, labels).collect()
    text_of = {(r["h64"]): r["text"] or "" for r in docs.select(F.xxhash64("text").alias("h64"), "text").collect()}
    order = sorted((r["turn"], r["text_hash"], r["y"]) for r in rows)
    weight = plain_ftrl([(plain_features(text_of[h]), y) for _, h, y in order])
    got = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).select("text_hash", "score").collect()
    assert len(got) == docs.count() and len({r["score"] for r in got}) > 20
    for r in got:
        z = sum(weight(i) * v for i, v in plain_features(text_of[r["text_hash"]]).items())
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_training_rows_are_bounded(spark):
    docs = documents(spark)
    many = docs.union(docs.where("doc_id = 9").withColumn("text", F.explode(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: F.concat(F.lit("copy "), k.cast("string"))))))
    labels = spark.createDataFrame([(k * 3, k % 2) for k in range(30)], "doc_id long, quality int")
    assert quality_classifier.training_rows(many, labels, 12).count() == 12


def test_training_streams_rows_of_bounded_size(spark):
    docs = documents(spark, rows=[(k, text, "en", "s", 0) for k, text in [(0, "one two " * 200_000), (1, " ".join(f"w{k}" for k in range(300_000))), (2, None)]] + [(k, f"short text {k} of its own", "en", "s", 0) for k in range(3, 400)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    rows = quality_classifier.training_rows(docs, labels).collect()
    assert max(len(r["places"]) for r in rows) <= 4 << quality_classifier.BITS and all(len(r["places"]) == len(r["times"]) for r in rows)
    weights = quality_classifier.fit(docs, labels)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert (quality_classifier.fit(docs.repartition(5, "text"), labels) == weights).all()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_classifier_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1), (3, 1), (6, 0), (6, 1), (9, None), (None, 0), (45, 0), (45, 0), (3000, 1)], "doc_id long, quality int")
    weights = quality_classifier.fit(docs, labels)
    got = quality_classifier.classify(docs, weights)
    assert got.count() == docs.count() and got.where("score is null").count() == 0
    one = {(r["text_hash"], r["score"]) for r in got.collect()}
    assert len({h for h, _ in one}) == len(one)
    none = quality_classifier.fit(docs, labels.where("doc_id < 0"))
    assert not none.any() and {r[0] for r in quality_classifier.classify(docs, none).select("score").collect()} == {0.5}
    assert quality_classifier.classify(empty(spark), weights).count() == 0
    assert quality_classifier.accepted(docs, none, 0.5).count() == docs.count()


def test_scores_do_not_read_labels_or_ids(spark):
    docs = documents(spark)
    weights = quality_classifier.fit(docs, spark.createDataFrame([(k * 3, k % 2) for k in range(40)], "doc_id long, quality int"))
    moved = docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("source", F.lit("other")).withColumn("lang", F.lit("xx"))
    score = lambda df: sorted(r["score"] for r in quality_classifier.classify(df, weights).collect())
    assert score(docs) == score(moved)


# --- language model

def test_base_scores(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    fold = lambda d: zlib.crc32(str("null" if d is None else d).encode()) % 7
    count = Counter()
    for d, t in rows:
        if fold(d) != 2:
            count.update([*t.encode().lower().split(), b"\n"])
    n, below = sum(count.values()), math.log10(sum(count.values()) + len(count) + 1)
    expected = Counter()
    for d, t in rows:
        words = [*t.encode().lower().split(), b"\n"]
        expected[d, fold(d) == 2, len(words), sum(count[w] > 0 for w in words), n, round(sum(math.log10(count[w] + 1) - below for w in words), 6)] += 1
    lm_scoring_rows = lm_scoring.lm_scores(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm_scoring_rows) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in lm_scoring_rows)


def test_rare_words_are_joined(spark, monkeypatch):
    docs = documents(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    base = lambda: sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6)) for r in lm_scoring.lm_scores(docs, path).collect())
    whole = base()
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 5)
    assert base() == whole


N_IDS = 9000


def model(seed=3):
    rnd = np.random.default_rng(seed)
    codes = lm_scoring.Codes(rnd.integers(0, 50, N_IDS), rnd.integers(0, 2, N_IDS).astype(np.int8))
    before, ids = rnd.integers(0, N_IDS, 40_000), rnd.integers(0, N_IDS, 40_000)
    prior = lm_scoring.Prior(codes, np.bincount(codes.cells(before, ids), minlength=lm_scoring.PAIR_CELLS))
    w = lm_scoring.fresh_weights()
    w["u"] = (rnd.standard_normal(w["u"].shape) * 0.2).astype(np.float32)
    return w, prior


def plain_score(w, prior, ids):
    """log10 probability of an id sequence with its end, one position at a time over all ids' classes."""
    codes, total = prior.codes, 0.0
    flat = np.append(ids, codes.n_ids - 1).astype(np.int64)
    before = np.concatenate([[codes.n_ids - 1], flat[:-1]]).astype(np.int64)
    step = lm_scoring.WINDOW - lm_scoring.OVERLAP
    for k in range(len(flat)):
        first = 0 if k < lm_scoring.WINDOW else -(-(k - lm_scoring.WINDOW + 1) // step) * step
        places = codes.place[before[first:k + 1]][None]
        h = lm_scoring.forward(w, places)[-1]
        logits = (h[0, -1] @ w["u"] + w["b"] + prior.classes[places[0, -1]]).astype(float)
        total += logits[codes.of[flat[k]]] - np.log(np.exp(logits).sum()) + prior.log_share(before[k:k + 1], flat[k:k + 1])[0]
    return total / math.log(10)


def test_probabilities_add_up_and_no_position_sees_a_later_one():
    w, prior = model()
    codes = prior.codes
    places = np.random.default_rng(5).integers(0, lm_scoring.EMBEDDED, (2, lm_scoring.WINDOW))
    h = lm_scoring.forward(w, places)[-1]
    logs = np.stack([lm_scoring.class_log_probs(w, prior.classes, h, places, np.full(places.shape, c)) for c in range(lm_scoring.N_CLASSES)], -1)
    assert np.allclose(np.exp(logs).sum(-1), 1, atol=1e-4)
    every = np.arange(N_IDS)
    for before in (0, 17, 5000):
        share = np.bincount(codes.of, np.exp(prior.log_share(np.full(N_IDS, before), every).astype(float)), lm_scoring.N_CLASSES)
        assert np.allclose(share[np.unique(codes.of)], 1, atol=5e-3)
    places[:, 20:] = 7
    assert np.allclose(lm_scoring.forward(w, places)[-1][:, :20], h[:, :20])


def test_windows_score_each_id_once():
    w, prior = model()
    rnd = np.random.default_rng(9)
    texts_ = [rnd.integers(0, N_IDS, n) for n in (0, 1, 31, 32, 33, 60, 200)]
    for ids, total in zip(texts_, lm_scoring.Scorer(w, prior).texts(texts_)):
        want = plain_score(w, prior, ids)
        assert abs(want - total) < 1e-3 * max(1, abs(total))


def test_gradients_are_slopes():
    w, prior = model()
    w = {k: v.astype(np.float64) for k, v in w.items()}
    rnd = np.random.default_rng(1)
    places, target, weight = rnd.integers(0, 50, (3, 9)), rnd.integers(0, lm_scoring.N_CLASSES, (3, 9)), np.ones((3, 9))
    loss = lambda: -(lm_scoring.class_log_probs(w, prior.classes, lm_scoring.forward(w, places)[-1], places, target) * weight).sum() / weight.sum()
    g, used = lm_scoring.gradients(w, prior.classes, places, target, weight)
    g["e"] = {k: row for k, row in zip(used, g["e"])}
    for name in w:
        if name == "e":
            row = max(g["e"], key=lambda k: np.abs(g["e"][k]).max())
            col = int(np.abs(g["e"][row]).argmax())
            at, slope_is = (row, col), g["e"][row][col]
        else:
            at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
            slope_is = g[name][at]
        keep = w[name][at]
        w[name][at] = keep + 1e-4
        up = loss()
        w[name][at] = keep - 1e-4
        slope = (up - loss()) / 2e-4
        w[name][at] = keep
        assert abs(slope - slope_is) < 2e-3 * max(1e-3, abs(slope)) + 1e-6


def test_scores_end_to_end_against_the_plain_form(spark):
    docs = documents(spark)
    fitted = lm_scoring.Fitted(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert np.abs(fitted.weights["u"]).max() > 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(((str(r["doc_id"]), round(r["score"], 2)) for r in lm_scoring.scored(fitted).collect()))
    want = []
    for r in docs.collect():
        words = (r["text"] or "").encode().lower().split()
        ids = [i for x in words for i in library.encode(x.decode(), add_special_tokens=False).ids]
        want.append((str(r["doc_id"]), plain_score(fitted.weights, fitted.prior, np.array(ids, np.int64))))
    for (d, x), (e, y) in zip(got, sorted(want)):
        assert d == e and abs(x - y) < 0.02 + 1e-3 * abs(y)


def test_each_id_of_the_training_texts_is_learned_once(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, " ".join(f"word{k} of" for k in range(n))) for i, n in enumerate((0, 1, 5, 15, 16, 40, 300, 300))] + [(None, "no key"), (9, None), (9, "twice"), (9, "twice")]
    fitted = lm_scoring.Fitted(spark.createDataFrame(rows, "doc_id long, text string"), path)
    codes, kind = fitted.prior.codes, fitted.kind
    packs = [np.frombuffer(r["ids"], kind) for r in fitted.texts.where("train").select("ids").collect()]
    assert len(packs) == sum(lm_scoring.fold(d) != lm_scoring.HELD_OUT for d, _ in rows)
    stream = lm_scoring.Stream(packs, codes.n_ids - 1)
    owner, part, first = stream.windows(lm_scoring.WINDOW, lm_scoring.WINDOW)
    times = Counter()
    for turn in range(lm_scoring.ROUNDS):
        mine = (part + stream.lengths[owner]) % lm_scoring.ROUNDS == turn
        for at, end in zip(first[mine], stream.ends[owner[mine]]):
            times.update(range(at, min(at + lm_scoring.WINDOW, end)))
    assert times == Counter(range(stream.ids.size))
    count = np.bincount(stream.ids, minlength=codes.n_ids)
    assert sum(r["c"] for r in fitted.rows.where("id is not null").collect()) == count.sum()


def test_words_are_told_apart_once_for_many_texts():
    every = [*ODD, *texts(10), "A b\x0b\x0cC\r\td  ", "\x1cQ\xa0r\x85 \u2003x", None]
    words = lm_scoring.Words(pa.array(every, pa.string()))
    assert len(set(words.distinct.to_pylist())) == len(words.distinct)
    got = [[] for _ in every]
    for text, number in zip(words.owner.tolist(), words.numbers.tolist()):
        got[text].append(words.distinct[number].as_py())
    assert got == [[x.decode() for x in (t or "").encode().lower().split()] for t in every]


def test_ids_of_known_words_are_kept_within_bounds(monkeypatch):
    class Counting:
        asked = []

        def stretches(self, words):
            self.asked += words.to_pylist()
            sizes = np.array([len(x) for x in words.to_pylist()], np.int64)
            return np.array([ord(c) for x in words.to_pylist() for c in x], np.int64), sizes

    chunks = [["ab", "", "c"], ["c", "ab", "def"], [], ["def", "ab", "x"]]
    for bound, asked in ((lm_scoring.KNOWN_BYTES, ["ab", "", "c", "def", "x"]), (0, ["ab", "", "c", "def", "def", "ab", "x"])):
        monkeypatch.setattr(lm_scoring, "KNOWN_BYTES", bound)
        Counting.asked = []
        known = lm_scoring.KnownIds(Counting(), "<u2")
        for words in chunks:
            flat, sizes = known.stretches(pa.array(words, pa.string()))
            assert flat.tolist() == [ord(c) for x in words for c in x] and sizes.tolist() == [len(x) for x in words]
        assert Counting.asked == asked
        assert bound or known.words.to_pylist() == chunks[-1]


def test_counts_travel_as_lists_and_texts_are_told_by_row(spark):
    rows = [(7, "same rare words here"), (7, "same rare words here"), (None, "same rare words here"), (None, None), (3, " ".join(f"w{k}" for k in range(30_000)))]
    fitted = lm_scoring.Fitted(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"))
    lists = [len(r["words"]) for r in fitted.rows.where("words is not null").select("words").collect()]
    assert len(lists) < 30 and sum(lists) >= 30_000  # not a row a word
    numbers = [r["row"] for r in fitted.texts.select("row").collect()]
    assert len(set(numbers)) == len(numbers) == len(rows)
    assert lm_scoring.runs(np.array([40, 40, 10, 500, 1]), 64).tolist() == [0, 2, 4, 5]


def test_rare_words_join_the_same_with_and_without_a_hash_table(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 5)
    fitted = lm_scoring.Fitted(documents(spark), public_tokenizers.path("word_bpe_49k.json"))
    found, plans = [], []
    real = lm_scoring.staged
    monkeypatch.setattr(lm_scoring, "staged", lambda df, name, **k: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name, **k))
    for most in (lm_scoring.HASHED_BYTES, -1):
        monkeypatch.setattr(lm_scoring, "HASHED_BYTES", most)
        found.append(sorted((str(r["doc_id"]), r["n_known"], round(r["base_score"], 6)) for r in lm_scoring.scored(fitted).collect()))
    assert found[0] == found[1]
    assert [("shuffle_hash" in p) for name, p in plans if name == "rest"] == [True, False]


def test_gradients_hold_where_plain_exponentials_would_not():
    w, prior = model()
    rnd = np.random.default_rng(4)
    places, target, weight = rnd.integers(0, 50, (3, 9)), rnd.integers(0, lm_scoring.N_CLASSES, (3, 9)), np.ones((3, 9), np.float32)
    plain, used = lm_scoring.gradients(w, prior.classes, places, target, weight)
    moved, _ = lm_scoring.gradients({**w, "b": w["b"] + np.float32(200)}, prior.classes, places, target, weight)  # the softmax is the same
    assert all(np.abs(plain[k] - moved[k]).max() < 1e-4 for k in plain)
    steep = {**w, "qkv": w["qkv"] * np.float32(300)}  # attention to single places
    assert all(np.isfinite(x).all() for x in lm_scoring.gradients(steep, prior.classes, places, target, weight)[0].values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_attention_helps_on_held_out_text(spark):
    fitted = lm_scoring.Fitted(spark.read.parquet(f"{DATA}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    held = [np.frombuffer(r["ids"], fitted.kind) for r in fitted.texts.where("not train").select("ids").collect()]
    learned, prior = (lm_scoring.Scorer(w, fitted.prior).texts(held).sum() for w in (fitted.weights, lm_scoring.fresh_weights()))
    assert len(held) > 100 and learned > 0.98 * prior  # log probabilities: the nearer to 0 the better


def test_lm_of_nothing(spark):
    assert lm_scoring.lm_scores(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# --- WARC

def page_rows():
    html = ["<p>one</p>", "<p>zwei ü</p>", "", None]
    rows = [(k, f"http://Host{k % 3}.example.com/p/{k}?q={k % 2}#f", html[k % 4]) for k in range(24)]
    return rows + [(30, None, "<p>one</p>"), (None, "http://a.b/", "<p>one</p>"), (31, "no url\r\nhere", "x" * 100_000), (31, "no url\r\nhere", "x" * 100_000), (5, "http://other.example/", "<p>own</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "key": F.lit(1)}).repartition(3)
    archives, index = fresh_path(spark, "archives"), fresh_path(spark, "index")
    warc.write_archives(pages, archives, least, archive_bytes=2000)
    warc.write_index(spark, archives, index, block_lines=4)
    top = {}
    for p, _, h in rows:
        if p is not None:
            top[h or ""] = max(p, top.get(h or "", p))
    got = warc.read_archives(spark, archives).collect()
    assert len(got) == len(rows) == warc.read_index(spark, index).count()
    seen = Counter()
    for r in got:
        h = next(h or "" for p, u, h in rows if p == r["page_id"] and warc.url_key(warc._field(u or "")) == r["url_key"])
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        if len(h.encode()) < least:
            assert r["record_type"] == "response"
            continue
        seen[h, r["record_type"]] += 1
        assert r["refers_to"] == (None if r["record_type"] == "response" else top[h])
        if r["record_type"] == "response":
            assert r["page_id"] == top[h]
    assert all(seen[h, "response"] == 1 for h in top if len(h.encode()) >= least)
    by_index = warc.look_up(pages, archives, index)
    assert sorted(map(repr, by_index.collect())) == sorted(map(repr, got))
    look = warc.CaptureIndex(spark, archives, index)
    (fields, payload), = look.get("http://host1.example.com/p/1?q=1")
    assert fields["X-Page-ID"] == "1" and (fields["WARC-Type"] == "revisit") == (payload == b"")
    assert look.get("http://nowhere.example/") == [] and len(look.get("no url\r\nhere")) == 2
    assert {f["X-Page-ID"] for k in range(24) for f, _ in look.get(rows[k][1])} >= {str(k) for k in range(24)}


def test_one_look_up_reads_little(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}.example/", f"<p>{k}</p>" * 50) for k in range(400)], "page_id long, url string, html string")
    archives, index = fresh_path(spark, "archives"), fresh_path(spark, "index")
    warc.write_archives(pages, archives, archive_bytes=20_000)
    warc.write_index(spark, archives, index, block_lines=16)
    look = warc.CaptureIndex(spark, archives, index)
    (fields, payload), = look.get("http://h77.example/")
    assert payload == b"<p>77</p>" * 50 and look.bytes_read < 4000


def test_url_key_column_is_the_function(spark):
    urls = ["http://A.b.Com:80/x?y#z", "https://u:p@h.org", "nothing", "", "ftp://x/", "http://h?q=1"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key_column(F.col("u"))).collect()
    assert [r[0] for r in got] == [warc.url_key(u) for u in urls]


def test_warc_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives, index = fresh_path(spark, "archives"), fresh_path(spark, "index")
    warc.write_archives(pages, archives)
    warc.write_index(spark, archives, index)
    assert warc.read_archives(spark, archives).count() == 0 and warc.read_index(spark, index).count() == 0


def test_look_ups_read_one_block_and_one_record(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 9}.org/p{k:03d}", f"text {k} " * 20) for k in range(200)] + [(900 + k, "http://h3.org/hot", f"hot {k}") for k in range(60)], "page_id long, url string, html string")
    archives, index = fresh_path(spark, "archives"), fresh_path(spark, "captures")
    warc.write_archives(pages, archives, archive_bytes=3000)
    warc.write_index(spark, archives, index, block_lines=8)
    rows = spark.read.parquet(f"{index}/directory").collect()
    for file in {r["file"] for r in rows}:
        own = sorted((r["first_key"].encode(), r["offset"], r["length"]) for r in rows if r["file"] == file)
        reader = warc.RangeReader(f"{index}/blocks")
        key = own[len(own) // 2][0].decode()
        (found,) = [f for f in warc.positions([key], own, file, reader)][-1:]
        # the block that begins with the key, and the one before, which may end with it
        assert reader.bytes_read == sum(own[k][2] for k in warc.around([d[0] for d in own], key.encode())) and found
        records = warc.RangeReader(archives)
        for name, offset, length in found:
            ((_, _, content),) = warc.members(records.read(name, offset, length))
            assert warc.url_key(warc.parsed(content)[0]["WARC-Target-URI"]) == key
        assert records.bytes_read == sum(n for _, _, n in found)
    plan = warc.look_up(pages, archives, index)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "Join" not in plan
    some = spark.createDataFrame([("http://h3.org/hot",), ("https://u@h4.org:80/p004#x",), ("http://none.org/",), (None,)], "url string")
    got = sorted(r["page_id"] for r in warc.look_up(some, archives, index).collect())
    assert got == [4, *range(900, 960)]
    with pytest.raises(ValueError, match="ends within"):
        warc.RangeReader(archives).read(spark.read.format("binaryFile").load(archives).first()["path"].rsplit("/", 1)[1], 0, 1 << 30)


def test_operators_equal_their_sql_with_nulls_and_repeats(spark):
    """Nulls, revisits, repeated rows and a very long text, through the SQL of op4 and op5."""
    path = fresh_path(spark, "tables")
    long = " ".join(f"w{k % 977}" for k in range(6000))
    every = [*texts(20), *[t for t in ODD if "\x1c" not in (t or "") and "\x85" not in (t or "")], long]
    rows = [(k, t, "en", f"s{k % 6}", len(t or "")) for k, t in enumerate(every)] + [(3, every[3], "en", "s3", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    html = ["<a>", "<b>" * 5000, None, ""]
    spark.createDataFrame([(k, f"http://h{k % 4}.org/{k % 7}" if k % 5 else None, html[k % 4] if k % 3 else f"<p>{k}") for k in range(60)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"create view {name} as select * from '{path.removeprefix('file://')}/{name}.parquet/*.parquet'")
    for query, sql in ((quality_rules.op4_quality_rules, quality_rules.OP4_SQL), (warc.op5_warc, warc.OP5_SQL)):
        got = query(spark, path)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(f"select {', '.join(got.columns)} from ({sql})").fetchall(), key=repr)


def test_very_long_texts_are_scored_whole(spark):
    long = "good words of a long text " * 40_000
    docs = documents(spark, rows=[(k, t, "en", "s", 1) for k, t in enumerate(texts(40))] + [(500, long, "en", "s", 1), (501, "\n".join([long] * 2), "en", "t", 1)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    weights = quality_classifier.fit(docs, labels)
    assert 0 <= quality_classifier.score(weights, long) <= 1
    assert quality_classifier.score(weights, long + " ".join(texts(40)[1:40:2])) != quality_classifier.score(weights, long)
    assert line_dedup.drop_boilerplate(docs).where("doc_id = 501 and length(text) > 2000000").count() == 1
