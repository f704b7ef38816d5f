"""Token counts, BPE codec and token store against the tokenizers library."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ploidyforge.llm import bpe, bpe_codec, token_counts, token_store
from ploidyforge.llm.common import fresh_path

from .samples import ODD, documents, empty, pairs, texts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
EVERY = [t or "" for t in ODD] + texts(20)
ALPHABET = st.lists(st.sampled_from([*"ab eE'sltdz1!\n\t日́éİßΣ×\x00\x1f", "th", "ing", "<|endoftext|>", "  ", "!!", "'ll", "Über.", "naïve"]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


def byte_counter():
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(BYTE))
    return bpe.WholeTokens(vocabulary, vocabulary.proven())


def word_codec(most=bpe.TABLE_BYTES):
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(WORD))
    return bpe.PrefixEncoder(vocabulary, bpe.ProvenTokens(vocabulary, vocabulary.proven()), most)


def test_whole_tokens_are_proven(byte_library):
    counter = byte_counter()
    assert len(counter.whole) > 40_000
    for piece in list(counter.whole)[::997]:
        assert len(byte_library.encode(piece, add_special_tokens=False).ids) == 1


def test_counts_equal_the_library(byte_library):
    counter = byte_counter()

    @settings(max_examples=150, deadline=None)
    @given(ALPHABET)
    def same(text):
        assert counter.count(text) == len(byte_library.encode(text, add_special_tokens=False).ids)

    same()
    for text in EVERY:
        assert counter.count(text) == len(byte_library.encode(text, add_special_tokens=False).ids)


def test_prefix_program_and_cached_library_equal_the_library(word_library):
    codec, cached = word_codec(), bpe.LibraryEncoder(bpe.read_vocabulary(WORD), 4)

    @settings(max_examples=150, deadline=None)
    @given(ALPHABET)
    def same(text):
        ids = word_library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids
        assert np.frombuffer(cached.encode(text), "<u4").tolist() == ids
        assert codec.decode(np.array(ids, "<u4").tobytes()) == word_library.decode(ids, skip_special_tokens=False)

    same()
    for text in EVERY:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_long_texts(word_library, byte_library):
    spaced, unbroken = " ".join(texts(300)), "".join(texts(40)).replace(" ", "").replace("\n", "")
    codec, cached, counter = word_codec(), bpe.LibraryEncoder(bpe.read_vocabulary(WORD), 2), byte_counter()
    for text in (spaced, unbroken, "ab" * 30_000):
        ids = word_library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids == np.frombuffer(cached.encode(text), "<u2").tolist()
        assert counter.count(text) == len(byte_library.encode(text, add_special_tokens=False).ids)


def test_tables_stay_within_their_bytes():
    work = []
    table = bpe.Memo(lambda key: work.append(key) or key.encode(), 100_000)
    for k in range(5000):
        assert table[f"key{k}"] == b"key%d" % k and table["often"] == b"often"
    assert len(table) + len(table.old) < 1000 and work.count("often") < 3
    table["x" * (bpe.KEY_BYTES)]
    assert "x" * (bpe.KEY_BYTES) not in table
    assert bpe.held(("a",), lambda: 1) == 1 and bpe.held(("b",), lambda: 2) == 2 and bpe.held(("a",), lambda: 3) == 3


def test_words_without_a_cover_are_refused():
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(WORD))
    codec = bpe.PrefixEncoder(vocabulary, bpe.ProvenTokens(vocabulary, [t for t in vocabulary.proven() if "q" not in t]))
    with pytest.raises(ValueError):
        codec.encode("quiet")


def test_suffix_automaton_finds_every_token_that_ends_at_a_place():
    import random

    rnd = random.Random(6)
    tokens = {tuple(rnd.choice((1, 2, 3)) for _ in range(rnd.randint(1, 6))): k for k in range(60)}
    found = bpe.SuffixAutomaton(tokens)
    text = [rnd.choice((1, 2, 3, 4)) for _ in range(3000)]
    state = size = 0
    for end, symbol in enumerate(text, 1):
        while (to := found.moves.get(state << found.SYMBOL_BITS | symbol)) is None and state:
            state = found.link[state]
            size = found.length[state]
        state, size = (to, size + 1) if to is not None else (0, 0)
        got, at = [], state if size == found.length[state] and found.token[state] >= 0 else found.nearest[state]
        while at:
            got.append(found.token[at])
            at = found.nearest[at]
        want = [tokens[t] for n in range(6, 0, -1) if (t := tuple(text[max(0, end - n):end])) in tokens and len(t) == n]
        assert got == want


def test_merge_forms_agree():
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(BYTE))
    for text in ("thethethe" * 30, "abcdefghij" * 20, "aaaa" * 40):
        assert vocabulary._merge_short(list(text)) == vocabulary._merge_long(list(text))


def test_count_rows(spark, byte_library):
    docs = documents(spark)
    expected = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(byte_library.encode(r["text"] or "", add_special_tokens=False).ids), n > 1024) for r in docs.collect()), key=repr)
    assert pairs(token_counts.token_counts(docs, BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.token_counts(empty(spark), BYTE).count() == 0


def test_codec_rows(spark, word_library):
    docs = documents(spark)
    expected = []
    for r in docs.collect():
        ids = word_library.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), word_library.decode(ids, skip_special_tokens=False)))
    assert pairs(bpe_codec.encode_decode(docs, WORD), "doc_id", "n_tokens", "ids_sha256", "decoded") == sorted(expected, key=repr)
    assert bpe_codec.encode_decode(empty(spark), WORD).count() == 0


@pytest.mark.parametrize("shard_ids", [150, 4_000_000])
def test_store_reads_back_what_was_written(spark, word_library, shard_ids):
    docs, path = documents(spark), fresh_path(spark, "store")
    token_store.write_token_store(docs, WORD, path, shard_ids=shard_ids)
    rows = token_store.read_token_store(spark, path).orderBy("start").collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r["doc_id"], []).append([*word_library.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    keys = [r["doc_id"] for r in rows]
    assert len(rows) == docs.count() and keys == sorted(keys, key=lambda k: -1 if k is None else k)
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in rows) == sorted((str(k), crc(x)) for k, many in ids.items() for x in many)
    store = token_store.TokenStore(spark, path)
    shards = token_store.shard_list(spark, path)
    assert shards.agg({"n_docs": "sum"}).first()[0] == len(rows)
    assert store.get(9) == ids[9] and store.get(-5) == [] and store.get(10**12) == []
    joined = [x for got in store.get(12) for x in got]
    assert sorted(joined) == sorted(x for many in ids[12] for x in many)


def test_one_look_up_reads_little(spark):
    path = fresh_path(spark, "store")
    docs = spark.createDataFrame([(k, f"document number {k} of many") for k in range(3000)], "doc_id long, text string")
    token_store.write_token_store(docs, WORD, path)
    store = token_store.TokenStore(spark, path)
    assert len(store.get(1234)[0]) == len(store.get(1235)[0])
    before = store.bytes_read
    store.get(1236)
    assert store.bytes_read - before < 100  # an entry and the ids


def test_shards_keep_their_order_whatever_the_job_is_called(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_token_store(documents(spark).coalesce(1), WORD, path, shard_ids=40)
    folder = tmp_path / "store" / "shards"
    for file in sorted(folder.glob("part-*")):
        part, counter = re.fullmatch(r"part-(\d+)-.*-c(\d+)\.txt", file.name).groups()
        turned = 999 - int(counter)  # listed by name, the shards come in the wrong order
        file.rename(folder / f"part-{part}-{turned:08d}-c1aa-4bbb-8ccc-0123456789ab-c{counter}.txt")
    shards = token_store._directory(spark, path).collect()
    assert len(shards) > 3
    in_order = sorted(shards, key=lambda r: (r["file"].split("-")[1], int(r["file"].rsplit("-c", 1)[1].split(".")[0])))
    starts = np.cumsum([0] + [r["n_ids"] for r in in_order])[:-1].tolist()
    assert [r["start"] for r in in_order] == starts


def test_store_of_nothing(spark):
    path = fresh_path(spark, "store")
    token_store.write_token_store(empty(spark), WORD, path)
    assert token_store.read_token_store(spark, path).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-2**62, 2**62, 20_000))
    function = token_store.PerfectHash.build(keys)
    again, _ = token_store.PerfectHash.unpack(function.pack(), 0)
    assert np.array_equal(np.sort(again.slots(keys)), np.arange(len(keys)))
    index = token_store.ShardIndex.build(keys, np.ones(len(keys), np.int64))
    assert (index.find(keys)["records"] == 1).all() and (index.find(keys + 1)["records"] == 0).mean() > 0.999
    with pytest.raises(ValueError):
        token_store.PerfectHash.build(np.array([1, 1]))


def test_every_prefix_has_its_last_token_stored(word_library):
    """The program's answer for a word is that of its prefixes: each prefix, ended as a word, is encoded as the library does."""
    codec = word_codec()
    for word in ("unbelievably", "internationalisation", "aaaaabab", "straßenbahn"):
        for end in range(1, len(word) + 1):
            assert np.frombuffer(codec.encode(word[:end]), "<u4").tolist() == word_library.encode(word[:end], add_special_tokens=False).ids


def test_word_table_holds_packed_ids():
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    codec = bpe.PrefixEncoder(vocabulary, bpe.ProvenTokens(vocabulary, vocabulary.proven()))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("Étude, plain (words) it's 42", "a--b ß... ", ""):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.words and all(isinstance(x, bytes) for x in codec.words.values())


def test_words_of_many_texts_are_worked_out_together(word_library):
    codec = word_codec()
    same = lambda texts_: [x.tolist() for x in codec.encode_all(pa.array(texts_, pa.string()))] == [word_library.encode(t or "", add_special_tokens=False).ids for t in texts_]

    @settings(max_examples=100, deadline=None)
    @given(st.lists(ALPHABET, max_size=5))
    def every(texts_):
        assert same(texts_)

    every()
    assert same([*ODD, *EVERY, "q" * 63, "q" * 64, "q" * 65, "é" * 40, "Ünïted×÷ÀÖØÞßÿ, (no) a,b 'tis", "x" * 200_000, None])
    assert same([]) and same([None, ""])
    before = len(codec.words) + len(codec.pairs)
    assert same([a + b + c for a in ("Straße", "over", "naïve") for b in ("zu", "Qé") for c in (",", "!?", "")])
    assert len(codec.words) + len(codec.pairs) == before  # nothing was worked out word by word


def test_pair_verdicts_are_those_of_merging():
    codec = word_codec()
    rnd = np.random.default_rng(2)
    left, right = rnd.integers(0, 49_000, 3000), rnd.integers(0, 49_000, 3000)
    got = codec.steps._work(left, right)
    assert got.tolist() == [codec._apart(int(a) << 32 | int(b)) for a, b in zip(left, right)] and not got.all() and got.any()
