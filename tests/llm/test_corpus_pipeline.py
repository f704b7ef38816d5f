"""The pipeline over a small folder of tables, stage by stage against plain forms of its operators."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ploidyforge.llm import decontamination, quality_classifier
from ploidyforge.llm.common import fresh_path

from .samples import documents, texts
from .test_near import plain_components, plain_fingerprint, plain_matches
from .test_text import plain_dedup


@pytest.fixture(scope="module")
def folder(spark):
    import corpus_pipeline  # noqa: F401

    path = fresh_path(spark, "tables")
    shared = "This line is on a great many of the sites."
    item = " ".join(f"bench{k}" for k in range(30))
    rows = [(k, f"{t}\n{shared}", "en", f"src{k % 7}", len(t) + 1 + len(shared)) for k, t in enumerate(texts(40))]
    rows += [(100 + k, " ".join(f"w{j}q***" for j in range(60 + k)), "en", "src1", 1) for k in range(12)]  # junk
    rows += [(200, rows[3][1] + f" {item}", "en", "src2", 1), (201, rows[5][1], "en", "src3", 1), (202, rows[5][1], "en", "src4", 1), rows[6], (None, rows[9][1] + " more", None, None, None), (204, None, None, None, None), (205, "", "", "", 0)]
    documents(spark, rows=rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "never in any of the documents at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_against_plain_forms(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    weights = quality_classifier.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [r for r in rows if quality_classifier.score(weights, r[1] or "") >= 0.7]
    assert not any(r[0] is not None and 100 <= r[0] < 112 for r in rows) and len(rows) >= 45
    bad, first, key = plain_dedup(rows)
    assert bad
    rows = [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if x.strip(" ") not in bad or first[x.strip(" ")] == key(r)), r[3]) for r in rows]
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    best = {}
    for (d, t, _), root in zip(rows, plain_components(fps)):
        best.setdefault(root, []).append((d is None, d or 0, t))
    # which of several texts of one id stays is set by their hashes; ids do not repeat with other texts here
    kept = [min(g, key=lambda x: x[:2]) for g in best.values()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [(None if bare else d, t) for bare, d, t in kept if not plain_matches([(d, t)], items)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for d, t in kept:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr) == sorted(expected, key=repr)
    assert not any(d == 200 for d, *_ in expected)


def test_stages_keep_the_columns_of_documents(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and dict(docs.dtypes)["n_chars"] == "bigint"
    none = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_stage_names():
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5 and decontamination.SHINGLE == 5
