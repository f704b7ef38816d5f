"""The Matrix Market data source against the line reader and plain forms."""

from __future__ import annotations

import io
import random

import pytest
from pyspark.sql import functions as F

from ploidyforge.sources import matrix_market, readers


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    rnd = random.Random(4)
    places = rnd.sample([(g, c) for g in range(60) for c in range(50)], 900)
    entries = [(g, c, float(rnd.randint(1, 9)) if k % 5 else 1.5) for k, (g, c) in enumerate(sorted(places, key=lambda p: (p[1], p[0])))]
    path = tmp_path_factory.mktemp("mtx") / "m.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n% a note\n%\n60 50 900\n" + "".join(f"{g + 1}{' ' if g % 2 else '  '}{c + 1}\t{u:g}\n" for g, c, u in entries))
    return path, entries


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_every_line_lies_in_one_split(file, split):
    path, entries = file
    data = path.read_bytes()
    first, fields, shape = matrix_market.head(io.BytesIO(data))
    assert (fields, shape) == (3, (60, 50, 900))
    got = b"".join(b"".join(matrix_market.whole_lines(io.BytesIO(data), at, min(at + split, len(data)), first)) for at in range(first, len(data), split))
    assert got == data[first:]


def test_pieces_end_between_lines(file, monkeypatch):
    path, _ = file
    data = path.read_bytes()
    first = matrix_market.head(io.BytesIO(data))[0]
    for piece in (3, 11, 100):
        monkeypatch.setattr(matrix_market, "PIECE_BYTES", piece)
        parts = [list(matrix_market.whole_lines(io.BytesIO(data), at, min(at + 500, len(data)), first)) for at in range(first, len(data), 500)]
        assert b"".join(b"".join(p) for p in parts) == data[first:] and all(p.endswith(b"\n") for q in parts for p in q)


def test_source_equals_the_line_reader(spark, file, tmp_path):
    path, entries = file
    got = matrix_market.read_entries(spark, str(path), split_bytes=700)
    assert got.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, got.collect())) == sorted(entries)
    (tmp_path / "g.txt").write_text("".join(f"G{k}\n" for k in range(60)))
    (tmp_path / "c.txt").write_text("".join(f"C{k}\n" for k in range(50)))
    counts = readers.read_mtx(spark, str(path), str(tmp_path / "g.txt"), str(tmp_path / "c.txt"))[0]
    assert sorted(map(tuple, readers.from_triplets(got).collect())) == sorted(map(tuple, counts.collect()))


def test_ranges_of_genes_reach_the_tasks(spark, file):
    path, entries = file
    want = sorted(e for e in entries if 10 <= e[0] < 20)
    assert sorted(map(tuple, matrix_market.read_entries(spark, str(path), (10, 20), 700).collect())) == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = matrix_market.read_entries(spark, str(path), split_bytes=700).where((F.col("gene_idx") >= 10) & (F.col("gene_idx") < 20) & (F.col("umi") > 1))
        assert sorted(map(tuple, pushed.collect())) == [e for e in want if e[2] > 1]
        one = matrix_market.read_entries(spark, str(path)).where("gene_idx = 7")
        assert sorted(map(tuple, one.collect())) == sorted(e for e in entries if e[0] == 7)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = matrix_market.PushingReader({"path": str(path)})
    left = list(reader.pushFilters([matrix_market.GreaterThan(("gene_idx",), 4), matrix_market.LessThanOrEqual(("gene_idx",), 9), matrix_market.EqualTo(("umi",), 1.0)]))
    assert (reader.low, reader.high) == (5, 10) and len(left) == 1


def test_files_that_are_refused_or_empty(spark, tmp_path):
    for text, said in (("%%MatrixMarket matrix array real general\n2 2\n1\n", "coordinate"), ("%%MatrixMarket matrix coordinate real general\n", "no line of sizes"), ("%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n", "outside")):
        (tmp_path / "x.mtx").write_text(text)
        with pytest.raises(Exception, match=said):
            matrix_market.read_entries(spark, str(tmp_path / "x.mtx")).collect()
    (tmp_path / "y.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 1")
    assert [tuple(r) for r in matrix_market.read_entries(spark, str(tmp_path / "y.mtx")).collect()] == [(1, 0, 1.0)]
    (tmp_path / "z.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 0\n")
    assert matrix_market.read_entries(spark, str(tmp_path / "z.mtx")).count() == 0
