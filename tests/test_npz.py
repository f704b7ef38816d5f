"""Matrices in NumPy archives, stored and deflated, against the dense matrix."""

from __future__ import annotations

import numpy as np
import pytest

from ploidyforge.sources import npz, readers


def archive(path, dense, save, drop_last=False):
    g, c = np.nonzero(dense)
    order = np.lexsort((g, c))
    g, c = g[order], c[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=dense.shape[1]))])
    data = dense[g, c].astype("uint16")
    save(path, data=data[:-1] if drop_last else data, indices=g.astype("uint16"), indptr=ends.astype("uint16"), shape=np.array(dense.shape), genes=np.array([f"g{k}" for k in range(dense.shape[0])], str), cells=np.array([f"Zelle ü{k}" for k in range(dense.shape[1])], str))
    return str(path)


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archive_equals_matrix(spark, tmp_path, monkeypatch, save):
    monkeypatch.setattr(npz, "TASK_ENTRIES", 37)
    dense = np.random.default_rng(3).poisson(0.4, (40, 23))
    dense[:, [0, 7, 8, 22]] = 0  # columns without entries, at both ends too
    path = archive(tmp_path / "m.npz", dense, save)
    spans = npz.ranges(path)
    assert (len(spans) > 3) == (save is np.savez) and spans[-1][1] == np.count_nonzero(dense)
    for place in (path, f"file://{path}"):
        counts, genes, cells = readers.read_npz(spark, place, "b")
        got = np.zeros(dense.shape)
        for r in counts.collect():
            got[r["gene_idx"], r["cell_idx"]] = r["umi"]
        assert (got == dense).all() and {r["batch"] for r in counts.select("batch").distinct().collect()} == {"b"}
        assert [tuple(r) for r in genes.orderBy("gene_idx").collect()] == [(k, f"g{k}") for k in range(40)]
        assert [tuple(r) for r in cells.orderBy("cell_idx").collect()] == [("b", k, f"Zelle ü{k}") for k in range(23)]


def test_stretches_of_a_task(spark, tmp_path, monkeypatch):
    dense = np.random.default_rng(4).poisson(0.4, (30, 9))
    with npz._archive(archive(tmp_path / "m.npz", dense, np.savez_compressed)) as held:
        monkeypatch.setattr(npz, "ENTRIES", 5)
        parts = list(npz.Member(held, "data").stretches(0, 23))
    assert [len(p) for p in parts] == [5, 5, 5, 5, 3]


def test_no_entries_and_arrays_that_do_not_fit(spark, tmp_path):
    path = archive(tmp_path / "e.npz", np.zeros((3, 2), int), np.savez)
    counts, genes, cells = readers.read_npz(spark, path)
    assert (counts.count(), genes.count(), cells.count()) == (0, 3, 2)
    bad = archive(tmp_path / "f.npz", np.ones((3, 2), int), np.savez_compressed, drop_last=True)
    with pytest.raises(Exception, match="fit together"):
        readers.read_npz(spark, bad)[0].count()
