"""Nodes with attrs, keys and slices like those of an HDF5 file, kept in a pickle; tasks open it by path."""

from __future__ import annotations

import pickle

import numpy as np


class Group(dict):
    def __init__(self, attrs=None, **nodes):
        super().__init__(nodes)
        self.attrs = attrs or {}


class Array:
    """A dataset that can be sliced by its first axis only, and counts the rows that were read."""

    def __init__(self, values):
        self.values, self.shape, self.attrs, self.read = np.asarray(values), np.shape(values), {"encoding-type": "array"}, 0

    def __getitem__(self, at):
        assert isinstance(at, slice)
        out = self.values[at]
        self.read += len(out)
        return out


def compressed(matrix, by_gene: bool, repeat: bool = False) -> Group:
    """A stored matrix (cells x genes); with repeat each entry is there twice, as two parts of its value."""
    rows = matrix.T if by_gene else matrix
    row, other = np.nonzero(rows)
    value = rows[row, other]
    if repeat:
        row, other, value = (np.repeat(x, 2) for x in (row, other, value / 2))
    ptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))])
    return Group({"encoding-type": b"csc_matrix" if by_gene else "csr_matrix", "shape": np.array(matrix.shape)}, data=Array(value), indices=Array(other), indptr=Array(ptr))


def categorical(labels) -> Group:
    names = sorted({x for x in labels if x is not None})
    return Group({"encoding-type": "categorical"}, categories=Array(np.array(names, object)), codes=Array([names.index(x) if x is not None else -1 for x in labels]))


def container(x, layers, cells, genes, obs) -> Group:
    index = Group({"_index": "names", "column-order": np.array(list(obs), object)}, names=Array(np.array([c.encode() for c in cells], object)), **obs)
    return Group(None, X=x, layers=Group(None, **layers), obs=index, var=Group({"_index": "id", "column-order": []}, id=Array(np.array(genes, object))))


def save(file: Group, path) -> str:
    with open(path, "wb") as f:
        pickle.dump(file, f)
    return str(path)


def load(path: str) -> Group:
    with open(path, "rb") as f:
        return pickle.load(f)
