"""Vectors of integers in Arrow batches, shared by the operators on embeddings.

A component x becomes floor(scale * x), kept as a double, which holds it exactly: scales are powers of two. Sums of products are
taken in doubles where a bound shows them exact, and in Python's integers elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Whole numbers up to this are exact in doubles.
EXACT = 2**53
#: The ends of Spark's long; a result beyond them is set to the end.
LEAST, MOST = -(2**63), 2**63 - 1


def integers(column: pa.Array, scale: int, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a usable vector, and those rows' integers as a matrix.

    Left out are vectors that are null, hold a null or non-finite component or one that goes beyond long when scaled, or have other than
    ``dims`` components. Without ``dims`` shorter vectors are filled up with zeros, which add nothing to a product.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = np.asarray(column.is_valid())
    sizes = np.where(there, np.asarray(column.value_lengths().fill_null(0)), 0).astype(np.int64)
    flat = column.flatten()  # without the values behind null lists
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * float(scale))
        good = np.abs(x) < float(MOST)
    row = np.repeat(np.arange(len(sizes)), sizes)
    ok = there & (np.bincount(row[~good], minlength=len(sizes)) == 0)
    if dims is not None:
        ok &= sizes == dims
    width = dims if dims is not None else int(sizes[ok].max(initial=0))
    out = np.zeros((int(ok.sum()), width))
    take = ok[row]
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[(np.cumsum(ok) - 1)[row[take]], place[take]] = x[take]
    return ok, out + 0.0  # no negative zero


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers as a matrix of at least ``width`` columns, filled up with zeros."""
    m = integers(column, 1)[1]
    return np.pad(m, ((0, 0), (0, max(0, width - m.shape[1]))))


def objects(m: np.ndarray) -> np.ndarray:
    """The matrix in Python's integers."""
    return np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)


def norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and of ``b``: doubles where they are exact, else Python's integers."""
    if norms(a).max(initial=0) * norms(b).max(initial=0) < EXACT / 4:  # bounds every partial sum as well
        return a @ b.T
    return objects(a) @ objects(b).T


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of ``a`` and of ``b``."""
    if (norms(a).max(initial=0) + norms(b).max(initial=0)) ** 2 < EXACT / 4:
        return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    a, b = objects(a), objects(b)
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def longs(x: np.ndarray) -> pa.Array:
    """Exact whole numbers as longs, set to the ends of the range where they are beyond it."""
    if x.dtype != object:
        return pa.array(x.astype(np.int64))
    return pa.array([min(max(int(v), LEAST), MOST) for v in x], pa.int64())


def arrays(m: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A matrix as a column of lists."""
    kind = kind or pa.float64()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), kind))
