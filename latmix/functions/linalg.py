"""Small dense linear algebra on the driver, and the same on array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def logdet(a: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(a)
    if sign <= 0:
        raise ValueError("matrix is not positive definite")
    return float(value)


def load_diag(a: np.ndarray, least: float = 1e-5) -> np.ndarray:
    """The matrix with the least of ten loads on its diagonal at which its eigenvalues' ratio is ``least`` or more.

    Loads are those of steps of 1e-7, 1e-6, ... times the largest diagonal element at the time, added
    up: after k steps that element has grown by the product of (1 + step).
    """
    w = np.linalg.eigvalsh((a + a.T) / 2)
    loads = np.append(0.0, np.cumprod(1 + 10.0 ** np.arange(-7, 3)) - 1) * max(np.diag(a).max(), 1e-300)
    fit = np.flatnonzero(w.min() + loads >= least * (w.max() + loads))
    return a + loads[fit[0] if len(fit) else -1] * np.eye(len(a))


def threshold_eig(a: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((a + a.T) / 2)
    return (v * np.maximum(w, w.max() * np.finfo(np.float32).eps)) @ v.T


def inverse(a: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((a + a.T) / 2)
    return (v / np.maximum(w, w.max() * np.finfo(float).eps)) @ v.T


def sym_indices(n: int) -> np.ndarray:
    """n x n map to packed positions (from 0): the diagonal first, then the rows of the upper triangle.

    Row r of the triangle starts after the rows above it, which hold n - 1, n - 2, ... elements.
    """
    row, col = np.indices((n, n))
    low, high = np.minimum(row, col), np.maximum(row, col)
    return np.where(row == col, row, n + low * n - low * (low + 1) // 2 + high - low - 1)


def unpack(x: Column, n: int) -> Column:
    """The n x n matrix of a packed symmetric one."""
    at = _el(x, n, n, True, False)
    return F.array(*(at(i, j) for i in range(n) for j in range(n)))


def sym_size(packed: int) -> int:
    return int((np.sqrt(8 * packed + 1) - 1) / 2)


# array columns: matrices as flat row-major arrays, symmetric ones packed ---------------------------
def _el(x: Column, rows: int, cols: int, sym: bool, trans: bool):
    index = sym_indices(rows) if sym else None

    def at(i: int, j: int) -> Column:
        if trans:
            i, j = j, i
        return F.get(x, F.lit(int(index[i, j]) if sym else i * cols + j))

    return at


def matmul(a: Column, b: Column, n: int, m: int, p: int, sym_a=False, sym_b=False, trans_a=False) -> Column:
    """(n x m) (m x p), as unrolled sums that stay in generated code."""
    ea = _el(a, *((m, n) if trans_a else (n, m)), sym_a, trans_a)
    eb = _el(b, m, p, sym_b, False)
    total = lambda i, j: sum((ea(i, k) * eb(k, j) for k in range(1, m)), ea(i, 0) * eb(0, j))
    return F.array(*(total(i, j) for i in range(n) for j in range(p)))


def matvec(a: Column, v: Column, n: int, m: int, sym=False, trans=False) -> Column:
    return matmul(a, v, n, m, 1, sym_a=sym, trans_a=trans)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def transpose(a: Column, n: int, m: int) -> Column:
    return F.array(*(F.get(a, F.lit(i * m + j)) for j in range(m) for i in range(n)))


def det3(a: Column, sym=False) -> Column:
    e = _el(a, 3, 3, sym, False)
    return e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)) - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0)) + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0))


def inv3(a: Column, sym=False) -> Column:
    """3 x 3 inverse by cofactors; of a packed matrix, packed."""
    e, d = _el(a, 3, 3, sym, False), det3(a, sym)

    def cof(i, j):
        r, c = [k for k in range(3) if k != j], [k for k in range(3) if k != i]
        return (1.0 if (i + j) % 2 == 0 else -1.0) * (e(r[0], c[0]) * e(r[1], c[1]) - e(r[0], c[1]) * e(r[1], c[0])) / d

    if sym:
        place = {int(sym_indices(3)[i, j]): (i, j) for i in range(3) for j in range(i, 3)}
        return F.array(*(cof(*place[k]) for k in range(6)))
    return F.array(*(cof(i, j) for i in range(3) for j in range(3)))


def logsumexp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.coalesce(F.exp(v - top), F.lit(0.0))))


def softmax(x: Column, log_prop: Column | None = None) -> Column:
    z = x if log_prop is None else F.zip_with(x, log_prop, lambda a, b: a + b)
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.transform(z, lambda v: F.exp(v - top) / total)
