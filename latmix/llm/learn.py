"""Small models trained with numpy on a bounded sample of labelled rows, and what they share."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Most labelled rows that a model is fitted on; beyond it the rows least by hash are taken.
SAMPLE = 20_000


def sample_labels(labels: DataFrame, cols: list[str], most: int = SAMPLE, where=None) -> DataFrame:
    """(doc_id, *cols), at most ``most`` rows: one per doc_id, rows with a null dropped, least hashes first.

    Of several rows of a document the least is taken.
    """
    rows = labels.select("doc_id", *cols).dropna()
    rows = rows.where(where) if where is not None else rows
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*cols)).alias("y")).select("doc_id", "y.*")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_labels(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample's documents. The sample is bounded by its parameter, so it is broadcast."""
    return docs.join(F.broadcast(sample), "doc_id")


def texts(batch):
    """(ids, texts) of an Arrow batch with doc_id and text; null texts are empty. One text at a time."""
    for i, t in zip(batch.column("doc_id"), batch.column("text")):
        yield i.as_py(), t.as_py() or ""


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _sums(values: np.ndarray, of: np.ndarray, ends: np.ndarray, runs: int = 1 << 11) -> np.ndarray:
    """Sums of runs of values[of], one after the other; a run may be empty. So many runs are gathered at once."""
    out = np.zeros(len(ends) - 1)
    for a in range(0, len(out), runs):
        part = ends[a : a + runs + 1]
        some = np.flatnonzero(np.diff(part))
        if len(some):
            out[a + some] = np.add.reduceat(values[of[part[0] : part[-1]]], part[some] - part[0])
    return out


class Rows:
    """Rows of a few present columns out of ``width``, followed by dense columns and a column of ones.

    Entries are held by row and by column, so that both products are sums of runs. Products with the
    few dense columns are not left to BLAS, whose threads would wait for each other.
    """

    def __init__(self, found: list[np.ndarray], width: int, dense: np.ndarray):
        self.width, self.dense = width, dense.astype(float)
        self.col = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
        self.row_ends = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int64)
        self._by_column(np.repeat(np.arange(len(found), dtype=np.int32), np.diff(self.row_ends)))

    def _by_column(self, row: np.ndarray) -> None:
        self.row = row[np.argsort(self.col, kind="stable")]
        self.col_ends = np.append(0, np.cumsum(np.bincount(self.col, minlength=self.width))).astype(np.int64)

    @property
    def columns(self) -> int:
        return self.width + self.dense.shape[1] + 1

    def times(self, w: np.ndarray) -> np.ndarray:
        return _sums(w, self.col, self.row_ends) + np.einsum("ij,j->i", self.dense, w[self.width : -1]) + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transpose times r."""
        return np.concatenate([_sums(r, self.row, self.col_ends), np.einsum("ij,i->j", self.dense, r), [r.sum()]])

    def squares(self, h: np.ndarray) -> np.ndarray:
        """The diagonal of the transpose times diag(h) times itself."""
        return np.concatenate([_sums(h, self.row, self.col_ends), h @ self.dense**2, [h.sum()]])

    def corner(self, h: np.ndarray) -> np.ndarray:
        """The dense columns' part of the transpose times diag(h) times itself."""
        d = np.column_stack([self.dense, np.ones(len(h))])
        return (d * h[:, None]).T @ d

    def only(self, used: np.ndarray) -> Rows:
        """Without the sparse columns that are not used; places stay."""
        out, live = object.__new__(Rows), used[self.col]
        out.width, out.dense, out.col = self.width, self.dense, self.col[live]
        out.row_ends = np.append(0, np.cumsum(live))[self.row_ends]
        out._by_column(np.repeat(np.arange(len(self.dense), dtype=np.int32), np.diff(out.row_ends)))
        return out

    def plus(self, column: np.ndarray) -> Rows:
        """With one more dense column."""
        out = object.__new__(Rows)
        out.width, out.col, out.row, out.row_ends, out.col_ends = self.width, self.col, self.row, self.row_ends, self.col_ends
        out.dense = np.column_stack([self.dense, column])
        return out


def fit_logistic(x: Rows, y: np.ndarray, used: np.ndarray | None = None, start: np.ndarray | None = None, ridge: float = 0.3, least: float = 1e-6) -> np.ndarray:
    """Weights (the last one is the intercept) of a ridge logistic model of the used rows.

    Newton's method until no entry of the gradient is over ``least`` a row; the loss is convex, so the
    weights approach those of its only minimum, wherever they start. Steps are solved by conjugate
    gradients over the sparse rows.
    """
    used = np.ones(len(y)) if used is None else used.astype(float)
    y = np.where(used > 0, y, 0.0)
    n, hits = used.sum(), y.sum()
    w = np.zeros(x.columns)
    if hits in (0, n):
        rate = (hits + 0.5) / (n + 2)  # without rows: nothing is flagged
        w[-1] = np.log(rate / (1 - rate))
        return w
    w[-1] = np.log(hits / (n - hits))
    w = w if start is None else start.copy()
    penalty = np.append(np.full(len(w) - 1, ridge), 0.0)
    loss = lambda w, z: used @ (np.logaddexp(0, z) - y * z) + penalty @ w**2 / 2
    z = x.times(w)
    now = loss(w, z)
    while True:
        p = sigmoid(z)
        g = x.back(used * (p - y)) + penalty * w
        if np.abs(g).max() <= least * n:
            return w
        h = used * p * (1 - p)
        step = _solve(lambda v: x.back(h * x.times(v)) + penalty * v, -g, x.squares(h) + penalty, x.corner(h) + np.diag(penalty[x.width :]))
        by = x.times(step)
        t = 1.0
        while not (new := loss(w + t * step, z + t * by)) < now and t > 1e-9:
            t /= 2
        if not new < now:  # as near as doubles come
            return w
        w, z, now = w + t * step, z + t * by, new


def _solve(apply, b: np.ndarray, diagonal: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Conjugate gradients, to a tenth of b; preconditioned by the diagonal, and by the dense columns' corner as a whole."""
    at = len(b) - len(corner)
    corner = np.linalg.pinv(corner, hermitian=True)
    near = lambda r: np.concatenate([r[:at] / diagonal[:at], corner @ r[at:]])
    x, r = np.zeros(len(b)), b.copy()
    q = near(r)
    d, rho = q.copy(), r @ q
    end = 0.1 * np.linalg.norm(b)
    for _ in range(10 * len(b)):
        a = apply(d)
        alpha = rho / (d @ a)
        x, r = x + alpha * d, r - alpha * a
        if np.linalg.norm(r) <= end:
            break
        q = near(r)
        rho, old = r @ q, rho
        d = q + rho / old * d
    return x


def fold_of(doc_id, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability at which rows with a greater one make the best F1 score; 0.5 where one class is missing."""
    if len(y) == 0 or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # no cut within equal probabilities
    k = int(np.argmax(f1))
    return float((p[k] + p[min(k + 1, len(p) - 1)]) / 2)
