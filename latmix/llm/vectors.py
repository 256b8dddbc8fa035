"""What the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def usable(x: Column) -> Column:
    """Whether a vector is not null, has no null or non-finite component, and isn't zero."""
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v.cast("double")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of one length as a float64 matrix, from an Arrow list column."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows at length 1. They are brought to a largest component of 1 first: squares of huge or tiny ones are no numbers."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def second_moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By vector length: how many unit vectors x there are, and the sum of x x'. rows: (x array<double>).

    One square matrix for each task and length is all that moves.
    """

    def sums(batches):
        import pyarrow as pa

        total: dict[int, list] = {}
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column("x")])
            for d in np.unique(lengths):
                m = matrix(batch.column("x").filter(pa.array(lengths == d)))
                m = unit(m)
                got = total.setdefault(int(d), [0, np.zeros((d, d))])
                got[0] += len(m)
                got[1] += m.T @ m
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1].tobytes() for v in total.values()], pa.binary())], names=["d", "n", "s"]
        )

    out: dict[int, tuple[int, np.ndarray]] = {}
    for d, n, s in rows.select("x").mapInArrow(sums, "d int, n long, s binary").toLocalIterator():
        had = out.get(d, (0, np.zeros((d, d))))
        out[d] = had[0] + n, had[1] + np.frombuffer(s).reshape(d, d)
    return out
