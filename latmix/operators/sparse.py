"""Sparse differential operators on lattices, as (row, col, val) tables.

Rows and columns are linear indices from 0, the first dimension fastest, components stacked after
the lattice. Operators are built from arithmetic on ``spark.range``; products are a join and a sum.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CIRCULANT, NEUMANN, DIRICHLET = "circulant", "neumann", "dirichlet"
DEFAULT_PARAM = (1e-4, 1e-3, 0.2, 0.05, 0.2)


def _coordinate(index: Column, lat, d: int) -> Column:
    return F.pmod(F.floor(index / F.lit(math.prod(lat[:d]))), F.lit(lat[d])).cast("long")


def gradient(spark: SparkSession, lat, vs, d: int, direction: int = 1, bnd: str = NEUMANN) -> DataFrame:
    """One-sided difference along dimension d (direction +1 or -1), or their mean (0)."""
    n, step, size = math.prod(lat), math.prod(lat[:d]), lat[d]
    if direction == 0:
        halves = [gradient(spark, lat, vs, d, s, bnd).withColumn("val", F.col("val") / 2) for s in (1, -1)]
        return add(*halves)
    row = spark.range(n).select(F.col("id").alias("row"))
    c = _coordinate(F.col("row"), lat, d)
    there = c + direction
    inside = (there >= 0) & (there < size)
    scale = float(direction) / float(vs[d])
    self_val, other_val = F.lit(-scale), F.lit(scale)
    other = F.col("row") + direction * step
    if bnd == CIRCULANT:
        other = F.col("row") + (F.pmod(there, F.lit(size)) - c) * step
        ok_self = ok_other = F.lit(True)
    elif bnd == NEUMANN:
        ok_self = ok_other = inside
    elif bnd == DIRICHLET:
        ok_self, ok_other = F.lit(True), inside
    else:
        raise ValueError(f"unknown boundary {bnd}")
    at = lambda col, val, ok: row.where(ok).select("row", col.cast("long").alias("col"), val.alias("val"))
    return add(at(F.col("row"), self_val, ok_self), at(other, other_val, ok_other))


def add(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("row", "col").agg(F.sum("val").alias("val")).where("val <> 0")


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("val", F.col("val") * F.lit(float(by)))


def shift(a: DataFrame, rows: int = 0, cols: int = 0) -> DataFrame:
    return a.select((F.col("row") + rows).alias("row"), (F.col("col") + cols).alias("col"), "val")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("row").alias("__k"), F.col("col").alias("__c"), F.col("val").alias("__v"))
    return a.join(right, F.col("col") == F.col("__k")).groupBy("row", F.col("__c").alias("col")).agg(F.sum(F.col("val") * F.col("__v")).alias("val")).where("val <> 0")


def spmv(a: DataFrame, v: DataFrame) -> DataFrame:
    """(idx, v) = a * v, v: (idx, v)."""
    return a.join(v.select(F.col("idx").alias("col"), "v"), "col").groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("val") * F.col("v")).alias("v"))


def jacobian(spark, lat, vs, vec_dim: int = 1, direction: int = 1, bnd: str = NEUMANN) -> DataFrame:
    """Rows: component, then derivative, stacked lattices; columns: component lattices."""
    n, d = math.prod(lat), len(lat)
    return add(*(shift(gradient(spark, lat, vs, j, direction, bnd), (c * d + j) * n, c * n) for c in range(vec_dim) for j in range(d)))


def second(spark, lat, vs, i, j, direction=1, bnd=NEUMANN) -> DataFrame:
    """Minus the product of a one-sided difference with the adjoint of the other one."""
    return scale(multiply(transpose(gradient(spark, lat, vs, i, direction, bnd)), gradient(spark, lat, vs, j, direction, bnd)), -1)


def hessian(spark, lat, vs, vec_dim=1, direction=1, bnd=NEUMANN) -> DataFrame:
    n, d = math.prod(lat), len(lat)
    pairs = list(itertools.product(range(d), range(d)))
    return add(*(shift(second(spark, lat, vs, i, j, direction, bnd), (c * d * d + k) * n, c * n) for c in range(vec_dim) for k, (i, j) in enumerate(pairs)))


def laplacian(spark, lat, vs, direction=1, bnd=NEUMANN, stacked: bool = False) -> DataFrame:
    """Sum of the second derivatives; stacked: side by side."""
    n = math.prod(lat)
    return add(*(shift(second(spark, lat, vs, i, i, direction, bnd), 0, i * n if stacked else 0) for i in range(len(lat))))


def divergence(spark, lat, vs, direction=1, bnd=NEUMANN) -> DataFrame:
    n = math.prod(lat)
    return add(*(shift(gradient(spark, lat, vs, i, direction, bnd), 0, i * n) for i in range(len(lat))))


def symmetric_jacobian(spark, lat, vs, direction=1, bnd=NEUMANN) -> DataFrame:
    """Rows (i, j): half of d_j v_i + d_i v_j."""
    n, d = math.prod(lat), len(lat)
    parts = []
    for i, j in itertools.product(range(d), range(d)):
        row = (i * d + j) * n
        parts += [scale(shift(gradient(spark, lat, vs, j, direction, bnd), row, i * n), 0.5), scale(shift(gradient(spark, lat, vs, i, direction, bnd), row, j * n), 0.5)]
    return add(*parts)


def euclidean(spark, lat, vs) -> DataFrame:
    n = math.prod(lat)
    return add(*(spark.range(n).select((F.col("id") + i * n).alias("row"), (F.col("id") + i * n).alias("col"), F.lit(float(v)).alias("val")) for i, v in enumerate(vs)))


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))


def stencil(n: int, vs: float, direction: int, bnd: str) -> np.ndarray:
    """One-sided difference along a line of n voxels."""
    out = np.zeros((n, n))
    for c in range(n):
        there = c + direction
        if bnd == CIRCULANT:
            there %= n
        inside = 0 <= there < n
        if inside or bnd == DIRICHLET:
            out[c, c] -= direction / vs
        if inside:
            out[c, there] += direction / vs
    return out


#: A line this long has every kind of row: three at each edge and those between, which are alike.
LINE = 7


def _by_class(matrix: np.ndarray, wraps: bool) -> np.ndarray:
    """classes x (2 LINE - 1): a line matrix by class of row and offset of column."""
    m = len(matrix)
    out = np.zeros((m, 2 * LINE - 1))
    for k, j in zip(*np.nonzero(matrix)):
        o = (j - k + m // 2) % m - m // 2 if wraps else j - k
        out[k, o + LINE - 1] += matrix[k, j]
    return out


def stencils(spark: SparkSession, lat, blocks: dict, bnd: str) -> DataFrame:
    """(row, col, val) of sums of products over dimensions of line matrices.

    blocks: (row component, column component) -> list of ({dimension: line matrix}, factor), the
    matrices for lines of min(LINE, side) voxels with bands of at most two on each side; identity where
    none is given. All terms of a block are added here, for every class of row: the table of classes
    and offsets is bounded by LINE, whatever the lattice, and every row looks its entries up in it, so
    nothing is shuffled.
    """
    d, n = len(lat), math.prod(lat)
    small = [min(LINE, x) for x in lat]
    wraps = [bnd == CIRCULANT and x > LINE for x in lat]
    unit = [_by_class(np.eye(m), w) for m, w in zip(small, wraps)]
    entries = []
    for (c, e), terms in blocks.items():
        total = 0.0
        for lines, by in terms:
            part = np.full((1, 1), by)
            for i in range(d):  # classes of the first dimensions x offsets of these
                part = np.kron(_by_class(lines[i], wraps[i]) if i in lines else unit[i], part)
            total = total + part
        if np.ndim(total):
            rows, cols = np.nonzero(np.abs(total) > 1e-300)
            entries.append((np.full(len(rows), c), np.full(len(rows), e), rows, cols, total[rows, cols]))
    names = ["c", "kind", "e", "offset", "val"]
    schema = "c long, kind long, e long, offset long, val double"
    if not entries:
        return spark.createDataFrame([], "row long, col long, val double")
    import pandas as pd

    c, e, kind, offset, val = (np.concatenate(x) for x in zip(*entries))
    table = spark.createDataFrame(pd.DataFrame(dict(zip(names, (c, kind, e, offset, val)))), schema)
    rows = spark.range(n * max(c + 1)).select(F.col("id").alias("row"), F.expr(f"id div {n}").alias("c"), F.pmod("id", F.lit(n)).alias("voxel"))
    kind, step = F.lit(0).cast("long"), 1
    for i, m in enumerate(small):
        at = _coordinate(F.col("voxel"), lat, i)
        own = at if lat[i] <= LINE else F.when(at < LINE // 2, at).when(at >= lat[i] - LINE // 2, at - lat[i] + LINE).otherwise(LINE // 2)
        kind, step = kind + own * step, step * m
    met = rows.withColumn("kind", kind).join(F.broadcast(table), ["c", "kind"])  # bounded by LINE
    col = F.col("e") * n
    for i in range(d):
        o = F.pmod(F.expr(f"offset div {(2 * LINE - 1) ** i}"), F.lit(2 * LINE - 1)) - (LINE - 1)
        there = _coordinate(F.col("voxel"), lat, i) + o
        col = col + (F.pmod(there, F.lit(lat[i])) if wraps[i] else there) * math.prod(lat[:i])
    return met.select("row", col.cast("long").alias("col"), "val")


def precision(spark, lat, vs, param=DEFAULT_PARAM, bnd: str = NEUMANN, diffeo: bool = False) -> DataFrame:
    """Regulariser of a displacement field: absolute, membrane, bending and linear-elastic terms.

    Derivative terms are means over the one-sided directions of each dimension; as the directions of
    different dimensions are independent, every term is a product over dimensions of line matrices.
    """
    d = len(lat)
    absolute, membrane, bending, mu, lam = param
    sides = [[stencil(min(LINE, lat[i]), vs[i], s, bnd) for s in (1, -1)] for i in range(d)]
    mean = [sum(g) / 2 for g in sides]
    square = [sum(g.T @ g for g in gs) / 2 for gs in sides]
    fourth = [sum((g.T @ g) @ (g.T @ g) for g in gs) / 2 for gs in sides]
    blocks = {}
    for c in range(d):
        for e in range(d):
            terms = []
            if c == e:
                if absolute:
                    terms.append(({}, absolute))
                for i in range(d):
                    if membrane + mu:  # 2 mu |sym J|^2 = mu (|J|^2 + sum of J_ij J_ji)
                        terms.append(({i: square[i]}, membrane + mu))
                    if bending:
                        terms += [({i: fourth[i]} if i == j else {i: square[i], j: square[j]}, bending) for j in range(d)]
                if mu + lam:
                    terms.append(({c: square[c]}, mu + lam))
            else:
                if mu:
                    terms.append(({e: mean[e].T, c: mean[c]}, mu))
                if lam:
                    terms.append(({c: mean[c].T, e: mean[e]}, lam))
            blocks[c, e] = [(lines, by * (vs[c] * vs[e] if diffeo else 1.0)) for lines, by in terms]
    return stencils(spark, lat, blocks, bnd).where("val <> 0")


def kernel(op: DataFrame, lat, component: int = 0) -> DataFrame:
    """(component, idx, v): an operator's response to an impulse at the first voxel of a component."""
    n = math.prod(lat)
    first = op.where(F.col("col") == component * n)
    return first.select(F.expr(f"row div {n}").alias("component"), F.pmod("row", F.lit(n)).alias("idx"), F.col("val").alias("v"))
