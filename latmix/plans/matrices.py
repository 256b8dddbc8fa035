"""Queries: matrices in array columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import linalg
from .common import r, rs, table


def _e(n):
    return f"embedding[{n + 1}]::DOUBLE"


def _frame(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))


def _arr(start, n, diag=()):
    """n elements from an offset; those in diag gain 2, so that matrices invert well."""
    return F.array(*(F.get("e", F.lit(start + i)) + (2.0 if i in diag else 0.0) for i in range(n)))


def _el(start, i, diag=()):
    return f"({_e(start + i)} + {2.0 if i in diag else 0.0!r})"


def _full(start, diag=(0, 4, 8)):
    return lambda i, j: _el(start, 3 * i + j, diag)


def _sym(start):
    idx = linalg.sym_indices(3)
    return lambda i, j: _el(start, int(idx[i, j]), (0, 1, 2))


def _flat(values, out):
    return [r(F.get(values, F.lit(i))).alias(f"{out}{i}") for i in range(9 if out[0] == "m" else 3)]


def _mm_sql(a, b, cols=3, out="m"):
    return [f"{rs(' + '.join(f'{a(i, k)} * {b(k, j)}' for k in range(3)))} AS {out}{i * cols + j}" for i in range(3) for j in range(cols)]


def _product(a, b, cols=3, **kw):
    def run(spark, sf_dir):
        return _frame(spark, sf_dir).select("vec_id", *_flat(linalg.matmul(a(), b(), 3, 3, cols, **kw), "m" if cols == 3 else "v"))

    return run


_M1, _M2, _S1, _S2, _V = (lambda: _arr(0, 9, (0, 4, 8))), (lambda: _arr(9, 9, (0, 4, 8))), (lambda: _arr(18, 6, (0, 1, 2))), (lambda: _arr(24, 6, (0, 1, 2))), (lambda: _arr(30, 3))
m1, m2, s1, s2, v = _full(0), _full(9), _sym(18), _sym(24), (lambda i, j: _el(30, i))
_t = lambda a: (lambda i, j: a(j, i))
_from = " FROM embeddings"


def _det(a):
    return f"({a(0, 0)} * ({a(1, 1)} * {a(2, 2)} - {a(1, 2)} * {a(2, 1)}) - {a(0, 1)} * ({a(1, 0)} * {a(2, 2)} - {a(1, 2)} * {a(2, 0)}) + {a(0, 2)} * ({a(1, 0)} * {a(2, 1)} - {a(1, 1)} * {a(2, 0)}))"


def _adj(a, i, j):
    rr, cc = [k for k in range(3) if k != j], [k for k in range(3) if k != i]
    sign = "" if (i + j) % 2 == 0 else "-1 * "
    return f"{sign}({a(rr[0], cc[0])} * {a(rr[1], cc[1])} - {a(rr[0], cc[1])} * {a(rr[1], cc[0])}) / {_det(a)}"


def pointwise_inv(spark, sf_dir):
    f = _frame(spark, sf_dir)
    sym = linalg.inv3(_S1(), True)
    return f.select("vec_id", *_flat(linalg.inv3(_M1()), "m"), *(r(F.get(sym, F.lit(i))).alias(f"s{i}") for i in range(6)), r(linalg.det3(_M1())).alias("det"), r(linalg.det3(_S1(), True)).alias("det_sym"))


def _inv_sql():
    idx = linalg.sym_indices(3)
    place = {int(idx[i, j]): (i, j) for i in range(3) for j in range(i, 3)}
    cols = [f"{rs(_adj(m1, i, j))} AS m{3 * i + j}" for i in range(3) for j in range(3)] + [f"{rs(_adj(s1, *place[k]))} AS s{k}" for k in range(6)]
    return f"SELECT vec_id, {', '.join(cols)}, {rs(_det(m1))} AS det, {rs(_det(s1))} AS det_sym{_from}"


def pointwise_misc(spark, sf_dir):
    t = linalg.transpose(_M1(), 3, 3)
    x = F.slice("e", 1, 10)
    soft = linalg.softmax(x)
    return _frame(spark, sf_dir).select("vec_id", *_flat(t, "m"), r(linalg.dot(F.slice("e", 1, 8), F.slice("e", 9, 8))).alias("dot"), r(linalg.logsumexp(x)).alias("lse"), r(F.get(soft, F.lit(0))).alias("soft0"), r(F.get(soft, F.lit(9))).alias("soft9"))


def _misc_sql():
    t = [f"{rs(m1(j, i))} AS m{3 * i + j}" for i in range(3) for j in range(3)]
    dot = " + ".join(f"{_e(i)} * {_e(8 + i)}" for i in range(8))
    total = " + ".join(f"exp({_e(i)})" for i in range(10))
    return f"SELECT vec_id, {', '.join(t)}, {rs(dot)} AS dot, {rs(f'ln({total})')} AS lse, {rs(f'exp({_e(0)}) / ({total})')} AS soft0, {rs(f'exp({_e(9)}) / ({total})')} AS soft9{_from}"


def sym_indices(spark, sf_dir):
    """Row sums of the symmetric matrix that a vector's components are packed into, ten rows of 55 components."""
    full = table(spark, sf_dir, "embeddings").select("vec_id", linalg.unpack(F.transform("embedding", lambda v: v.cast("double")), PACKED).alias("m"))
    row = lambda i: sum((F.get("m", F.lit(i * PACKED + j)) for j in range(1, PACKED)), F.get("m", F.lit(i * PACKED)))
    return full.select("vec_id", *(r(row(i)).alias(f"row{i}") for i in range(PACKED)))


#: Rows of the largest packed matrix that the components hold.
PACKED = 10


def _packed_sql():
    """The diagonal first, then row by row what lies right of it: counted here, not computed."""
    place, at = {}, 0
    for i in range(PACKED):
        place[i, i] = at = i
    for i in range(PACKED):
        for j in range(i + 1, PACKED):
            at += 1
            place[i, j] = place[j, i] = at
    rows = ", ".join(rs(" + ".join(f"embedding[{place[i, j] + 1}]::DOUBLE" for j in range(PACKED))) + f" AS row{i}" for i in range(PACKED))
    return f"SELECT vec_id, {rows} FROM embeddings"


QUERIES = {
    "pointwise_mm": _product(_M1, _M2), "pointwise_ms": _product(_M1, _S1, sym_b=True), "pointwise_sm": _product(_S1, _M1, sym_a=True),
    "pointwise_ss": _product(_S1, _S2, sym_a=True, sym_b=True), "pointwise_tmm": _product(_M1, _M2, trans_a=True),
    "pointwise_mv": _product(_M1, _V, 1), "pointwise_sv": _product(_S1, _V, 1, sym_a=True), "pointwise_tmv": _product(_M1, _V, 1, trans_a=True),
    "pointwise_inv_det": pointwise_inv, "pointwise_t_vv_softmax": pointwise_misc, "sym_indices": sym_indices,
}
_wrap = lambda cols: f"SELECT vec_id, {', '.join(cols)}{_from}"
ORACLE = {
    "pointwise_mm": _wrap(_mm_sql(m1, m2)), "pointwise_ms": _wrap(_mm_sql(m1, s1)), "pointwise_sm": _wrap(_mm_sql(s1, m1)),
    "pointwise_ss": _wrap(_mm_sql(s1, s2)), "pointwise_tmm": _wrap(_mm_sql(_t(m1), m2)),
    "pointwise_mv": _wrap(_mm_sql(m1, v, 1, "v")), "pointwise_sv": _wrap(_mm_sql(s1, v, 1, "v")), "pointwise_tmv": _wrap(_mm_sql(_t(m1), v, 1, "v")),
    "pointwise_inv_det": _inv_sql(), "pointwise_t_vv_softmax": _misc_sql(),
    "sym_indices": _packed_sql(),
}
