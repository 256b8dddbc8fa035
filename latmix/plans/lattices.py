"""Queries: lattices, sparse operators, warps, boxes, bias fields, on a grid of counted parts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import bias, histogram, lattice, sparse
from .common import OFF, r, rs, table

DIM = (5, 10, 5)
#: parts by brand digit, size decile and brand series: a small volume of mean prices
_GRID = """(SELECT (p_partkey % 5 + 1)::INT AS i, ((p_size - 1) // 5 + 1)::INT AS j, (p_partkey // 5 % 5 + 1)::INT AS k, avg(p_retailprice) / 1000 AS v FROM part GROUP BY 1, 2, 3)"""
_FULL = f"(SELECT i::INT AS i, j::INT AS j, k::INT AS k, coalesce(v, 0) AS v FROM range(1, 6) a(i), range(1, 11) b(j), range(1, 6) c(k) LEFT JOIN {_GRID} g USING (i, j, k))".replace("range(1, 6) a(i), range(1, 11) b(j), range(1, 6) c(k) LEFT", "(range(1, 6) a(i) CROSS JOIN range(1, 11) b(j) CROSS JOIN range(1, 6) c(k)) LEFT")


def volume(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    v = p.groupBy((F.col("p_partkey") % 5 + 1).cast("int").alias("i"), (F.expr("(p_size - 1) div 5") + 1).cast("int").alias("j"), (F.expr("p_partkey div 5") % 5 + 1).cast("int").alias("k")).agg((F.avg("p_retailprice") / 1000).alias("v"))
    return lattice.lattice(spark, DIM).join(v, ["i", "j", "k"], "left").fillna(0.0, ["v"])


def lattice_grad(spark, sf_dir):
    g = lattice.gradient(volume(spark, sf_dir), (1.0, 2.0, 0.5))
    return g.select("i", "j", "k", *(r(c).alias(c) for c in ("di", "dj", "dk")))


_ORDER = {"i": "PARTITION BY j, k ORDER BY i", "j": "PARTITION BY i, k ORDER BY j", "k": "PARTITION BY i, j ORDER BY k"}
_GRAD = "SELECT *, " + ", ".join(f"coalesce((lead(v) OVER ({o}) - v) / {s}, 0) AS d{a}" for (a, o), s in zip(_ORDER.items(), ("1e0", "2e0", "0.5e0"))) + f" FROM {_FULL}"


def lattice_div(spark, sf_dir):
    g = lattice.gradient(volume(spark, sf_dir), (1.0, 2.0, 0.5))
    return lattice.divergence(g, DIM, (1.0, 2.0, 0.5)).select("i", "j", "k", r("v").alias("v"))


_DIV = " + ".join(f"(coalesce(lag(d{a}) OVER ({o}), 0) - CASE WHEN {a} < {n} THEN d{a} ELSE 0 END) / {s}" for (a, o), n, s in zip(_ORDER.items(), DIM, ("1e0", "2e0", "0.5e0")))


def lattice_smooth(spark, sf_dir):
    return lattice.smooth(volume(spark, sf_dir), 2.0).select("i", "j", "k", r("v").alias("v"))


def _smooth_sql():
    radius = round(6 * 2.0 / math.sqrt(8 * math.log(2)))
    k = histogram.gaussian_kernel(2.0, radius)
    src = _FULL
    for a, o in _ORDER.items():
        total = " + ".join((f"coalesce(lag(v, {s}) OVER ({o}), 0)" if s > 0 else f"coalesce(lead(v, {-s}) OVER ({o}), 0)" if s < 0 else "v") + f" * {w!r}" for s, w in zip(range(-radius, radius + 1), k))
        src = f"(SELECT i, j, k, {total} AS v FROM {src})"
    return f"SELECT i, j, k, {rs('v')} AS v FROM {src}"


def _pad(method):
    def run(spark, sf_dir):
        return lattice.pad(volume(spark, sf_dir), DIM, (2, 1), method, 7.0, "both").select("i", "j", "k", r("v").alias("v"))

    return run


def _pad_sql(method):
    def src(a, n):
        return {
            "circular": f"(({a} - 1 + {2 * n}) % {n} + 1)", "replicate": f"least(greatest({a}, 1), {n})", "constant": f"CASE WHEN {a} BETWEEN 1 AND {n} THEN {a} END",
            "symmetric": f"CASE WHEN ({a} - 1 + {4 * n}) % {2 * n} < {n} THEN ({a} - 1 + {4 * n}) % {2 * n} + 1 ELSE {2 * n} - ({a} - 1 + {4 * n}) % {2 * n} END",
        }[method]

    return f"""WITH f AS (SELECT * FROM {_FULL}), o AS (SELECT i::INT AS i, j::INT AS j, k::INT AS k, {src('(i - 2)', 5)} AS si, {src('(j - 1)', 10)} AS sj FROM range(1, 10) a(i), range(1, 13) b(j), range(1, 6) c(k))
SELECT o.i, o.j, o.k, {rs('coalesce(f.v, 7e0)')} AS v FROM o LEFT JOIN f ON f.i = o.si AND f.j = o.sj AND f.k = o.k"""


A = np.array([[0.9, 0.1, 0.0, 0.3], [-0.1, 0.95, 0.0, 0.2], [0.0, 0.05, 1.0, -0.1], [0, 0, 0, 1]])
_Y = [" + ".join(f"({float(A[n, m])!r}) * {a}" for m, a in enumerate("ijk")) + f" + ({float(A[n, 3])!r})" for n in range(3)]


def warp_affine(spark, sf_dir):
    """An affine after a warp that the volume makes, in voxels of another image."""
    moved = volume(spark, sf_dir).select("i", "j", "k", *((F.col(a) + F.col("v") * c).alias(f"y{n + 1}") for n, (a, c) in enumerate(zip("ijk", (0.15, 0.25, -0.35)))))
    w = lattice.mm_to_voxel(lattice.transform_warp(lattice.transform_warp(moved, A), np.diag([2.0, 2.0, 2.0, 1.0])), (2.0, 2.0, 4.0))
    return w.select("i", "j", "k", *(r(f"y{n}", half=OFF).alias(f"y{n}") for n in (1, 2, 3)))


def warp_trilinear(spark, sf_dir):
    out = lattice.sample(volume(spark, sf_dir), lattice.affine_warp(spark, A, DIM), DIM)
    return out.select("i", "j", "k", r("v", half=OFF).alias("v"))


def _trilinear_sql():
    parts = []
    for c in np.ndindex(2, 2, 2):
        w = " * ".join(f"(y{n + 1} - floor(y{n + 1}))" if u else f"(1 - (y{n + 1} - floor(y{n + 1})))" for n, u in enumerate(c))
        s = ", ".join(f"(((floor(y{n + 1}) + {u} - 1)::INT % {d} + {d}) % {d} + 1) AS s{a}" for n, (u, d, a) in enumerate(zip(c, DIM, "ijk")))
        parts.append(f"SELECT i, j, k, {s}, {w} AS w, {4 * c[0] + 2 * c[1] + c[2]} AS corner FROM y")
    y = ", ".join(f"{e} AS y{n + 1}" for n, e in enumerate(_Y))
    return f"WITH f AS (SELECT * FROM {_FULL}), y AS (SELECT i, j, k, {y} FROM f), x AS ({' UNION ALL '.join(parts)}) SELECT x.i, x.j, x.k, {rs(' + '.join(f'coalesce(max(w * v) FILTER (corner = {n}), 0)' for n in range(8)), half=OFF)} AS v FROM x JOIN f ON f.i = si AND f.j = sj AND f.k = sk GROUP BY x.i, x.j, x.k"


def resample_nearest(spark, sf_dir):
    out = lattice.sample(volume(spark, sf_dir), lattice.translation_warp(spark, [0.4, 1.0, -0.6], DIM), DIM, degree=0, bnd="replicate")
    return out.select("i", "j", "k", r("v").alias("v"))


_NEAREST = f"WITH f AS (SELECT * FROM {_FULL}) SELECT a.i, a.j, a.k, {rs('b.v')} AS v FROM f a JOIN f b ON b.i = a.i AND b.j = least(a.j + 1, 10) AND b.k = greatest(a.k - 1, 1)"


def warp_compose(spark, sf_dir):
    """A warp that the volume makes, after one that moves by whole voxels."""
    one = volume(spark, sf_dir).select("i", "j", "k", *((F.col(a) + F.col("v") * c).alias(f"y{n + 1}") for n, (a, c) in enumerate(zip("ijk", (0.5, 0.25, -0.125)))))
    two = lattice.translation_warp(spark, [1.0, 2.0, 0.0], DIM)
    return lattice.compose(one, two, dim=DIM).select("i", "j", "k", *(r(f"y{n}", half=OFF).alias(f"y{n}") for n in (1, 2, 3)))


M = np.array([[2.0, 0, 0, -5], [0, 1.0, 0, 3], [0, 0, 1.5, 0], [0, 0, 0, 1]])


def bbox_threshold(spark, sf_dir):
    return lattice.threshold_box(volume(spark, sf_dir), M, "thr", 1.5).select(*(r(f"{e}{n}").alias(f"{e}{n}") for e in ("lo", "hi") for n in (1, 2, 3)))


_BOX = f"SELECT min(2e0 * i - 5) AS lo1, min(j + 3e0) AS lo2, min(1.5e0 * k) AS lo3, max(2e0 * i - 5) AS hi1, max(j + 3e0) AS hi2, max(1.5e0 * k) AS hi3 FROM {_FULL} WHERE v > 1.5"


def crop_box(spark, sf_dir):
    img, mat = lattice.crop(volume(spark, sf_dir), M, [[4, 2], [3, 8], [1, 3]])
    return img.select("i", "j", "k", r("v").alias("v"), F.lit(float(mat[0, 3])).alias("origin1"), F.lit(float(mat[1, 3])).alias("origin2"))


def fov_mask(spark, sf_dir):
    return lattice.mask_field_of_view(volume(spark, sf_dir), M, M @ np.array([[1, 0, 0, 1.0], [0, 1, 0, -2], [0, 0, 1, 0], [0, 0, 0, 1]]), DIM).select("i", "j", "k", r("v").alias("v"))


def slice_central(spark, sf_dir):
    return lattice.central_slice(volume(spark, sf_dir), DIM, "j").select("i", "j", "k", r("v").alias("v"))


# sparse operators, applied to the volume; the oracle writes them as sums over neighbours ------------------
LAT, VS, N = DIM, (0.5, 0.4, 0.3), math.prod(DIM)
_CELLS = f"(SELECT i + {LAT[0]} * j + {LAT[0] * LAT[1]} * k AS id, i, j, k FROM range({LAT[0]}) a(i), range({LAT[1]}) b(j), range({LAT[2]}) c(k))"
_INDEX = f"(i - 1 + {LAT[0]} * (j - 1) + {LAT[0] * LAT[1]} * (k - 1))"


def field(spark, sf_dir, components: int):
    """(idx, v): the volume as each component of a vector field, by growing factors."""
    v = volume(spark, sf_dir).select(F.expr(_INDEX).alias("at"), "v", F.explode(F.array(*(F.lit(c) for c in range(components)))).alias("c"))
    return v.select((F.col("at") + F.col("c") * N).cast("long").alias("idx"), (F.col("v") * (1 + F.col("c") * 0.5)).alias("v"))


def _field_sql(components):
    return f"(SELECT {_INDEX} + c * {N} AS idx, v * (1 + c * 0.5e0) AS v FROM {_FULL}, (SELECT unnest(range({components})) AS c))"


def _coo(build, components=1):
    def run(spark, sf_dir):
        return sparse.spmv(build(spark), field(spark, sf_dir, components)).select("idx", r("v", half=OFF).alias("v"))

    return run


def _apply_sql(text, components=1, of=None):
    return f"WITH e AS (SELECT row, col, sum(val) AS val FROM ({text}) GROUP BY row, col) SELECT e.row::BIGINT AS idx, {rs('sum(e.val * f.v)', half=OFF)} AS v FROM e JOIN {of or _field_sql(components)} f ON e.col = f.idx WHERE abs(e.val) > 1e-12 GROUP BY e.row"


def _g_sql(d, s, bnd):
    """(row, col, val) of a one-sided difference."""
    a, n, step, vs = "ijk"[d], LAT[d], math.prod(LAT[:d]), VS[d]
    there = f"({a} + {s})"
    inside = f"{there} BETWEEN 0 AND {n - 1}"
    other = f"id + (({there} + {n}) % {n} - {a}) * {step}" if bnd == "circulant" else f"id + {s * step}"
    keep_self = {"circulant": "true", "neumann": inside, "dirichlet": "true"}[bnd]
    keep_other = {"circulant": "true", "neumann": inside, "dirichlet": inside}[bnd]
    return f"(SELECT id AS row, id AS col, {-s / vs!r}::DOUBLE AS val FROM {_CELLS} WHERE {keep_self} UNION ALL SELECT id, {other}, {s / vs!r}::DOUBLE FROM {_CELLS} WHERE {keep_other})"


def _gtg_sql(i, si, j, sj, scale, row=0, col=0, bnd="neumann"):
    return f"SELECT a.col + {row} AS row, b.col + {col} AS col, {scale!r} * a.val * b.val AS val FROM {_g_sql(i, si, bnd)} a JOIN {_g_sql(j, sj, bnd)} b ON a.row = b.row"


def _precision_sql(absolute, membrane, mu, lam):
    parts = [f"SELECT id + {c * N} AS row, id + {c * N} AS col, {absolute!r} AS val FROM {_CELLS}" for c in range(3)] if absolute else []
    for c in range(3):
        for i in range(3):
            if membrane + mu:
                parts += [_gtg_sql(i, s, i, s, (membrane + mu) / 2, c * N, c * N) for s in (1, -1)]
        for e in range(3):
            for sc in (1, -1):
                for se in (1, -1):
                    if c == e and sc != se:
                        continue
                    share = 2 if c == e else 4
                    if mu:
                        parts.append(_gtg_sql(e, se, c, sc, mu / share, c * N, e * N))
                    if lam:
                        parts.append(_gtg_sql(c, sc, e, se, lam / share, c * N, e * N))
    return _apply_sql(" UNION ALL ".join(parts), 3)


def _jac_sql():
    return _apply_sql(" UNION ALL ".join(f"SELECT row + {(c * 3 + j) * N} AS row, col + {c * N} AS col, val FROM {_g_sql(j, 1, 'neumann')}" for c in range(2) for j in range(3)), 2)


def _symjac_sql():
    parts = []
    for i in range(3):
        for j in range(3):
            parts += [f"SELECT row + {(i * 3 + j) * N} AS row, col + {i * N} AS col, 0.5 * val AS val FROM {_g_sql(j, 1, 'neumann')}", f"SELECT row + {(i * 3 + j) * N} AS row, col + {j * N} AS col, 0.5 * val AS val FROM {_g_sql(i, 1, 'neumann')}"]
    return _apply_sql(" UNION ALL ".join(parts), 3)


_LAP = " UNION ALL ".join(_gtg_sql(i, 1, i, 1, -1.0) for i in range(3))
_HES = " UNION ALL ".join(_gtg_sql(i, 1, j, 1, -1.0, (3 * i + j) * N) for i in range(3) for j in range(3))


def spmv(spark, sf_dir):
    field = volume(spark, sf_dir).select((F.col("i") - 1 + 5 * (F.col("j") - 1) + 50 * (F.col("k") - 1)).cast("long").alias("idx"), "v")
    return sparse.spmv(sparse.laplacian(spark, DIM, VS), field).select("idx", r("v", half=OFF).alias("v"))


def precision_bending(spark, sf_dir):
    """Kernel of the bending energy: its response to an impulse where the volume is largest."""
    v = field(spark, sf_dir, 1)
    impulse = v.withColumn("v", F.when(F.struct("v", "idx") == v.select(F.max(F.struct("v", "idx"))).scalar(), 1.0).otherwise(0.0))
    return sparse.spmv(sparse.precision(spark, LAT, VS, (0, 0, 1.0, 0, 0)), impulse).select("idx", r("v", half=OFF).alias("v"))


def _bending_sql():
    """Products of products of one-sided differences."""
    one = {(d, s): f"(SELECT row, col, sum(val) AS val FROM ({_gtg_sql(d, s, d, s, 1.0)}) GROUP BY row, col)" for d in range(3) for s in (1, -1)}
    square = {d: f"(SELECT row, col, sum(val) AS val FROM (SELECT row, col, val / 2 AS val FROM {one[d, 1]} UNION ALL SELECT row, col, val / 2 FROM {one[d, -1]}) GROUP BY row, col)" for d in range(3)}
    times = lambda a, b, by: f"SELECT a.row AS row, b.col AS col, {by} * a.val * b.val AS val FROM {a} a JOIN {b} b ON a.col = b.row"
    parts = [times(one[d, s], one[d, s], 0.5) for d in range(3) for s in (1, -1)] + [times(square[d], square[e], 1) for d in range(3) for e in range(3) if d != e]
    impulse = f"(SELECT idx, CASE WHEN row_number() OVER (ORDER BY v DESC, idx DESC) = 1 THEN 1e0 ELSE 0e0 END AS v FROM {_field_sql(1)})"
    return _apply_sql(" UNION ALL ".join(parts), of=impulse)


# bias --------------------------------------------------------------------------------------------------
COEFF = np.array([[0.2, -0.1], [0.05, 0.0], [0.1, 0.03]])


def bias_reconstruct(spark, sf_dir):
    bases = [bias.dct_basis(5, 3), bias.dct_basis(10, 2), bias.dct_basis(5, 1)]
    out = bias.reconstruct(volume(spark, sf_dir), bases, COEFF.ravel(order="F"))
    return out.select("i", "j", "k", r("bias").alias("bias"), r(F.col("bias") * F.col("v")).alias("v"))


def _dct(a, n, m):
    return f"{(1 / math.sqrt(n) if m == 0 else math.sqrt(2 / n))!r}::DOUBLE" + (f" * cos(pi() * (2 * ({a} - 1) + 1) * {m} / {2 * n})" if m else "")


_BIAS = " + ".join(f"({float(COEFF[p, q])!r}::DOUBLE) * {_dct('i', 5, p)} * {_dct('j', 10, q)} * {_dct('k', 5, 0)}" for p in range(3) for q in range(2))


QUERIES = {
    "lattice_grad": lattice_grad, "lattice_div": lattice_div, "lattice_smooth": lattice_smooth,
    **{f"lattice_pad_{m}": _pad(m) for m in ("circular", "replicate", "symmetric", "constant")},
    "warp_affine_mm2vox": warp_affine, "warp_trilinear": warp_trilinear, "resample_nn": resample_nearest, "warp_compose": warp_compose,
    "bbox_threshold": bbox_threshold, "crop": crop_box, "fov_mask": fov_mask, "central_slice": slice_central,
    **{f"coo_gradient_{b}": _coo(lambda s, b=b: sparse.gradient(s, LAT, VS, 1, -1 if b == "dirichlet" else 1, b)) for b in ("circulant", "neumann", "dirichlet")},
    "coo_jacobian": _coo(lambda s: sparse.jacobian(s, LAT, VS, 2), 2), "coo_laplacian": _coo(lambda s: sparse.laplacian(s, LAT, VS)), "coo_hessian": _coo(lambda s: sparse.hessian(s, LAT, VS)),
    "coo_divergence": _coo(lambda s: sparse.divergence(s, LAT, VS), 3), "coo_symjac": _coo(lambda s: sparse.symmetric_jacobian(s, LAT, VS), 3), "coo_euclidean": _coo(lambda s: sparse.euclidean(s, LAT, VS), 3),
    "coo_precision_absolute": _coo(lambda s: sparse.precision(s, LAT, VS, (0.7, 0, 0, 0, 0)), 3), "coo_precision_membrane": _coo(lambda s: sparse.precision(s, LAT, VS, (0, 0.5, 0, 0, 0)), 3),
    "coo_precision_elastic": _coo(lambda s: sparse.precision(s, LAT, VS, (0, 0, 0, 0.3, 0.2)), 3),
    "coo_spmv": spmv, "coo_kernel_bending": precision_bending,
    "bias_reconstruct": bias_reconstruct,
}
ORACLE = {
    "lattice_grad": f"SELECT i, j, k, {rs('di')} AS di, {rs('dj')} AS dj, {rs('dk')} AS dk FROM ({_GRAD})",
    "lattice_div": f"SELECT i, j, k, {rs(_DIV)} AS v FROM ({_GRAD})",
    "lattice_smooth": _smooth_sql(),
    **{f"lattice_pad_{m}": _pad_sql(m) for m in ("circular", "replicate", "symmetric", "constant")},
    "warp_affine_mm2vox": f"SELECT i0 AS i, j0 AS j, k0 AS k, {rs(_Y[0], half=OFF)} AS y1, {rs(_Y[1], half=OFF)} AS y2, {rs(f'({_Y[2]}) / 2', half=OFF)} AS y3 FROM (SELECT i AS i0, j AS j0, k AS k0, i + 0.15e0 * v AS i, j + 0.25e0 * v AS j, k - 0.35e0 * v AS k FROM {_FULL})",
    "warp_trilinear": _trilinear_sql(), "resample_nn": _NEAREST,
    "warp_compose": f"WITH f AS (SELECT * FROM {_FULL}) SELECT a.i, a.j, a.k, {rs('a.i + 1 + 0.5e0 * b.v', half=OFF)} AS y1, {rs('a.j + 2 + 0.25e0 * b.v', half=OFF)} AS y2, {rs('a.k - 0.125e0 * b.v', half=OFF)} AS y3 FROM f a JOIN f b ON b.i = a.i % 5 + 1 AND b.j = (a.j + 1) % 10 + 1 AND b.k = a.k",
    "bbox_threshold": _BOX,
    "crop": f"SELECT i - 1 AS i, j - 2 AS j, k, {rs('v')} AS v, -3e0 AS origin1, 5e0 AS origin2 FROM {_FULL} WHERE i BETWEEN 2 AND 4 AND j BETWEEN 3 AND 8 AND k <= 3",
    "fov_mask": f"SELECT i, j, k, {rs('CASE WHEN i - 1 >= 1 AND j + 2 <= 10 THEN v ELSE 0 END')} AS v FROM {_FULL}",
    "central_slice": f"SELECT i, k AS j, 1::INT AS k, {rs('v')} AS v FROM {_FULL} WHERE j = 6",
    **{f"coo_gradient_{b}": _apply_sql(f"SELECT * FROM {_g_sql(1, -1 if b == 'dirichlet' else 1, b)}") for b in ("circulant", "neumann", "dirichlet")},
    "coo_jacobian": _jac_sql(), "coo_laplacian": _apply_sql(_LAP), "coo_hessian": _apply_sql(_HES), "coo_kernel_bending": _bending_sql(),
    "coo_divergence": _apply_sql(" UNION ALL ".join(f"SELECT row, col + {i * N} AS col, val FROM {_g_sql(i, 1, 'neumann')}" for i in range(3)), 3), "coo_symjac": _symjac_sql(),
    "coo_euclidean": _apply_sql(" UNION ALL ".join(f"SELECT id + {i * N} AS row, id + {i * N} AS col, {v!r}::DOUBLE AS val FROM {_CELLS}" for i, v in enumerate(VS)), 3),
    "coo_precision_absolute": _precision_sql(0.7, 0, 0, 0), "coo_precision_membrane": _precision_sql(0, 0.5, 0, 0), "coo_precision_elastic": _precision_sql(0, 0, 0.3, 0.2),
    # minus the gradient's adjoint of the gradient, by neighbours
    "coo_spmv": "WITH f AS (SELECT * FROM %s), n AS (SELECT *, %s FROM f) SELECT ((i - 1) + 5 * (j - 1) + 50 * (k - 1))::BIGINT AS idx, %s AS v FROM n" % (
        _FULL,
        ", ".join(f"coalesce(lead(v) OVER ({o}) - v, 0) AS up{a}, coalesce(v - lag(v) OVER ({o}), 0) AS down{a}" for a, o in _ORDER.items()),
        rs(" + ".join(f"(up{a} - down{a}) / {s * s!r}" for a, s in zip("ijk", VS)), half=OFF),
    ),
    "bias_reconstruct": f"SELECT i, j, k, {rs('exp(b)')} AS bias, {rs('exp(b) * v')} AS v FROM (SELECT *, {_BIAS} AS b FROM {_FULL})",
}
