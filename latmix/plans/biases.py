"""Queries: derivatives, energies and schedules of bias fields, on volumes of counted parts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import bias, gmm
from .common import OFF, r, rs, table
from .lattices import _FULL, DIM, _dct, volume

NB = (3, 2, 1)
FIELDS = {"x1": np.array([[0.2, -0.1], [0.05, 0.0], [0.1, 0.03]]), "x2": np.array([[-0.1, 0.07], [0.02, 0.04], [0.0, -0.06]])}
MU, A = np.array([[0.6, 0.9], [1.4, 0.4]]), np.array([[[2.0, 0.5], [0.5, 1.0]], [[1.5, -0.4], [-0.4, 3.0]]])
WIDTH = (0.25, 0.5)


def channels(spark, sf_dir):
    """Two channels with gaps, and responsibilities of two clusters."""
    v, place = volume(spark, sf_dir), F.col("i") + 2 * F.col("j") + F.col("k")
    return v.select(
        "i", "j", "k", F.when(place % 4 != 0, F.col("v")).alias("x1"), F.when(place % 5 != 0, 0.3 + F.col("v") * F.col("v") / 3).alias("x2"),
        (0.2 + (place % 3) * 0.3).alias("z1"), (0.8 - (place % 3) * 0.3).alias("z2"),
    )


_PLACE = "(i + 2 * j + k)"
_CHANNELS = f"""(SELECT i, j, k, CASE WHEN {_PLACE} % 4 <> 0 THEN v END AS x1, CASE WHEN {_PLACE} % 5 <> 0 THEN 0.3e0 + v * v / 3 END AS x2,
 0.2e0 + ({_PLACE} % 3) * 0.3e0 AS z1, 0.8e0 - ({_PLACE} % 3) * 0.3e0 AS z2 FROM {_FULL})"""


def derivatives(spark, sf_dir):
    """Objective, gradient and Hessian of two channels with gaps and binned values."""
    bases, model = bias.design(DIM, NB), gmm.Mixture(MU, A, np.log([0.5, 0.5]))
    coeff = {c: f.ravel(order="F") for c, f in FIELDS.items()}
    obs, args = channels(spark, sf_dir), (list(FIELDS), ["z1", "z2"], model, bases, coeff)
    g, h = bias.derivatives(obs, *args, bin_width=WIDTH)
    lx, lb = bias.conditional(obs, *args, bin_width=WIDTH)
    g = g.ravel(order="F")
    rows = [("objective", 0, 0, lx), ("objective", 1, 0, lb)] + [("gradient", a, 0, float(g[a])) for a in range(len(g))] + [("hessian", a, b, float(h[a, b])) for a in range(len(g)) for b in range(len(g))]
    return spark.createDataFrame(rows, "what string, a int, b int, v double").select("what", "a", "b", r("v", 5, OFF).alias("v"))


def _derivatives_sql():
    """Each pattern of gaps written out: what one channel is left with is A_pp - A_pq^2 / A_qq."""
    phi = {p + NB[0] * q: f"{_dct('i', DIM[0], p)} * {_dct('j', DIM[1], q)} * {_dct('k', DIM[2], 0)}" for p in range(NB[0]) for q in range(NB[1])}
    log_field = {c: " + ".join(f"({float(f[p, q])!r}::DOUBLE) * p{p + NB[0] * q}" for p in range(NB[0]) for q in range(NB[1])) for c, f in FIELDS.items()}
    parts = {"g1": [], "g2": [], "h11": [], "h12": [], "h22": [], "ll": []}
    for k in range(2):
        (a, b), (_, d) = A[k].tolist()
        m1, m2 = MU[k].tolist()
        z, log2pi = f"z{k + 1}", math.log(2 * math.pi)
        both = {"a": a, "b": b, "d": d, "const": -log2pi + 0.5 * math.log(a * d - b * b)}
        one, two = a - b * b / d, d - b * b / a
        parts["g1"].append(f"CASE WHEN c = 3 THEN {z} * (y1 * ({a!r} * (y1 - {m1!r}) + {b!r} * (y2 - {m2!r})) + {a!r} * w1) WHEN c = 1 THEN {z} * (y1 * {one!r} * (y1 - {m1!r}) + {one!r} * w1) ELSE 0 END")
        parts["g2"].append(f"CASE WHEN c = 3 THEN {z} * (y2 * ({b!r} * (y1 - {m1!r}) + {d!r} * (y2 - {m2!r})) + {d!r} * w2) WHEN c = 2 THEN {z} * (y2 * {two!r} * (y2 - {m2!r}) + {two!r} * w2) ELSE 0 END")
        parts["h11"].append(f"CASE WHEN c = 3 THEN {z} * {a!r} * (y1 * y1 + w1) WHEN c = 1 THEN {z} * {one!r} * (y1 * y1 + w1) ELSE 0 END")
        parts["h22"].append(f"CASE WHEN c = 3 THEN {z} * {d!r} * (y2 * y2 + w2) WHEN c = 2 THEN {z} * {two!r} * (y2 * y2 + w2) ELSE 0 END")
        parts["h12"].append(f"CASE WHEN c = 3 THEN {z} * ({b!r}) * y1 * y2 ELSE 0 END")
        parts["ll"].append(
            f"CASE WHEN c = 3 THEN {z} * ({both['const']!r} - 0.5 * ({a!r} * ((y1 - {m1!r}) * (y1 - {m1!r}) + w1) + 2 * ({b!r}) * (y1 - {m1!r}) * (y2 - {m2!r}) + {d!r} * ((y2 - {m2!r}) * (y2 - {m2!r}) + w2)))"
            f" WHEN c = 1 THEN {z} * ({0.5 * math.log(one) - 0.5 * log2pi!r} - 0.5 * {one!r} * ((y1 - {m1!r}) * (y1 - {m1!r}) + w1))"
            f" WHEN c = 2 THEN {z} * ({0.5 * math.log(two) - 0.5 * log2pi!r} - 0.5 * {two!r} * ((y2 - {m2!r}) * (y2 - {m2!r}) + w2)) ELSE 0 END"
        )
    total = {k: " + ".join(v) for k, v in parts.items()}
    n = len(phi)
    rows = ["SELECT 'objective' AS what, 0::INT AS a, 0::INT AS b, sum(ll) AS v FROM t", "SELECT 'objective', 1, 0, sum(CASE WHEN x1 IS NOT NULL THEN f1 ELSE 0 END + CASE WHEN x2 IS NOT NULL THEN f2 ELSE 0 END) FROM t"]
    rows += [f"SELECT 'gradient', {q * n + m}, 0, sum(p{m} * (g{q + 1} - CASE WHEN x{q + 1} IS NULL THEN 0 ELSE 1 END)) FROM t" for q in range(2) for m in range(n)]
    rows += [f"SELECT 'hessian', {q * n + m}, {s * n + l}, sum(p{m} * p{l} * h{min(q, s) + 1}{max(q, s) + 1}) FROM t" for q in range(2) for m in range(n) for s in range(2) for l in range(n)]
    return f"""WITH f AS (SELECT *, {', '.join(f'{e} AS p{m}' for m, e in phi.items())} FROM {_CHANNELS}),
    e AS (SELECT *, {log_field['x1']} AS f1, {log_field['x2']} AS f2, CASE WHEN x1 IS NULL THEN 0 ELSE 1 END + CASE WHEN x2 IS NULL THEN 0 ELSE 2 END AS c FROM f),
    y AS (SELECT *, x1 * exp(f1) AS y1, x2 * exp(f2) AS y2, pow({WIDTH[0]} * exp(f1), 2) / 12 AS w1, pow({WIDTH[1]} * exp(f2), 2) / 12 AS w2 FROM e),
    t AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in total.items())} FROM y)
    SELECT what, a, b, {rs('v', 5, OFF)} AS v FROM ({' UNION ALL '.join(rows)})"""


# energies --------------------------------------------------------------------------------------------------
LAT, KB, VS = (4, 5, 3), (3, 2, 2), (0.5, 0.8, 1.5)
WEIGHTS = {"absolute": dict(absolute=1.0), "membrane": dict(membrane=1.0), "bending": dict(bending=1.0), "elastic1": dict(elastic1=1.0), "elastic2": dict(elastic2=1.0)}


def energies(spark, sf_dir):
    """Energies of vector fields, one a brand, whose coefficients are mean prices of parts."""
    p = table(spark, sf_dir, "part")
    spot = [F.col("p_partkey") % KB[0], F.col("p_size") % KB[1], F.expr("p_partkey div 3") % KB[2], F.expr("p_size div 2") % 3]
    c = p.groupBy("p_brand", *(x.cast("int").alias(f"a{n}") for n, x in enumerate(spot))).agg((F.avg("p_retailprice") / 1000).alias("v"))
    per = c.groupBy("p_brand").agg(F.collect_list(F.struct("a0", "a1", "a2", "a3", "v")).alias("c"))  # as many as a field has coefficients
    forms = {(b, w): bias.energy(LAT, KB, VS, **kind, bnd=b) for b in bias.BOUNDARIES for w, kind in WEIGHTS.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                x = np.zeros((*KB, 3))
                for e in row["c"]:
                    x[e["a0"], e["a1"], e["a2"], e["a3"]] = e["v"]
                out = [(row["p_brand"], b, w, f.value(x) if f.count == 3 else sum(f.value(x[..., n, None]) for n in range(3))) for (b, w), f in forms.items()]
                yield pa.RecordBatch.from_arrays([pa.array(k) for k in zip(*out)], names=["p_brand", "boundary", "term", "v"])

    return per.mapInArrow(run, "p_brand string, boundary string, term string, v double").select("p_brand", "boundary", "term", r("v", 5, OFF).alias("v"))


def _energies_sql():
    """Sums over the lattice of squared derivatives, written by voxel; complex fields by both parts."""

    def basis(bnd, d, a, x):
        """(value, first, second derivative) as (real, imaginary) of basis a at voxel x (from 0)."""
        n, v = LAT[d], VS[d]
        if bnd == "circulant":
            w, t = f"(2 * pi() * {a} / {n * v!r})", f"(2 * pi() * {a} * {x} / {n})"
            re, im = f"(cos({t}) / {math.sqrt(n)!r})", f"(-sin({t}) / {math.sqrt(n)!r})"
            return [(re, im), (f"({w} * {im})", f"(-{w} * {re})"), (f"(-{w} * {w} * {re})", f"(-{w} * {w} * {im})")]
        if bnd == "dirichlet":
            w, t, s = f"(pi() * ({a} + 1) / {(n + 1) * v!r})", f"(pi() * ({a} + 1) * ({x} + 1) / {n + 1})", repr(math.sqrt(2 / (n + 1)))
            return [(f"({s} * sin({t}))", "0"), (f"({s} * {w} * cos({t}))", "0"), (f"(-{s} * {w} * {w} * sin({t}))", "0")]
        w, t = f"(pi() * {a} / {n * v!r})", f"(pi() * {a} * (2 * {x} + 1) / {2 * n})"
        s = f"(CASE WHEN {a} = 0 THEN {1 / math.sqrt(n)!r} ELSE {math.sqrt(2 / n)!r} END)"
        return [(f"({s} * cos({t}))", "0"), (f"(-{s} * {w} * sin({t}))", "0"), (f"(-{s} * {w} * {w} * cos({t}))", "0")]

    def product(bnd, order):
        re, im = "1e0", "0e0"
        for d in range(3):
            r1, i1 = basis(bnd, d, f"a{d}", f"x{d}")[order[d]]
            re, im = (f"({re} * {r1})", "0e0") if i1 == "0" and im == "0e0" else (f"({re} * {r1} - {im} * {i1})", f"({re} * {i1} + {im} * {r1})")
        return re, im

    orders = {"f": (0, 0, 0), "d0": (1, 0, 0), "d1": (0, 1, 0), "d2": (0, 0, 1), "d00": (2, 0, 0), "d11": (0, 2, 0), "d22": (0, 0, 2), "d01": (1, 1, 0), "d02": (1, 0, 1), "d12": (0, 1, 1)}
    selects = []
    for bnd in bias.BOUNDARIES:
        sums = ", ".join(f"sum(v * {product(bnd, o)[part]}) AS {n}_{'ri'[part]}" for n, o in orders.items() for part in (0, 1))
        selects.append(f"SELECT p_brand, '{bnd}' AS boundary, x0, x1, x2, a3, {sums} FROM c, l GROUP BY p_brand, x0, x1, x2, a3")
    sq = lambda n, by=1: " + ".join(f"{by} * {n}_{p} * {n}_{p}" for p in "ri")
    scalar = {"absolute": sq("f"), "membrane": " + ".join(sq(f"d{i}") for i in range(3)), "bending": " + ".join(sq(f"d{i}{i}") for i in range(3)) + " + " + " + ".join(sq(n, 2) for n in ("d01", "d02", "d12"))}
    rows = [f"SELECT p_brand, boundary, '{w}' AS term, sum({e}) AS v FROM b GROUP BY p_brand, boundary" for w, e in scalar.items()]
    of = lambda i, j, p: f"max(CASE WHEN a3 = {i} THEN d{j}_{p} ELSE 0 END) + min(CASE WHEN a3 = {i} THEN d{j}_{p} ELSE 0 END)"
    jac = ", ".join(f"{of(i, j, p)} AS j{i}{j}_{p}" for i in range(3) for j in range(3) for p in "ri")
    sym = " + ".join(f"0.25 * (j{i}{j}_{p} + j{j}{i}_{p}) * (j{i}{j}_{p} + j{j}{i}_{p})" for i in range(3) for j in range(3) for p in "ri")
    div = " + ".join(f"0.5 * (j00_{p} + j11_{p} + j22_{p}) * (j00_{p} + j11_{p} + j22_{p})" for p in "ri")
    rows += [f"SELECT p_brand, boundary, '{w}', sum({e}) FROM j GROUP BY p_brand, boundary" for w, e in (("elastic1", sym), ("elastic2", div))]
    return f"""WITH c AS (SELECT p_brand, (p_partkey % {KB[0]})::INT AS a0, (p_size % {KB[1]})::INT AS a1, (p_partkey // 3 % {KB[2]})::INT AS a2, (p_size // 2 % 3)::INT AS a3, avg(p_retailprice) / 1000 AS v FROM part GROUP BY ALL),
    l AS (SELECT * FROM range({LAT[0]}) a(x0), range({LAT[1]}) b(x1), range({LAT[2]}) c(x2)),
    b AS ({' UNION ALL '.join(selects)}), j AS (SELECT p_brand, boundary, x0, x1, x2, {jac} FROM b GROUP BY p_brand, boundary, x0, x1, x2)
    SELECT p_brand, boundary, term, {rs('v', 5, OFF)} AS v FROM ({' UNION ALL '.join(rows)})"""


def image_sides(spark, sf_dir):
    cols, lat = bias.lattice_of(channels(spark, sf_dir))
    return spark.createDataFrame([(a, n, len(cols)) for a, n in zip("ijk", lat)], "axis string, side int, channels int")


def fit_schedule(spark, sf_dir):
    """A row a round of a fit whose penalty is lowered once."""
    rows: list[dict] = []
    bias.fit(channels(spark, sf_dir).drop("z1", "z2"), k=2, fwhm=8.0, reg=[1.0, 0.05], iterations=4, steps=1, tolerance=5e-2, history=rows)
    names = ["round", "weight", "log_likelihood", "log_field", "penalty", "objective", "gain"]
    return spark.createDataFrame([tuple(float(x[n]) if n != "round" else x[n] for n in names) for x in rows], ", ".join(f"{n} {'int' if n == 'round' else 'double'}" for n in names))


QUERIES = {"bias_derivatives": derivatives, "bias_energies": energies, "image_sides": image_sides, "bias_fit_schedule": fit_schedule}
ORACLE = {
    "bias_derivatives": _derivatives_sql(), "bias_energies": _energies_sql(),
    "image_sides": f"SELECT a AS axis, n::INT AS side, 4::INT AS channels FROM (SELECT unnest(['i', 'j', 'k']) AS a, unnest([max(i), max(j), max(k)]) AS n FROM {_CHANNELS})",
}
