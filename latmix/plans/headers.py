"""Queries: headers as tables, reorientation, and image files written by the sink."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import bias, lattice
from ..sources import nifti, nifti_sink
from .common import OFF, r, rs, table
from .extras import _folder, _put
from .lattices import _FULL, DIM, volume
from .warps import _ijk, _linear

#: The point that all headers of the query leave where it is.
FIXED = (3.0, -4.0, 5.0)
_ZOOMS = "1 + avg(p_size) / 50, 1.2 + count(*) / 40.0, 2 + avg(p_retailprice) / 4000"


def headers(spark, sf_dir):
    """A header a brand: zooms about one point by the brand's parts, every third with two axes exchanged and every other with one flipped."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        *(F.expr(e).cast("double").alias(f"z{n}") for n, e in enumerate(_ZOOMS.split(", "))), (F.sum("p_partkey") % 3).alias("a"), (F.sum("p_partkey") % 2).alias("b"), (10 + F.count("*") % 3).cast("int").alias("d0")
    )
    zero, d = F.lit(0.0), [F.col("d0"), F.lit(12), F.lit(8)]
    flip = F.col("b") == 1
    shift = [F.lit(c) * (1 - F.col(f"z{n}")) for n, c in enumerate(FIXED)]
    # columns of the affine before they are exchanged
    col = [[F.when(flip, -F.col("z0")).otherwise(F.col("z0")), zero, zero], [zero, F.col("z1"), zero], [zero, zero, F.col("z2")]]
    origin = [shift[0] + F.when(flip, F.col("z0") * (d[0] + 1)).otherwise(0.0), shift[1], shift[2]]
    swap = F.col("a") == 0
    turned = [[F.when(swap, y).otherwise(x) for x, y in zip(col[0], col[1])], [F.when(swap, x).otherwise(y) for x, y in zip(col[0], col[1])], col[2]]
    mat = F.array(*(x for n in range(3) for x in (turned[0][n], turned[1][n], turned[2][n], origin[n])), zero, zero, zero, F.lit(1.0))
    return p.select("p_brand", mat.alias("mat"), F.when(swap, F.array(d[1], d[0], d[2])).otherwise(F.array(*d)).alias("dim"))


def average_header(spark, sf_dir):
    M, dim = lattice.average_header(headers(spark, sf_dir))
    return spark.createDataFrame([(a + 1, *map(float, M[a]), dim[a]) for a in range(3)], "axis int, m1 double, m2 double, m3 double, m4 double, dim int").select("axis", *(r(f"m{n}", half=OFF).alias(f"m{n}") for n in range(1, 5)), "dim")


def _average_sql():
    """Zooms about one point commute, so the mean's are their geometric means; the boxes by the corners 1 and d."""
    z = [e.strip() for e in _ZOOMS.split(", ")]
    out = f"""WITH h AS (SELECT p_brand, {', '.join(f'({e})::DOUBLE AS z{n}' for n, e in enumerate(z))}, 10 + count(*) % 3 AS d0, 12 AS d1, 8 AS d2 FROM part GROUP BY p_brand),
    g AS (SELECT {', '.join(f'exp(avg(ln(z{n}))) AS g{n}' for n in range(3))} FROM h)"""
    rows = []
    for n, c in enumerate(FIXED):
        # M^-1 M_i x = (z x + c (1 - z) - c (1 - g)) / g
        at = lambda x: f"((h.z{n} * {x} + ({c!r}) * (1 - h.z{n}) - ({c!r}) * (1 - g.g{n})) / g.g{n})"  # noqa: E731, B023
        rows.append(f"SELECT {n} AS a, any_value(g{n}) AS g, min({at('1e0')}) AS lo, max({at(f'h.d{n}')}) AS hi, ({c!r}) AS c FROM h, g")
    return out + f""", b AS ({' UNION ALL '.join(rows)}), t AS (SELECT *, ceil(hi - (hi - lo) * 0.05) AS top FROM b), u AS (SELECT *, floor(lo + CASE WHEN a < 2 THEN (top - lo) * 0.05 ELSE 0 END) AS low FROM t)
    SELECT (a + 1)::INT AS axis, {', '.join(f'{rs(f"CASE WHEN a = {n} THEN g ELSE 0 END", half=OFF)} AS m{n + 1}' for n in range(3))}, {rs('c * (1 - g) + g * (low - 1)', half=OFF)} AS m4, (top - low + 1)::INT AS dim FROM u"""


def header_geometry(spark, sf_dir):
    """Voxel sizes, world box and centred origin of each header."""
    g = lattice.header_geometry(headers(spark, sf_dir))
    return g.select("p_brand", *(r(F.get(c, F.lit(n)), half=OFF).alias(f"{c}{n + 1}") for c in ("vs", "lo", "hi", "origin") for n in range(3)))


_HEADERS = f"""(SELECT p_brand, {', '.join(f'({e.strip()})::DOUBLE AS z{n}' for n, e in enumerate(_ZOOMS.split(',')))}, sum(p_partkey) % 3 = 0 AS swap, sum(p_partkey) % 2 = 1 AS flip, 10 + count(*) % 3 AS d0, 12 AS d1, 8 AS d2 FROM part GROUP BY p_brand)"""


def _geometry_sql():
    size = ["CASE WHEN swap THEN z1 ELSE z0 END", "CASE WHEN swap THEN z0 ELSE z1 END", "z2"]
    side = ["CASE WHEN swap THEN d1 ELSE d0 END", "CASE WHEN swap THEN d0 ELSE d1 END", "d2"]
    cols = [f"{rs(x, half=OFF)} AS vs{n + 1}" for n, x in enumerate(size)]
    cols += [f"{rs(f'({c!r}) * (1 - z{n}) + z{n}', half=OFF)} AS lo{n + 1}" for n, c in enumerate(FIXED)] + [f"{rs(f'({c!r}) * (1 - z{n}) + z{n} * d{n}', half=OFF)} AS hi{n + 1}" for n, c in enumerate(FIXED)]
    turned = "CASE WHEN swap = flip THEN -1 ELSE 1 END"
    cols += [f"{rs(f'({turned if n == 0 else -1}) * ({x}) * (({d}) + 1) / 2', half=OFF)} AS origin{n + 1}" for n, (x, d) in enumerate(zip(size, side))]
    return f"SELECT p_brand, {', '.join(cols)} FROM {_HEADERS}"


def bias_components(spark, sf_dir):
    """Bases along each axis of each header's image."""
    g = lattice.header_geometry(headers(spark, sf_dir))
    return g.select("p_brand", *(bias.component_count(F.get("dim", F.lit(n)), F.get("vs", F.lit(n)), 7.0).alias(f"n{n + 1}") for n in range(3)))


_COMPONENTS = f"SELECT p_brand, {', '.join(f'greatest(1, ceil(2 * ({z}) * ({d}) / 7))::INT AS n{n}' for n, z, d in ((1, 'CASE WHEN swap THEN z1 ELSE z0 END', 'CASE WHEN swap THEN d1 ELSE d0 END'), (2, 'CASE WHEN swap THEN z0 ELSE z1 END', 'CASE WHEN swap THEN d0 ELSE d1 END'), (3, 'z2', 'd2')))} FROM {_HEADERS}"


def affine_basis(spark, sf_dir):
    """Each kind's generators, weighted by a brand's parts, as one matrix."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg((F.avg("p_size") / 100).alias("w"))
    kinds = [(k, flat) for k in ("translation", "rotation", "rigid", "similitude", "affine") for flat in (False, True)]
    cells = [F.struct(F.lit(f"{k}{'2' if flat else ''}").alias("kind"), F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), (F.col("w") * F.lit(float(m[i, j]))).alias("v")) for k, flat in kinds for m in [sum((g + 1) * b for g, b in enumerate(lattice.affine_basis(k, flat)))] for i in range(3) for j in range(4) if m[i, j]]
    return p.select("p_brand", F.inline(F.array(*cells))).select("p_brand", "kind", "i", "j", r("v", half=OFF).alias("v"))


def _basis_sql():
    """Generators by hand: shifts, turns (each rotates one plane), then zooms and shears."""
    flat = {"shift": [[(1, 4, 1)], [(2, 4, 1)]], "turn": [[(1, 2, 1), (2, 1, -1)]], "zoom": [[(1, 1, 1)], [(2, 2, 1)]], "shear": [[(1, 2, 1), (2, 1, 1)]]}
    full = {"shift": [*flat["shift"], [(3, 4, 1)]], "turn": [*flat["turn"], [(1, 3, 1), (3, 1, -1)], [(2, 3, 1), (3, 2, -1)]], "zoom": [*flat["zoom"], [(3, 3, 1)]], "shear": [*flat["shear"], [(1, 3, 1), (3, 1, 1)], [(2, 3, 1), (3, 2, 1)]]}
    rows = []
    for mark, of in (("", full), ("2", flat)):
        one = [[c for g in of["zoom"] for c in g]]
        for kind, generators in {"translation": of["shift"], "rotation": of["turn"], "rigid": of["shift"] + of["turn"], "similitude": of["shift"] + of["turn"] + one, "affine": of["shift"] + of["turn"] + of["zoom"] + of["shear"]}.items():
            rows += [f"('{kind}{mark}', {i}, {j}, {n * s})" for n, g in enumerate(generators, 1) for i, j, s in g]
    return f"SELECT p_brand, kind, i::INT AS i, j::INT AS j, {rs('w * m', half=OFF)} AS v FROM (SELECT p_brand, avg(p_size) / 100 AS w FROM part GROUP BY p_brand), (SELECT kind, i, j, sum(m) AS m FROM (VALUES {', '.join(rows)}) t(kind, i, j, m) GROUP BY ALL HAVING sum(m) <> 0)"


def linspace_vec(spark, sf_dir):
    """Even steps between each brand's least and largest size and price."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(*(f(c).cast("double").alias(f"{n}_{e}") for n, c in (("a", "p_size"), ("b", "p_retailprice")) for e, f in (("lo", F.min), ("hi", F.max))))
    steps = F.explode(F.array(*(F.struct(F.lit(n + 1).alias("step"), F.lit(float(t)).alias("t")) for n, t in enumerate(lattice.linspace_vec([0.0], [1.0], 5)[0]))))
    return p.select("*", steps.alias("s")).select("p_brand", "s.step", *(r(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col("s.t"), half=OFF).alias(n) for n in "ab"))


_LINSPACE = f"SELECT p_brand, step::INT AS step, {rs('a0 + (a1 - a0) * (step - 1) / 4', half=OFF)} AS a, {rs('b0 + (b1 - b0) * (step - 1) / 4', half=OFF)} AS b FROM (SELECT p_brand, min(p_size)::DOUBLE AS a0, max(p_size)::DOUBLE AS a1, min(p_retailprice)::DOUBLE AS b0, max(p_retailprice)::DOUBLE AS b1 FROM part GROUP BY p_brand), (SELECT unnest([1, 2, 3, 4, 5]) AS step)"


def bias_bases(spark, sf_dir):
    """The volume summed against each boundary's basis along the second axis, and the energy of the cosine part."""
    n, k, vs = DIM[1], 4, 0.5
    made = {b: bias.derivative_bases(n, k, vs, b)[0] for b in bias.BOUNDARIES}
    basis = spark.createDataFrame([(b, j + 1, a, float(np.real(m[j, a])), float(np.imag(m[j, a]))) for b, m in made.items() for j in range(n) for a in range(k)], "boundary string, j int, a int, re double, im double")
    c = volume(spark, sf_dir).join(F.broadcast(basis), "j").groupBy("boundary", "a").agg(F.sum(F.col("v") * F.col("re")).alias("re"), F.sum(F.col("v") * F.col("im")).alias("im"))
    e = F.get(F.array(*(F.lit(float(x)) for x in np.diag(bias.regulariser((n,), (k,), (vs,), 0.1, 0.2, 0.3)))), F.col("a"))
    return c.select("boundary", "a", r("re", half=OFF).alias("re"), r("im", half=OFF).alias("im"), r(F.when(F.col("boundary") == "neumann", e * F.col("re") * F.col("re")), 4, OFF).alias("energy"))


def _bases_sql():
    n, x = DIM[1], "(j - 1)"
    of = {
        "neumann": (f"CASE WHEN a = 0 THEN {1 / math.sqrt(n)!r} ELSE {math.sqrt(2 / n)!r} * cos(pi() * a * (2 * {x} + 1) / {2 * n}) END", "0e0"),
        "circulant": (f"cos(2 * pi() * a * {x} / {n}) / {math.sqrt(n)!r}", f"-sin(2 * pi() * a * {x} / {n}) / {math.sqrt(n)!r}"),
        "dirichlet": (f"{math.sqrt(2 / (n + 1))!r} * sin(pi() * (a + 1) * j / {n + 1})", "0e0"),
    }
    parts = " UNION ALL ".join(f"SELECT '{b}' AS boundary, a, sum(v * ({re})) AS re, sum(v * ({im})) AS im FROM f, (SELECT unnest(range(4)) AS a) GROUP BY a" for b, (re, im) in of.items())
    w = f"power(pi() * a / {n * 0.5!r}, 2)"
    return f"WITH f AS (SELECT * FROM {_FULL}), c AS ({parts}) SELECT boundary, a::INT AS a, {rs('re', half=OFF)} AS re, {rs('im', half=OFF)} AS im, CASE WHEN boundary = 'neumann' THEN {rs(f'0.5 * (0.1 + 0.2 * {w} + 0.3 * {w} * {w}) * re * re', 4, OFF)} END AS energy FROM c"


OBLIQUE = np.array([[0.0, -1.6, 0.3, 4.0], [0.9, 0.1, 0.2, -3.0], [0.1, -0.2, -1.4, 6.0], [0, 0, 0, 1]])


def reorient(spark, sf_dir):
    out, M, dim = lattice.reorient(volume(spark, sf_dir), OBLIQUE, DIM, 1.5, degree=1)
    return out.select("i", "j", "k", r("v", half=OFF).alias("v"), *(F.lit(float(M[n, 3])).alias(f"o{n + 1}") for n in range(3)))


def _reorient_sql():
    corners = np.array([[x, y, z, 1.0] for x in (1, DIM[0]) for y in (1, DIM[1]) for z in (1, DIM[2])]) @ OBLIQUE[:3].T
    low, high = np.round(corners.min(0)), np.round(corners.max(0))
    M = np.diag([1.5, 1.5, 1.5, 1.0])
    M[:3, 3] = low - 1.5
    side = np.ceil((high - low + 1.5) / 1.5).astype(int)
    places = ", ".join(f"({t})::DOUBLE AS y{n + 1}" for n, t in enumerate(_ijk(np.linalg.solve(OBLIQUE, M))))
    spots = ", ".join(f"floor(y{n + 1})::INT + d{n} AS p{n}" for n in range(3))
    near = " AND ".join(f"y{n + 1} BETWEEN 0 AND {d + 1}" for n, d in enumerate(DIM))
    weight = " * ".join(_linear(f"abs(y{n + 1} - p{n})") for n in range(3))
    return f"""WITH f AS (SELECT * FROM {_FULL}), g AS (SELECT i::INT AS i, j::INT AS j, k::INT AS k FROM range(1, {side[0] + 1}) a(i), range(1, {side[1] + 1}) b(j), range(1, {side[2] + 1}) c(k)), y AS (SELECT i, j, k, {places} FROM g),
    x AS (SELECT *, {spots} FROM y, range(2) a(d0), range(2) b(d1), range(2) c(d2) WHERE {near})
    SELECT y.i, y.j, y.k, {rs('coalesce(sum(' + weight.replace('y1', 'x.y1').replace('y2', 'x.y2').replace('y3', 'x.y3') + ' * f.v), 0)', half=OFF)} AS v, {', '.join(f'{float(M[n, 3])!r}::DOUBLE AS o{n + 1}' for n in range(3))}
    FROM y LEFT JOIN x USING (i, j, k) LEFT JOIN f ON f.i = p0 AND f.j = p1 AND f.k = p2 GROUP BY y.i, y.j, y.k"""


def nifti_round(spark, sf_dir):
    """The volume as image files of two kinds, one compressed, written by the sink and read again; a broken file gives nothing."""
    root, v = _folder(spark, "nifti"), volume(spark, sf_dir)
    for name, size, code, slope, inter in (("a.nii", (2.0, 1.0, 1.5), 64, 1.0, 0.0), ("b.nii.gz", (1.0, 1.0, 1.0), 4, 0.001, 1.0)):
        header = spark.range(1).select(F.lit(name).alias("name"), F.array(*map(F.lit, DIM)).alias("dim"), F.array(*(F.lit(float(x)) for x in np.diag([*size, 1.0]).ravel())).alias("mat"))
        nifti_sink.write(v.withColumn("name", F.lit(name)), header, root, code, slope, inter)
    _put(spark, f"{root}/c.nii", b"no image")
    got = nifti.read(spark, root).join(nifti.headers(spark, root).select("path", F.get("mat", F.lit(10)).alias("size")), "path")
    return got.select(F.regexp_extract("path", r"/([abc])\.", 1).alias("file"), "i", "j", "k", r("v", 3).alias("v"), r("size").alias("size"))


NIFTI = f"SELECT x.file, f.i, f.j, f.k, {rs('CASE WHEN x.file = chr(97) THEN f.v ELSE round_even((f.v - 1) / 0.001e0, 0) * 0.001e0 + 1 END', 3)} AS v, CASE WHEN x.file = 'a' THEN 1.5e0 ELSE 1e0 END AS size FROM {_FULL} f, (VALUES ('a'), ('b')) x(file)"

QUERIES = {
    "header_geometry": header_geometry, "bias_components": bias_components, "affine_basis": affine_basis, "linspace_vec": linspace_vec, "bias_bases": bias_bases,
    "average_header": average_header, "reorient": reorient, "nifti_round_trip": nifti_round,
}
ORACLE = {
    "header_geometry": _geometry_sql(), "bias_components": _COMPONENTS, "affine_basis": _basis_sql(), "linspace_vec": _LINSPACE, "bias_bases": _bases_sql(),
    "average_header": _average_sql(), "reorient": _reorient_sql(), "nifti_round_trip": NIFTI,
}
