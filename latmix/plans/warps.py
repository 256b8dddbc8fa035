"""Queries: splines and chains of warps, on the volume of counted parts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import lattice, splines
from .common import OFF, r, rs
from .lattices import _FULL, A, DIM, volume

AXES = "ijk"


def spline_coefficients(spark, sf_dir):
    return splines.coefficients(volume(spark, sf_dir), DIM, 3, "circular").select("i", "j", "k", r("v", half=OFF).alias("v"))


def _coefficients_sql():
    """The inverse of a circulant (1, 4, 1) / 6 in closed form, axis by axis."""
    z = math.sqrt(3) - 2
    gain = -6 * z / (1 - z * z)
    src = _FULL
    for a, n in zip(AXES, DIM):
        rest = [x for x in AXES if x != a]
        far = f"abs(p.{a} - q.{a})"
        weight = f"{gain!r}::DOUBLE * (pow({z!r}::DOUBLE, {far}) + pow({z!r}::DOUBLE, {n} - {far})) / {1 - z**n!r}::DOUBLE"
        same = " AND ".join(f"p.{x} = q.{x}" for x in rest)
        src = f"(WITH s AS (SELECT * FROM {src}) SELECT p.i AS i, p.j AS j, p.k AS k, sum({weight} * q.v) AS v FROM s p JOIN s q ON {same} GROUP BY p.i, p.j, p.k)"
    return src


def warp_cubic(spark, sf_dir):
    out = lattice.sample(volume(spark, sf_dir), lattice.affine_warp(spark, A, DIM), DIM, degree=3)
    return out.select("i", "j", "k", r("v", half=OFF).alias("v"))


def _y(m):
    return [" + ".join(f"({float(m[n, c])!r}) * {a}" for c, a in enumerate(("y1", "y2", "y3"))) + f" + ({float(m[n, 3])!r})" for n in range(3)]


def _sampled_sql(field: str, places: str, values: list[str], reach: int, weight, keep: str) -> str:
    """Sums over neighbours with circular boundary: keep and values. places: keep, y1, y2, y3."""
    cols = [f"floor(y{n + 1})::INT + d{n} AS p{n}" for n in range(3)]
    spots = f"SELECT *, {', '.join(cols)} FROM {places}, {', '.join(f'(SELECT unnest(range({1 - reach}, {reach + 1})) AS d{n})' for n in range(3))}"
    on = " AND ".join(f"f.{a} = ((p{n} - 1) % {d} + {d}) % {d} + 1" for n, (a, d) in enumerate(zip(AXES, DIM)))
    w = " * ".join(weight(f"abs(y{n + 1} - p{n})") for n in range(3))
    keys = ", ".join(f"x.{c}" for c in keep.split(", "))
    return f"(SELECT {keys}, {', '.join(f'sum({w} * f.{v}) AS {v}' for v in values)} FROM ({spots}) x JOIN {field} f ON {on} GROUP BY {keys})"


def _cubic(x):
    return f"(CASE WHEN {x} < 1 THEN 2e0 / 3 - {x} * {x} + pow({x}, 3) / 2 WHEN {x} < 2 THEN pow(2 - {x}, 3) / 6 ELSE 0 END)"


def _linear(x):
    return f"greatest(0, 1 - {x})"


def _ijk(m):
    return [t.replace("y1", "i").replace("y2", "j").replace("y3", "k") for t in _y(m)]


def _cubic_sql():
    places = f"(SELECT i, j, k, {', '.join(f'{t} AS y{n + 1}' for n, t in enumerate(_ijk(A)))} FROM f)"
    return f"WITH f AS (SELECT * FROM {_FULL}), c AS (SELECT * FROM {_coefficients_sql()}) SELECT i, j, k, {rs('v', half=OFF)} AS v FROM {_sampled_sql('c', places, ['v'], 2, _cubic, 'i, j, k')}"


def _warps(spark, sf_dir):
    """Two warps made of the volume, in mm of voxels of 1 and of VS."""
    v = volume(spark, sf_dir)
    move = lambda s, f: v.select("i", "j", "k", *((F.col(a) * s + F.col("v") * F.lit(c)).alias(f"y{n + 1}") for n, (a, c) in enumerate(zip(AXES, f))))
    return move(2.0, (0.3, -0.2, 0.1)), move(1.0, (0.15, 0.25, -0.35))


def warp_chain(spark, sf_dir):
    one, two = _warps(spark, sf_dir)
    out = lattice.compose(A, (one, DIM, (2.0, 2.0, 2.0)), A, A, two)
    return out.select("i", "j", "k", *(r(f"y{n}", half=OFF).alias(f"y{n}") for n in (1, 2, 3)))


def _chain_sql():
    AA = A @ A
    two = "(SELECT i, j, k, i + 0.15e0 * v AS y1, j + 0.25e0 * v AS y2, k - 0.35e0 * v AS y3 FROM f)"
    moved = f"(SELECT i, j, k, {', '.join(f'{t} AS x{n + 1}' for n, t in enumerate(_y(AA)))} FROM {two})"
    places = f"(SELECT *, x1 / 2 AS y1, x2 / 2 AS y2, x3 / 2 AS y3 FROM {moved})"
    field = "(SELECT i, j, k, 0.3e0 * v AS u1, -0.2e0 * v AS u2, 0.1e0 * v AS u3 FROM f)"
    got = _sampled_sql(field, places, ["u1", "u2", "u3"], 1, _linear, "i, j, k, x1, x2, x3")
    last = [t.replace("y1", "(x1 + u1)").replace("y2", "(x2 + u2)").replace("y3", "(x3 + u3)") for t in _y(A)]
    return f"WITH f AS (SELECT * FROM {_FULL}) SELECT i, j, k, {', '.join(f'{rs(t, half=OFF)} AS y{n + 1}' for n, t in enumerate(last))} FROM {got}"


QUERIES = {"spline_coefficients": spline_coefficients, "warp_cubic": warp_cubic, "warp_chain": warp_chain}
ORACLE = {"spline_coefficients": f"SELECT i, j, k, {rs('v', half=OFF)} AS v FROM {_coefficients_sql()}", "warp_cubic": _cubic_sql(), "warp_chain": _chain_sql()}
