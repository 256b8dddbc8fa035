"""Splines against dense linear systems and the truncated-power form of the basis."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latmix.operators import lattice, splines

DIM = (6, 5, 1)


def beta(d, x):
    """The centred B-spline by truncated powers."""
    x = np.asarray(x, float)
    if d == 0:
        return ((x >= -0.5) & (x < 0.5)).astype(float)
    return sum((-1) ** k * math.comb(d + 1, k) * np.maximum(x + (d + 1) / 2 - k, 0) ** d for k in range(d + 2)) / math.factorial(d)


def shown(p, n, bnd):
    """The voxel that place p (an integer) shows, None outside."""
    if bnd == "circular":
        return (p - 1) % n + 1
    if bnd == "symmetric":
        r = (p - 1) % (2 * n)
        return r + 1 if r < n else 2 * n - r
    if bnd == "mirror":
        r = (p - 1) % max(2 * n - 2, 1)
        return r + 1 if r < n else 2 * n - 1 - r
    return p if 1 <= p <= n else None


def row(y, n, d, bnd):
    """Weights of the voxels of a line at place y."""
    out = np.zeros(n)
    for p in range(math.floor(y) - d - 1, math.floor(y) + d + 3):
        s = shown(p, n, bnd)
        if s:
            out[s - 1] += float(beta(d, y - p))
    return out


@pytest.mark.parametrize("d", range(2, 8))
def test_lines(d):
    rng = np.random.default_rng(d)
    for n, bnd in itertools.product((1, 2, 3, 9, 40), ("circular", "symmetric", "mirror")):
        x = rng.normal(size=(3, n))
        dense = np.array([row(i, n, d, bnd) for i in range(1, n + 1)])
        assert np.allclose(splines.filter_lines(x, d, bnd), np.linalg.solve(dense, x.T).T, atol=1e-9)


def test_pieces():
    for d in range(8):
        t = np.linspace(0, 0.999, 7)
        got = np.polynomial.polynomial.polyval(t, splines.pieces(d).T)
        assert np.allclose(got, [beta(d, t - (m - d) - (d + 1) / 2) for m in range(d + 1)])


def places(rng, n):
    y = rng.uniform(-9, 16, size=(n, 3))
    y[:5] = np.round(y[:5])
    return y


@pytest.mark.parametrize("d,bnd", [(3, "circular"), (3, "symmetric"), (2, "mirror"), (5, "circular"), (7, "symmetric"), (3, "replicate"), (3, "constant"), (1, "constant"), (1, "mirror"), (0, "symmetric"), (4, "mirror"), (6, "circular")])
def test_sample(spark, monkeypatch, d, bnd):
    monkeypatch.setattr(splines, "BRICK", 3)
    monkeypatch.setattr(splines, "PART", 4)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(2, *DIM))
    img = spark.createDataFrame([(int(i) + 1, int(j) + 1, int(k) + 1, float(v[0, i, j, k]), float(v[1, i, j, k])) for i, j, k in np.ndindex(*DIM)], "i int, j int, k int, v double, w double")
    y = places(rng, 60)
    warp = spark.createDataFrame([(n, 1, 1, *map(float, p)) for n, p in enumerate(y)] + [(100, 1, 1, None, 1.0, 1.0), (101, 1, 1, float("nan"), 1.0, 1.0)], "i int, j int, k int, y1 double, y2 double, y3 double")
    got = {r["i"]: (r["v"], r["w"]) for r in splines.sample(img, warp, DIM, ("v", "w"), d, bnd).collect()}
    inner = "mirror" if d > 1 and bnd in ("replicate", "constant") else bnd
    lines = [np.linalg.inv(np.array([row(i, n, d, inner) for i in range(1, n + 1)])) if d > 1 else np.eye(n) for n in DIM]
    for n, p in enumerate(y):
        own = np.clip(p, 1, DIM) if bnd == "replicate" else p
        w = [row(x, m, d, "mirror" if inner == "replicate" else inner) @ line for x, m, line in zip(own, DIM, lines)]
        want = np.einsum("cijk,i,j,k->c", v, *w)
        if d > 1 and bnd == "constant" and ((p < 1) | (p > DIM)).any():
            want = np.zeros(2)
        if d == 0 and (np.abs(p - np.floor(p) - 0.5) < 1e-9).any():
            continue
        assert np.allclose(got[n], want, atol=1e-9), (n, p)
    assert len(got) == 62 and got[100] == got[101] == (0.0, 0.0)


def test_bad_degree(spark):
    with pytest.raises(ValueError):
        splines.sample(spark.range(0), spark.range(0), DIM, degree=8)


def test_chain(spark):
    """Affine, warp, affine, affine, warp on two lattices against the same by hand."""
    rng = np.random.default_rng(6)
    small, vs, dim, vs0 = (4, 5, 3), (2.0, 1.0, 1.5), (3, 2, 2), (1.0, 2.0, 1.0)
    grid = lambda d, v: {tuple(p): (np.array(p) * v + rng.normal(size=3) * 0.3) for p in itertools.product(*(range(1, n + 1) for n in d))}
    one, two = grid(small, vs), grid(dim, vs0)
    frame = lambda w: spark.createDataFrame([(*p, *map(float, y)) for p, y in w.items()], "i int, j int, k int, y1 double, y2 double, y3 double")
    A, B, C = (np.vstack([np.hstack([np.eye(3) + rng.normal(size=(3, 3)) * 0.1, rng.normal(size=(3, 1))]), [0, 0, 0, 1]]) for _ in range(3))
    for d in (1, 3):
        got = {(r["i"], r["j"], r["k"]): np.array([r["y1"], r["y2"], r["y3"]]) for r in lattice.compose(A, (frame(one), small, vs), B, C, (frame(two), dim, vs0), degree=d).collect()}
        u = np.zeros((3, *small))
        for p, y in one.items():
            u[(slice(None), *(np.array(p) - 1))] = y - np.array(p) * vs
        lines = [np.linalg.inv(np.array([row(i, n, d, "circular") for i in range(1, n + 1)])) for n in small]
        for p, y in two.items():
            y = (B @ C @ [*y, 1])[:3]
            w = [row(x / s, n, d, "circular") @ line for x, s, n, line in zip(y, vs, small, lines)]
            y = y + np.einsum("cijk,i,j,k->c", u, *w)
            assert np.allclose(got[p], (A @ [*y, 1])[:3], atol=1e-9)
    with pytest.raises(ValueError):
        lattice.compose(frame(one), A)
    assert lattice.compose(A, frame(two)).count() == len(two)
