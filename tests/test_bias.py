"""Bias fields against dense matrices and finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latmix.operators import bias, gmm

LAT, NB = (4, 3, 2), (3, 2, 2)
MODEL = gmm.Mixture(np.array([[1.0, 0.5, 2.0], [2.0, 1.5, 0.3]]), np.array([[[2.0, 0.3, 0.1], [0.3, 1.0, -0.2], [0.1, -0.2, 1.5]], np.diag([1.0, 2.0, 0.5])]), np.log([0.4, 0.6]))
COLS, Z = ["a", "b", "c"], ["z1", "z2"]


@pytest.fixture(scope="module")
def voxels():
    rng = np.random.default_rng(3)
    at = np.array([(i, j, k) for k in range(2) for j in range(3) for i in range(4)]) + 1
    at = at[rng.permutation(24)][:21]
    x = rng.uniform(0.3, 2.5, (len(at), 3))
    x[rng.uniform(size=x.shape) < 0.3] = np.nan
    z = rng.uniform(size=len(at))
    return at, x, np.stack([z, 1 - z], 1)


@pytest.fixture(scope="module")
def frame(spark, voxels):
    at, x, z = voxels
    rows = [(*map(int, a), *(None if np.isnan(v) else float(v) for v in b), *map(float, c)) for a, b, c in zip(at, x, z)]
    return spark.createDataFrame(rows, "i int, j int, k int, a double, b double, c double, z1 double, z2 double").repartition(3)


def full(at):
    rows = [b[at[:, d] - 1] for d, b in enumerate(bias.design(LAT, NB))]
    return np.einsum("na,nb,nc->ncba", *rows).reshape(len(at), -1)


def test_contraction(voxels):
    at = voxels[0]
    rng = np.random.default_rng(0)
    for bases, index in ((bias.design(LAT, NB), [at[:, d] for d in range(3)]), (bias.design(LAT[:1], NB[:1]), [at[:, 0]]), (bias.design(LAT[:2], NB[:2]), [at[:, 0], at[:, 1]])):
        c, own = rng.normal(size=(*(b.shape[1] for b in bases), 2)), bias.Contraction(bases, index)
        phi = None
        for b, x in zip(bases, index):
            phi = b[x - 1] if phi is None else (b[x - 1][:, :, None] * phi[:, None, :]).reshape(len(x), -1)
        flat = c.reshape(-1, 2, order="F")
        assert np.allclose(own.forward(c), phi @ flat)
        r = rng.normal(size=(len(at), 2))
        assert np.allclose(own.adjoint(r).reshape(-1, 2, order="F"), phi.T @ r)


@pytest.mark.parametrize("width", [None, (0.3, 0.0, 0.5)])
def test_derivatives(frame, voxels, width):
    at, x, z = voxels
    rng = np.random.default_rng(1)
    bases, n = bias.design(LAT, NB), 12
    coeff = {c: rng.normal(size=n) * 0.2 for c in COLS}

    def value(co):
        return -sum(bias.conditional(frame, COLS, Z, MODEL, bases, co, bin_width=width))

    g, h = bias.derivatives(frame, COLS, Z, MODEL, bases, coeff, bin_width=width)
    flat = g.ravel(order="F")
    for c, m in ((0, 0), (1, 5), (2, 11), (0, 7)):
        e = {q: v.copy() for q, v in coeff.items()}
        e[COLS[c]][m] += 1e-5
        up = value(e)
        e[COLS[c]][m] -= 2e-5
        assert flat[c * n + m] == pytest.approx((up - value(e)) / 2e-5, rel=1e-5, abs=1e-5)
    # the Hessian by voxel, and its products
    phi = full(at)
    y = x * np.exp(np.stack([phi @ coeff[c] for c in COLS], 1))
    var = None if width is None else (np.array(width) * np.exp(np.stack([phi @ coeff[c] for c in COLS], 1))) ** 2 / 12
    _, own, ll = bias.voxel_terms(y, z, MODEL, var)
    assert np.allclose(h, np.einsum("na,npq,nb->paqb", phi, own, phi).reshape(3 * n, 3 * n))
    v = rng.normal(size=(*NB, 2))
    got = bias.hessian_product(frame, COLS, Z, MODEL, bases, coeff, v, ["a", "c"], bin_width=width)
    pick = np.r_[0:n, 2 * n : 3 * n]
    assert np.allclose(got.ravel(order="F"), h[np.ix_(pick, pick)] @ v.ravel(order="F"))
    # log-likelihoods by marginal densities
    if width is None:
        for m in range(len(x)):
            o = np.flatnonzero(~np.isnan(x[m]))
            want = 0.0
            for k in range(2):
                s = np.linalg.inv(MODEL.A[k])[np.ix_(o, o)]
                d = y[m, o] - MODEL.mu[k, o]
                want += z[m, k] * -0.5 * (len(o) * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + d @ np.linalg.solve(s, d)) if len(o) else 0.0
            assert ll[m] == pytest.approx(want)


def test_steps_agree(frame, monkeypatch):
    """Conjugate gradients take the step of the summed Hessian."""
    bases, reg = bias.design(LAT, NB), bias.energy(LAT, NB, (1.0, 2.0, 1.0), absolute=0.1, bending=1.0)
    coeff = {c: np.linspace(-0.1, 0.1, 12) for c in COLS}
    steps = []
    for dense in (10**6, 0):
        monkeypatch.setattr(bias, "DENSE", dense)
        steps.append(bias.newton_step(frame, COLS, Z, MODEL, bases, coeff, reg, 2.0, COLS, ("i", "j", "k")))
    assert np.allclose(*steps, atol=1e-6)


@pytest.mark.parametrize("bnd", bias.BOUNDARIES)
def test_energies(bnd):
    vs, lat, nb = (0.5, 2.0), (5, 4), (3, 4)
    rng = np.random.default_rng(2)
    c = rng.normal(size=(*nb, 2))
    d = [bias.derivative_bases(n, k, v, bnd) for n, k, v in zip(lat, nb, vs)]
    f = lambda p, q: np.einsum("xa,yb,abc->xyc", d[0][p], d[1][q], c)
    total = lambda x: float((np.abs(x) ** 2).sum())
    J = np.stack([f(1, 0), f(0, 1)], -1)  # component, derivative
    want = {
        "absolute": total(f(0, 0)), "membrane": total(J), "bending": total(f(2, 0)) + total(f(0, 2)) + 2 * total(f(1, 1)),
        "elastic1": total((J + np.swapaxes(J, -1, -2)) / 2), "elastic2": total(J[..., 0, 0] + J[..., 1, 1]) / 2,
    }
    for term, w in want.items():
        e = bias.energy(lat, nb, vs, **{term: 1.0}, bnd=bnd)
        got = e.value(c) if e.count == 2 else e.value(c[..., :1]) + e.value(c[..., 1:])
        assert got == pytest.approx(w)
    e = bias.energy(lat, nb, vs, 0.1, 0.2, 0.3, 0.4, 0.5, bnd)
    flat = c.reshape(-1, 2, order="F").T.ravel()
    assert (flat @ e.dense() @ flat).real == pytest.approx(sum(x * w for x, w in zip((0.1, 0.2, 0.3, 0.4, 0.5), want.values())))
    assert np.allclose(e.diagonal().reshape(-1, 2, order="F").T.ravel(), np.diagonal(e.dense()).real)


def test_bases_are_orthonormal_and_derived():
    for bnd in bias.BOUNDARIES:
        b = bias.derivative_bases(6, 4, 0.5, bnd)[0]
        assert np.allclose(b.conj().T @ b, np.eye(4))
    with pytest.raises(ValueError):
        bias.derivative_bases(6, 4, 0.5, "open")
    assert np.allclose(bias.energy((4, 3), (3, 2), (0.5, 2.0), 0.1, 0.2, 0.3).dense(), bias.regulariser((4, 3), (3, 2), (0.5, 2.0), 0.1, 0.2, 0.3))


def test_joint_fit_and_schedule(spark):
    """Two channels with gaps under one known field each; the penalty is lowered step by step."""
    rng = np.random.default_rng(5)
    lat = (14, 10)
    b = bias.design(lat, (2, 2))
    true = {"a": np.array([0, 1.5, -1.0, 0.0]), "b": np.array([0, -1.0, 0.5, 0.5])}
    f = {c: b[0] @ v.reshape(2, 2, order="F") @ b[1].T for c, v in true.items()}
    rows = []
    for i, j in np.ndindex(*lat):
        k = rng.integers(2)
        x = [m * np.exp(-f[c][i, j]) * (1 + rng.normal() * 0.02) for c, m in (("a", (10, 30)[k]), ("b", (50, 20)[k]))]
        rows.append((i + 1, j + 1, *(None if rng.uniform() < 0.15 else float(v) for v in x)))
    img = spark.createDataFrame(rows, "i int, j int, a double, b double").repartition(3)
    for joint in (True, False):
        history = []
        coeff, model, trace = bias.fit(img, k=2, fwhm=14.0, reg=[1e3, 1e1, 1e-1], iterations=14, tolerance=1e-3, joint=joint, history=history, vs=(1.0, 1.0))
        weights = [h["weight"] for h in history]
        assert weights == sorted(weights, reverse=True) and set(weights) == {1e3, 1e1, 1e-1} and len(trace) == len(history)
        for a, c in zip(history, history[1:]):
            if a["weight"] == c["weight"]:
                assert c["objective"] >= a["objective"] - 1e-6 * abs(a["objective"])
        n = bias.components(lat, (1.0, 1.0), 14.0)
        for c in "ab":
            got = bias.design(lat, n)[0] @ coeff[c].reshape(n, order="F") @ bias.design(lat, n)[1].T
            assert np.corrcoef((got - got.mean()).ravel(), f[c].ravel())[0, 1] > 0.97
    assert bias.lattice_of(img) == (["a", "b"], lat)
    assert img.select("i", "j", "a").where(F.col("a").isNull()).count() > 5
