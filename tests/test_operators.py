"""Operators against numpy and against what must hold of them."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latmix.functions import linalg, special
from latmix.operators import bias, gmm, histogram, kmeans, lattice, sparse
from latmix.sources import catalog, nifti
from latmix.streaming import scoring


def test_special_functions(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 7.0, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(F.expr(special.lgamma("x")), F.expr(special.digamma("x")), F.expr(special.digamma("x + 1e0")), F.expr(special.trigamma("x")), F.expr(special.trigamma("x + 1e0"))).collect()
    for x, (lg, d, d1, t, t1) in zip(xs, got):
        assert lg == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-10)
        assert d1 == pytest.approx(d + 1 / x, rel=1e-10) and t1 == pytest.approx(t - 1 / x**2, rel=1e-9)
        assert d == pytest.approx(special.np_digamma(x), rel=1e-12)


def test_linalg():
    a = np.array([[4.0, 1.0], [1.0, 3.0]])
    assert linalg.logdet(a) == pytest.approx(math.log(11))
    assert np.allclose(linalg.inverse(a) @ a, np.eye(2))
    assert np.linalg.eigvalsh(linalg.threshold_eig(np.array([[1.0, 2.0], [2.0, 1.0]]))).min() > 0
    assert np.linalg.cond(linalg.load_diag(np.ones((2, 2)))) < 1e5 * 1.1


def obs(spark, gaps=True, n=300):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal([0, 0], 1, (n, 2)), rng.normal([6, 5], 1, (n, 2))])
    rows = [(i, float(a), None if gaps and i % 7 == 0 else float(b)) for i, (a, b) in enumerate(x)] + ([(10_000, None, None)] if gaps else [])
    return spark.createDataFrame(rows, "id long, a double, b double")


def test_mixture_bound_and_centres(spark):
    df = obs(spark)
    m = gmm.fit(df, ["a", "b"], 2, start="kmeans", iterations=20)
    assert all(y >= x - 1e-6 for x, y in zip(m.bound, m.bound[1:]))
    assert np.allclose(m.mu[np.argsort(m.mu[:, 0])], [[0, 0], [6, 5]], atol=0.3)
    z = gmm.score(df, ["a", "b"], m)
    assert z.select(F.abs(F.aggregate("z", F.lit(0.0), lambda s, v: s + v) - 1).alias("e")).agg(F.max("e")).head()[0] < 1e-9
    empty = z.where("id = 10000").head()["z"]
    assert np.allclose(empty, m.pi)
    filled = gmm.infer_missing(z, ["a", "b"], m)
    assert filled.where("b IS NULL").count() == 0
    assert gmm.score(df, ["a", "b"], m, missing=False).where("z[0] IS NULL").count() == df.where("b IS NULL OR a IS NULL").count()


def test_variational_mixture(spark):
    prior = gmm.make_prior(2, 2, mu=[3.0, 3.0], b=1e-2, V=np.eye(2) * 0.5, n=3.0, alpha=1.0)
    m = gmm.fit(obs(spark), ["a", "b"], 2, prior=prior, start="kmeans", iterations=15)
    assert all(y >= x - 1e-5 * abs(x) for x, y in zip(m.bound[1:], m.bound[2:]))
    assert gmm.kl_dirichlet([2.0, 3.0], [2.0, 3.0]) == pytest.approx(0) and gmm.kl_dirichlet([2.0, 3.0], [1.0, 1.0]) > 0
    assert gmm.kl_wishart(np.eye(2), 4, np.eye(2), 4) == pytest.approx(0) and gmm.kl_wishart(np.eye(2), 5, 2 * np.eye(2), 4) > 0
    hyper = gmm.update_hyper([m, m])
    assert np.allclose(hyper.mu, m.mu)
    split = gmm.more_gaussians(m, [0, 0, 1])
    assert len(split.mu) == 3 and len(gmm.collapse_gaussians(split, [0, 0, 1]).mu) == 2


def test_completed_statistics_match_dense():
    stats = {3: (np.array([5.0]), np.array([[1.0, 2.0]]), np.array([[[3.0, 0.5], [0.5, 4.0]]]))}
    s0, s1, s2 = gmm.complete(stats, np.zeros((1, 2)), np.eye(2)[None])
    assert np.allclose(s0, [5]) and np.allclose(s1, [[1, 2]]) and np.allclose(s2, stats[3][2])


def test_kmeans(spark):
    df = obs(spark)
    for init in ("plus", "sample", "uniform", "linspace"):
        c, cost, sums = kmeans.fit(df, ["a", "b"], 2, init=init, replicates=2, seed=1)
        assert np.allclose(c[np.argsort(c[:, 0])], [[0, 0], [6, 5]], atol=0.6) and cost == pytest.approx(sums.sum())
    tied = kmeans.assign(spark.createDataFrame([(0.0,)], "a double"), ["a"], [[1.0], [-1.0]]).head()
    assert tied["label"] == 1
    far = kmeans.fit(df, ["a", "b"], init=[[0, 0], [6, 5], [900, 900]], iterations=3, order=None)[0]
    assert np.allclose(far[2], [900, 900])  # an empty cluster keeps its centroid
    with pytest.raises(ValueError):
        kmeans.ordered(np.zeros((2, 1)), np.zeros(2), "random")


def test_missing_values_have_a_bin_of_their_own(spark):
    df = spark.createDataFrame([(0.0, 1.0), (4.0, None), (4.0, 2.0), (None, 2.0), (None, None)], "a double, b double")
    got = {(r["bin_a"], r["bin_b"]): (r["v_a"], r["v_b"], r["w"]) for r in histogram.histogram(df, ["a", "b"], [2, 4], keep_zero=False, missing=True).collect()}
    assert got == {(0, 0): (1.0, 1.125, 1.0), (1, 4): (3.0, None, 1.0), (1, 3): (3.0, 1.875, 1.0), (2, 3): (None, 1.875, 1.0), (2, 4): (None, None, 1.0)}


def test_histogram_keeps_weight(spark):
    df = obs(spark).withColumn("w", F.lit(2.0))
    for missing in (False, True):
        h = histogram.histogram(df, ["a", "b"], [8, 5], weight="w", missing=missing)
        n = df.count() if missing else df.na.drop().count()
        assert h.agg(F.sum("w")).head()[0] == pytest.approx(2 * n) and h.count() == (8 + missing) * (5 + missing)
    one = histogram.histogram(spark.createDataFrame([(1.0,)] * 3, "x double"), ["x"], 4)
    assert one.agg(F.sum("w")).head()[0] == 3


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["row"], r["col"]] += r["val"]
    return out


@pytest.mark.parametrize("param", [(1, 0, 0, 0, 0), (0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (0, 0, 0, 1, 0), (0, 0, 0, 0, 1)])
def test_precision_against_stencils(spark, param):
    """Energy of random fields against sums of squared differences, means over one-sided directions."""
    lat, vs = (3, 3, 2), (0.5, 0.4, 0.3)
    n = math.prod(lat)
    L = dense(sparse.precision(spark, lat, vs, param), 3 * n)
    assert np.allclose(L, L.T)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3, *lat))

    def diff(f, d, s):
        out = np.zeros_like(f)
        a, b = [slice(None)] * 3, [slice(None)] * 3
        a[d], b[d] = slice(0, -1), slice(1, None)
        gap = (f[tuple(b)] - f[tuple(a)]) / vs[d]
        out[tuple(a if s > 0 else b)] = gap
        return out

    def adj(f, d, s):  # transpose of diff
        e = np.zeros_like(f)
        for idx in np.ndindex(*lat):
            unit = np.zeros(lat)
            unit[idx] = 1
            e[idx] = (diff(unit, d, s) * f).sum()
        return e

    signs = (1, -1)
    if param[0]:
        want = (v**2).sum()
    elif param[1]:
        want = sum((diff(v[c], i, s) ** 2).sum() / 2 for c in range(3) for i in range(3) for s in signs)
    elif param[2]:
        want = sum((adj(diff(v[c], i, s), i, s) ** 2).sum() / 2 for c in range(3) for i in range(3) for s in signs)
        want += sum((diff(diff(v[c], j, t), i, s) ** 2).sum() / 4 for c in range(3) for i in range(3) for j in range(3) if i != j for s in signs for t in signs)
    else:
        want = 0
        for dirs in itertools.product(signs, repeat=3):
            J = [[diff(v[c], i, dirs[i]) for i in range(3)] for c in range(3)]
            if param[3]:
                want += sum(((J[c][i] + J[i][c]) ** 2).sum() / 2 for c in range(3) for i in range(3)) / 8
            else:
                want += (sum(J[c][c] for c in range(3)) ** 2).sum() / 8
    flat = np.concatenate([v[c].ravel(order="F") for c in range(3)])
    assert flat @ L @ flat == pytest.approx(want, rel=1e-9)


def test_impulse_is_kernel(spark):
    lat = (3, 3, 3)
    L = sparse.precision(spark, lat, (0.5, 0.4, 0.3), (0, 1, 0, 0, 0), "circulant")
    impulse = spark.createDataFrame([(0, 1.0)], "idx long, v double")
    a = {r["idx"]: r["v"] for r in sparse.spmv(L, impulse).collect()}
    b = {r["component"] * 27 + r["idx"]: r["v"] for r in sparse.kernel(L, lat).collect()}
    assert a == pytest.approx(b)


def test_adjoint(spark):
    rng = np.random.default_rng(1)
    dim = (4, 3, 1)
    img = lattice.lattice(spark, dim).withColumn("v", F.rand(3))
    g = lattice.gradient(img)
    div = lattice.divergence(g, dim).withColumnRenamed("v", "d")
    lhs = g.agg(F.sum(F.col("di") ** 2 + F.col("dj") ** 2 + F.col("dk") ** 2)).head()[0]
    assert img.join(div, ["i", "j", "k"]).agg(F.sum(F.col("v") * F.col("d"))).head()[0] == pytest.approx(lhs) and rng is not None


def test_geometry():
    M = np.diag([2.0, 1.0, 1.5, 1.0])
    assert np.allclose(lattice.union_boxes([lattice.world_box(M, (2, 2, 2)), lattice.world_box(M, (4, 1, 1))])[1], [8, 2, 3])
    assert len(lattice.affine_basis("affine")) == 12 and len(lattice.affine_basis("similitude")) == 7 and len(lattice.affine_basis("rigid", True)) == 3
    mean, dims = lattice.average_affine([M, M], [(4, 4, 4), (4, 4, 4)])
    assert np.allclose(mean, M) and dims == (4, 4, 4)


def test_resize_and_downsample(spark):
    dim = (4, 4, 2)
    img = lattice.lattice(spark, dim).withColumn("v", F.col("i").cast("double"))
    out, mat, new = lattice.resize(img, np.eye(4), dim, (1.0, 1.0, 1.0))
    assert new == dim and out.agg(F.sum("v")).head()[0] == pytest.approx(img.agg(F.sum("v")).head()[0])
    small, _, d = lattice.downsample(img, np.diag([0.5, 0.5, 1, 1]), dim)
    assert d == (2, 2, 2) and small.count() == 8


def test_bias_field_recovered(spark):
    b = bias.dct_basis(12, 2)
    assert np.allclose(b.T @ b, np.eye(2))
    rng = np.random.default_rng(0)
    rows = [(i + 1, j + 1, float((10 if (i + j) % 2 else 30) * math.exp(0.3 * math.cos(math.pi * (i + 0.5) / 12)) + rng.normal(0, 0.2))) for i in range(12) for j in range(12)]
    img = spark.createDataFrame(rows, "i int, j int, c double")
    coeff, _, trace = bias.fit(img, ["c"], (12, 12), (1.0, 1.0), 2, fwhm=12.0, reg=1e-3, iterations=3)
    assert trace[-1] >= trace[0]


def test_catalogue_from_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a.json").write_text(json.dumps([{"name": "n1", "population": "p", "modality": "MRI", "channel": "T1", "pth": " x.nii ", "age": "3"}, {"modality": "no name"}]))
    (tmp_path / "sub" / "b.JSON").write_text(json.dumps({"name": "n1", "population": "p", "modality": "MRI", "channel": "T2", "age": "4"}))
    (tmp_path / ".hidden" / "c.json").write_text(json.dumps({"name": "n2"}))
    recs = catalog.read_records(spark, str(tmp_path))
    assert recs.count() == 3
    one = catalog.subjects(recs).collect()
    assert len(one) == 1 and one[0]["subject"] == "p_n1" and one[0]["open"] == {"age": "4"} and [c["channel"] for c in one[0]["modalities"][0]["channels"]] == ["T1", "T2"]
    cut = catalog.keep_channels(catalog.subjects(recs), ["T2"]).head()
    assert [c["channel"] for c in cut["modalities"][0]["channels"]] == ["T2"]
    folder = recs.where("channel = 'T1'").head()["file"].rsplit("/", 1)[0]
    listing = spark.createDataFrame([(f"{folder}/x.nii",), (f"{folder}/sub/b.img",)], "path string")
    paths = {r["channel"]: r["pth"] for r in catalog.resolve_paths(catalog.validate(recs), listing).collect()}
    assert paths["T1"].endswith("/x.nii") and paths["T2"].endswith("sub/b.img")
    both = catalog.merge_catalogues(catalog.subjects(recs), catalog.subjects(recs))
    assert both.count() == 1


def test_nifti_round_trip(spark, tmp_path):
    x = np.arange(24, dtype=float).reshape(2, 3, 4)
    (tmp_path / "v.nii").write_bytes(nifti.build(x, np.eye(4)))
    (tmp_path / "bad.nii").write_bytes(b"nonsense")
    rows = nifti.read(spark, str(tmp_path)).collect()
    assert len(rows) == 24 and all(x[r["i"] - 1, r["j"] - 1, r["k"] - 1] == r["v"] for r in rows)
    assert nifti.headers(spark, str(tmp_path)).count() == 1


def test_stream_scores_like_a_table(spark, tmp_path):
    df = obs(spark)
    src = str(tmp_path / "in")
    df.write.parquet(src)
    m = gmm.Mixture(np.array([[0.0, 0.0], [6.0, 5.0]]), np.tile(np.eye(2), (2, 1, 1)), np.log([0.5, 0.5]))
    stream = scoring.score_mixture(scoring.read(spark, src, df.schema, 100), ["a", "b"], m).select("id", F.col("z")[0].alias("z"))
    q = scoring.append_to(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = {r["id"]: r["z"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx({r["id"]: r["z"][0] for r in gmm.score(df, ["a", "b"], m).collect()})
