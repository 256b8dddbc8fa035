"""The mixture's core against plain loops over rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latmix.functions import special
from latmix.operators import gmm
from latmix.plans import mixtures
from latmix.plans.common import gaps

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    k = rng.integers(2, size=300)
    x = np.array([[0.0, 1.0, 2.0], [4.0, 3.0, 1.0]])[k] + rng.normal(size=(300, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.3], [0, 0, 1]])
    x[rng.uniform(size=x.shape) < 0.25] = np.nan
    return x


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(n, *(None if np.isnan(v) else float(v) for v in r)) for n, r in enumerate(rows)], "id long, a double, b double, c double").repartition(3)


START = gmm.Mixture(np.array([[0.5, 0.5, 1.5], [3.0, 3.0, 1.5]]), np.tile(np.eye(3), (2, 1, 1)), np.log([0.5, 0.5]))


def by_rows(x, model, prior, rounds, sub_tolerance):
    """The same fit with loops over rows: marginal densities by inverses of covariance blocks."""
    mu, A, logpi, b, V, n, alpha = model.mu, model.A, model.logpi, None, None, None, None
    k, p = mu.shape
    bounds = []

    def density(r, c, mu, A, b, V, n):
        o = np.flatnonzero(~np.isnan(r))
        if not len(o):
            return 0.0
        d = r[o] - mu[c, o]
        if V is None:
            P = np.linalg.inv(np.linalg.inv(A[c])[np.ix_(o, o)])
            return 0.5 * (np.linalg.slogdet(P)[1] - len(o) * math.log(2 * math.pi) - d @ P @ d)
        W, m = np.linalg.inv(np.linalg.inv(V[c])[np.ix_(o, o)]), n[c] - (p - len(o))
        elog = special.np_mv_digamma(m / 2, len(o)) + len(o) * math.log(2) + np.linalg.slogdet(W)[1]
        return 0.5 * (elog - len(o) * math.log(2 * math.pi) - m * d @ W @ d - len(o) / b[c])

    def kl(mu, A, b, V, n):
        return 0.0 if prior is None or V is None else gmm.kl_gauss_wishart(gmm.Mixture(mu, A, logpi, b, V, n), prior)

    def passed():
        lp = np.array([[density(r, c, mu, A, b, V, n) for c in range(k)] for r in x])
        q = lp + logpi
        z = np.exp(q - q.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        seen = ~np.isnan(x).all(1)
        total = (z * (lp + logpi - np.log(z)))[seen].sum() - kl(mu, A, b, V, n)
        bounds.append(total - (gmm.kl_dirichlet(alpha, prior.alpha) if alpha is not None else 0.0))
        return z * seen[:, None]

    for _ in range(rounds):
        z = passed()
        inner = [sum(z[r, c] * density(x[r], c, mu, A, b, V, n) for r in range(len(x)) for c in range(k)) - kl(mu, A, b, V, n)]
        while True:
            for _ in range(4):
                s0, s1, s2 = z.sum(0), np.zeros((k, p)), np.zeros((k, p, p))
                for c in range(k):
                    for r in range(len(x)):
                        o, m = np.flatnonzero(~np.isnan(x[r])), np.flatnonzero(np.isnan(x[r]))
                        y, e = x[r].copy(), np.zeros((p, p))
                        if len(m):
                            inv = np.linalg.inv(A[c][np.ix_(m, m)])
                            y[m] = mu[c, m] - inv @ A[c][np.ix_(m, o)] @ (x[r, o] - mu[c, o])
                            e[np.ix_(m, m)] = inv
                        s1[c] += z[r, c] * y
                        s2[c] += z[r, c] * (np.outer(y, y) + e)
                mu, A, b, V, n = gmm.update_clusters(s0, s1, s2, prior)
            inner.append(sum(z[r, c] * density(x[r], c, mu, A, b, V, n) for r in range(len(x)) for c in range(k)) - kl(mu, A, b, V, n))
            if inner[-1] - inner[-2] <= max(sub_tolerance * (max(inner[1:]) - min(inner[1:])), np.finfo(np.float32).eps * abs(inner[-1])):
                break
        logpi, alpha = gmm.update_proportions(z.sum(0), None if prior is None else prior.alpha)
    passed()
    return mu, A, logpi, bounds


@pytest.mark.parametrize("kind", ["ml", "vb"])
def test_fit_by_rows(frame, rows, kind):
    prior = None if kind == "ml" else gmm.make_prior(2, 3, mu=[1.0, 1.0, 1.0], b=0.5, V=0.3 * np.eye(3), n=5.0, alpha=2.0)
    got = gmm.fit(frame, COLS, 2, prior=prior, start=START, iterations=3, tolerance=0.0, sub_tolerance=0.05)
    mu, A, logpi, bounds = by_rows(rows, START, prior, 3, 0.05)
    assert np.allclose(got.mu, mu) and np.allclose(got.A, A) and np.allclose(got.logpi, logpi)
    assert np.allclose(got.bound, bounds) and len(got.bound) == 4
    assert all(y >= x - 1e-9 for x, y in zip(got.bound[1:], got.bound[2:]))


def test_sub_em_gains_and_stops(frame):
    stats, _ = gmm._pass(frame, COLS, START, None, None, None, None, None)
    trace = []
    one = gmm.sub_em(stats, START, None, 500, 1e-9, trace)
    assert all(b >= a - 1e-8 for a, b in zip(trace, trace[1:])) and len(trace) > 3
    again = gmm.sub_em(stats, gmm.Mixture(one[0], one[1], START.logpi), None, 500, 1e-9)
    assert np.allclose(one[0], again[0], atol=1e-2)


def test_many_channels_need_only_patterns_that_occur(spark):
    """Sixteen channels: 65,536 patterns, of which three occur."""
    p, rng = 16, np.random.default_rng(0)
    x = rng.normal(size=(40, p))
    x[::3, :9], x[1::3, 12:] = np.nan, np.nan
    cols = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{c} double" for c in cols))
    model = gmm.Mixture(rng.normal(size=(2, p)), np.tile(np.eye(p) + 0.1, (2, 1, 1)), np.log([0.3, 0.7]))
    assert len(gmm.observed_codes(df, cols)) == 3
    got = gmm.infer_missing(gmm.score(df, cols, model), cols, model).collect()
    for r, row in zip(got, x):
        o, m = np.flatnonzero(~np.isnan(row)), np.flatnonzero(np.isnan(row))
        cov = np.linalg.inv(model.A[0])
        P = np.linalg.inv(cov[np.ix_(o, o)])
        q = np.array([math.log(w) - 0.5 * (row[o] - mu[o]) @ P @ (row[o] - mu[o]) for w, mu in zip((0.3, 0.7), model.mu)])
        z = np.exp(q - q.max())
        z /= z.sum()
        assert np.allclose(r["z"], z)
        if len(m):
            want = sum(z[k] * (model.mu[k, m] + cov[np.ix_(m, o)] @ P @ (row[o] - model.mu[k, o])) for k in range(2))
            assert np.allclose([r[cols[c]] for c in m], want)
    assert len(gmm.fit(df, cols, 2, start=model, iterations=1, prior=gmm.make_prior(2, p, n=p + 2.0)).mu) == 2


def test_draws(spark):
    """Moments by pattern, and no dependence on partitions."""
    model = gmm.Mixture(np.array([[1.0, 2.0, 3.0]]), np.array([[[2.0, 0.6, 0.3], [0.6, 1.5, -0.4], [0.3, -0.4, 1.0]]]), np.zeros(1))
    n = 6000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0.5).alias("a"), F.when(F.col("id") % 3 == 1, 2.5).alias("b"), F.when(F.col("id") % 3 != 0, 1.0).alias("c"))
    draw = lambda d, seed=1: {r["id"]: np.array([r["a"], r["b"], r["c"]]) for r in gmm.infer_missing(gmm.score(d, COLS, model), COLS, model, sample=seed, key=("id",)).collect()}
    one, cov = draw(df), np.linalg.inv(model.A[0])
    other = draw(df.repartition(7))
    assert all((one[i] == other[i]).all() for i in one) and any((one[i] != v).any() for i, v in draw(df, 2).items())
    for kind, o in ((0, [0]), (1, [1, 2]), (2, [2])):
        m = [c for c in range(3) if c not in o]
        x = np.array([v for i, v in one.items() if i % 3 == kind])
        gain = cov[np.ix_(m, o)] @ np.linalg.inv(cov[np.ix_(o, o)])
        assert np.allclose(x[:, m].mean(0), model.mu[0, m] + gain @ (x[0, o] - model.mu[0, o]), atol=0.08)
        assert np.allclose(np.atleast_2d(np.cov(x[:, m].T)), cov[np.ix_(m, m)] - gain @ cov[np.ix_(o, m)], atol=0.1)


def test_shared_prior():
    rng = np.random.default_rng(9)
    fits = []
    for _ in range(6):
        V = np.array([np.linalg.inv(a @ a.T + np.eye(2)) for a in rng.normal(size=(3, 2, 2))]) / np.array([1.0, 5.0, 30.0])[:, None, None]
        fits.append(gmm.Mixture(rng.normal(size=(3, 2)), V, np.zeros(3), rng.uniform(5, 20, 3), V, rng.uniform(8, 30, 3)))
    h = gmm.shared_hyper(fits, 5000, 1e-15)
    elog = lambda V, p: special.np_mv_digamma(p / 2, 2) + 2 * math.log(2) + np.linalg.slogdet(V)[1]
    for k in range(3):
        assert np.allclose(np.linalg.inv(h.V[k]), np.linalg.inv(h.V0) + sum(f.n[k] * f.V[k] for f in fits))
        assert h.p[k] == pytest.approx(h.p0 + 6 * h.prior.n[k])
        seen = np.mean([np.linalg.slogdet(f.V[k])[1] + special.np_mv_digamma(f.n[k] / 2, 2) for f in fits])
        assert special.np_mv_digamma(h.prior.n[k] / 2, 2) - elog(h.V[k], h.p[k]) == pytest.approx(seen, abs=1e-6)
    assert h.p0 * h.V0 == pytest.approx(np.einsum("k,kij->ij", h.p, h.V) / 3, rel=1e-3)
    assert elog(h.V0, h.p0) == pytest.approx(np.mean([elog(h.V[k], h.p[k]) for k in range(3)]), abs=1e-3)
    assert np.isfinite(h.bound).all()
    assert special.np_trigamma(1.0) == pytest.approx(math.pi**2 / 6) and special.np_mv_trigamma(3.0, 2) == pytest.approx((special.np_mv_digamma(3.0 + 1e-5, 2) - special.np_mv_digamma(3.0 - 1e-5, 2)) / 2e-5, rel=1e-6)


def test_a_pass_is_one_job_over_equal_rows_merged(spark, monkeypatch):
    """All parts of the rows at once, not one after the other; what repeats is scored once a part."""
    cols = ["a", "b"]
    i = F.col("id")
    df = spark.range(0, 6000, 1, 3).select((i % 5).cast("double").alias("a"), F.when(i % 3 != 0, i % 7 / 2.0).alias("b"))
    start = gmm.Mixture(np.array([[1.0, 1.0], [3.0, 2.0]]), np.tile(np.eye(2), (2, 1, 1)), np.log([0.5, 0.5]))
    seen, jobs, plain = [], [], gmm._pass

    def watched(rows, *args):
        seen.append((rows.count(), rows.agg(F.sum("__w")).head()[0]))
        spark.sparkContext.setJobGroup(f"pass {len(seen)}", "")
        out = plain(rows, *args)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pass {len(seen)}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out

    monkeypatch.setattr(gmm, "_pass", watched)
    prior = gmm.make_prior(2, 2, mu=[2.0, 1.5], b=0.5, n=3.0, alpha=1.0)
    got = gmm.fit(df, cols, prior=prior, start=start, iterations=2, tolerance=0.0)
    assert jobs == [1, 1, 1] and all(n <= 3 * 5 * 8 for n, _ in seen) and {w for _, w in seen} == {6000.0}
    monkeypatch.setattr(gmm, "merge_equal", lambda rows, weight: rows)
    want = gmm.fit(df, cols, prior=prior, start=start, iterations=2, tolerance=0.0)
    assert seen[-1][0] == 6000 and np.allclose(got.mu, want.mu) and np.allclose(got.A, want.A) and np.allclose(got.bound, want.bound)


@pytest.mark.parametrize("held", [1, 2000, 1 << 25])
def test_merging_keeps_every_weight(spark, monkeypatch, held):
    """In pieces of any size: nulls, NaN, weights of their own, and rows that don't repeat."""
    monkeypatch.setattr(gmm, "HELD", held)
    i = F.col("id")
    value = F.when(i % 4 == 0, None).when(i % 4 == 1, math.nan).when(i % 4 == 2, 1.5).otherwise(i.cast("double"))
    df = spark.range(0, 900, 1, 2).select(value.alias("x"), F.when(i % 3 != 0, "s").alias("tag"), (i % 10).cast("double").alias("w")).repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = gmm.merge_equal(df, "w").persist()
        total = lambda d: sorted(map(str, d.groupBy("x", "tag").agg(F.sum("w")).collect()))
        assert got.columns == ["x", "tag", "w"] and total(got) == total(df)
        assert got.count() < 600 if held > 2000 else got.count() <= 900
        got.unpersist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spoilt = gmm.merge_equal(df.withColumn("w", F.when(F.col("tag") == "s", F.col("w"))), "w")
    assert spoilt.where(F.isnan("w") != F.col("tag").isNull()).count() == 0


@pytest.mark.parametrize("limit", [None, 1000])
def test_rounds_go_on_until_what_they_reach_is_steady(spark, limit):
    """One channel in plain numpy: a round's bound is of its new model under the responsibilities that made it, and the start has none."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(2.2, 1, 200)])
    prior = gmm.make_prior(2, 1, mu=[[0.5], [1.5]], b=0.1, V=1.0, n=2.0, alpha=1.0)
    start = gmm.Mixture(np.array([[0.9], [1.2]]), np.ones((2, 1, 1)), np.log([0.5, 0.5]))
    mu, half, a, logpi = start.mu[:, 0], np.zeros(2), np.ones(2), start.logpi
    logs = lambda: half - 0.5 * math.log(2 * math.pi) - 0.5 * a * (x[:, None] - mu) ** 2
    reached = []
    while len(reached) < 3 or abs(reached[-1] - reached[-2]) > 1e-4 * (max(reached) - min(reached)):
        z = np.exp(logs() + logpi)
        z /= z.sum(1, keepdims=True)
        s = z.sum(0)
        b, n = 0.1 + s, 2.0 + s
        mu = (z.T @ x + 0.1 * prior.mu[:, 0]) / b
        V = 1 / (z.T @ x**2 + 0.1 * prior.mu[:, 0] ** 2 - b * mu**2 + 1.0)
        a, half = n * V, 0.5 * (np.array([special.np_digamma(v / 2) for v in n]) + math.log(2) + np.log(V)) - 0.5 / b
        logpi, alpha = gmm.dirichlet_logpi(1.0 + s), 1.0 + s
        now = gmm.Mixture(mu[:, None], a[:, None, None], logpi, b, V[:, None, None], n, alpha)
        reached.append((z * (logs() + logpi - np.log(z))).sum() - gmm.kl_gauss_wishart(now, prior) - gmm.kl_dirichlet(alpha, prior.alpha))
    got = gmm.fit(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"], prior=prior, start=start, iterations=limit)
    assert len(reached) > 30 and len(got.bound) == len(reached) + 1
    assert np.allclose(got.mu[:, 0], mu) and np.allclose(got.alpha, alpha)


def test_parts_of_what_a_round_reaches(spark, frame):
    """With labels, weights of clusters in their class and the width of bins: the rounds still gain, and end."""
    df = frame.withColumns({"g0": F.when(F.col("id") % 5 == 0, math.log(0.8)).otherwise(math.log(0.5)), "g1": F.when(F.col("id") % 5 == 0, math.log(0.2)).otherwise(math.log(0.5))})
    prior = gmm.make_prior(2, 3, mu=[1.0, 1.0, 1.0], b=0.5, V=0.3 * np.eye(3), n=5.0, alpha=2.0)
    got = gmm.fit(df, COLS, prior=prior, start=START, iterations=None, sub_iterations=None, label_logs=["g0", "g1"], bin_width=0.5, lkp=[0, 0])
    again = gmm.fit(df, COLS, prior=prior, start=START, iterations=2000, label_logs=["g0", "g1"], bin_width=0.5, lkp=[0, 0])
    assert 4 <= len(got.bound) < 500 and len(got.bound) == len(again.bound) and np.allclose(got.mu, again.mu)


def test_query_has_no_limit_of_rounds(spark, monkeypatch):
    """By the rule of the rounds, a fit of sf0.001 takes more than thirty."""
    seen, plain = [], gmm._pass
    monkeypatch.setattr(gmm, "_pass", lambda *args: seen.append(1) or plain(*args))
    got = {r["k"]: r for r in mixtures.gmm_fit_variational(spark, "/root/testdata/sf0.001").collect()}
    assert len(seen) > 31
    prior = gmm.make_prior(2, 3, mu=[2.5, 2.5, 2.0], b=1e-2, V=0.5 * np.eye(3), n=4.0, alpha=1.0)
    rows = gaps(spark, "/root/testdata/sf0.001")
    long = gmm.fit(rows, mixtures.COLS, prior=prior, start=mixtures.MODEL, iterations=len(seen) - 1, tolerance=-1.0)
    assert all(np.allclose([got[k + 1][c] for c in ("x1", "x2", "x3")], long.mu[k]) for k in range(2))


@pytest.mark.parametrize("odd", [math.inf, None])
def test_rounds_without_a_limit_end_on_odd_rows(spark, odd):
    """Bounds that are no numbers, and no row at all, end the rounds."""
    df = spark.createDataFrame([(0.0, 1.0), (odd, 2.0), (3.0, None)], "a double, b double").where(F.lit(odd is not None))
    prior = gmm.make_prior(2, 2, mu=[1.0, 1.0], b=0.5, n=3.0, alpha=1.0)
    start = gmm.Mixture(np.array([[0.0, 0.0], [2.0, 2.0]]), np.tile(np.eye(2), (2, 1, 1)), np.log([0.5, 0.5]))
    try:
        got = gmm.fit(df, ["a", "b"], prior=prior, start=start, iterations=None, sub_iterations=None)
    except np.linalg.LinAlgError:
        assert odd is not None
        return
    assert len(got.bound) <= 4 and (odd is not None or np.allclose(got.mu, prior.mu))
