"""Queries: Gaussian mixtures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import gmm, histogram, observations
from .common import GAPS, gaps, r, rs, table

COLS = ["x1", "x2", "x3"]
MODEL = gmm.Mixture(
    np.array([[1.5, 1.5, 1.0], [3.5, 3.5, 3.0]]),
    np.array([[[1.0, 0.2, 0.1], [0.2, 0.8, 0.0], [0.1, 0.0, 1.2]], [[0.7, -0.1, 0.2], [-0.1, 0.9, 0.1], [0.2, 0.1, 1.0]]]),
    np.log(np.array([0.4, 0.6])),
)
DIRICHLET = np.array([3.0, 5.0])


def _logp_sql(model, code, k):
    """The log-density of a pattern from the covariance of the observed channels, which is a block of the whole covariance."""
    o = [i for i in range(len(COLS)) if code >> i & 1]
    if not o:
        return "0e0"
    cov = np.linalg.inv(model.A[k])[np.ix_(o, o)]
    prec, norm = np.linalg.inv(cov), -0.5 * math.log((2 * math.pi) ** len(o) * np.linalg.det(cov))
    quad = " + ".join(f"({float(prec[i, j])!r}) * ({COLS[a]} - {float(model.mu[k, a])!r}) * ({COLS[b]} - {float(model.mu[k, b])!r})" for i, a in enumerate(o) for j, b in enumerate(o))
    return f"({norm!r} - 0.5 * ({quad}))"


def _scored_sql(model, logpi=(math.log(0.4), math.log(0.6))):
    code = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, c in enumerate(COLS))
    case = lambda k: "CASE code " + " ".join(f"WHEN {c} THEN {_logp_sql(model, c, k)}" for c in range(8)) + f" END + {logpi[k]!r}"
    return f"SELECT *, exp(p0) / (exp(p0) + exp(p1)) AS z0, exp(p1) / (exp(p0) + exp(p1)) AS z1, ln(exp(p0) + exp(p1)) AS ev FROM (SELECT *, {case(0)} AS p0, {case(1)} AS p1 FROM (SELECT *, {code} AS code FROM {GAPS}))"


def _flag(scored):
    return scored.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.sum(F.get("z", F.lit(0))) / 1000).alias("mass_1"), r(F.sum(F.get("z", F.lit(1))) / 1000).alias("mass_2"))


_FLAG_SQL = f"SELECT l_returnflag, count(*) AS n, {rs('sum(z0) / 1000')} AS mass_1, {rs('sum(z1) / 1000')} AS mass_2 FROM ({{}}) GROUP BY l_returnflag"


def gmm_apply_flag_mass(spark, sf_dir):
    rows = gaps(spark, sf_dir).na.drop("any", subset=COLS)
    return _flag(gmm.score(rows, COLS, MODEL))


def gmm_apply_missing(spark, sf_dir):
    return _flag(gmm.score(gaps(spark, sf_dir), COLS, MODEL))


#: Expected logarithms under (3, 5): digamma(3) - digamma(8) and digamma(5) - digamma(8) are sums of reciprocals.
_DIRICHLET_LOGS = (-sum(1 / j for j in range(3, 8)), -sum(1 / j for j in range(5, 8)))


def _with_dirichlet():
    logpi, alpha = gmm.proportions(DIRICHLET)
    return gmm.Mixture(MODEL.mu, MODEL.A, logpi, alpha=alpha)


def gmm_apply_dirichlet(spark, sf_dir):
    return _flag(gmm.score(gaps(spark, sf_dir), COLS, _with_dirichlet()))


def gmm_infer_missing(spark, sf_dir):
    out = gmm.infer_missing(gmm.score(gaps(spark, sf_dir), COLS, MODEL), COLS, MODEL)
    return out.groupBy("l_linenumber").agg(*(r(F.sum(c) / 1000).alias(c) for c in COLS))


def _infer_sql():
    def expr(ci):
        parts = []
        for code in range(7):
            o, m = gmm.split(code, 3)
            if ci not in m:
                continue
            total = []
            for k in range(2):
                A = MODEL.A[k]
                s = np.linalg.solve(A[np.ix_(m, m)], A[np.ix_(m, o)])[m.index(ci)] if o else []
                total.append(f"z{k} * ({float(MODEL.mu[k, ci])!r}" + "".join(f" + ({float(v)!r}) * ({float(MODEL.mu[k, j])!r} - {COLS[j]})" for v, j in zip(s, o)) + ")")
            parts.append(f"WHEN {code} THEN {' + '.join(total)}")
        return f"coalesce({COLS[ci]}, CASE code {' '.join(parts)} END)"

    cols = ", ".join(f"{rs(f'sum({expr(i)}) / 1000')} AS {c}" for i, c in enumerate(COLS))
    return f"SELECT l_linenumber, {cols} FROM ({_scored_sql(MODEL)}) GROUP BY l_linenumber"


SEED, KEY = 7, ("l_orderkey", "l_linenumber")


def gmm_sample_missing(spark, sf_dir):
    """Missing channels drawn from their conditional distributions."""
    out = gmm.infer_missing(gmm.score(gaps(spark, sf_dir), COLS, MODEL), COLS, MODEL, sample=SEED, key=KEY)
    return out.groupBy("l_linenumber").agg(*(r(F.sum(c) / 1000).alias(c) for c in COLS), *(r(F.sum(F.col(c) * F.col(c)) / 1000).alias(f"{c}_2") for c in COLS))


def _sample_sql():
    """Of one missing channel the deviation is 1 / sqrt(A_pp); of two the root of the inverse of their 2 x 2 block is written out."""

    def draw(k, j):
        h = f"md5('{SEED}:' || {KEY[0]} || ':' || {KEY[1]} || ':{k}:{j}')"
        u = [f"((('0x' || substr({h}, {at}, 12))::BIGINT + 0.5e0) / {2.0**48!r})" for at in (1, 13)]
        return f"(sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]}))"

    def expr(ci):
        parts = []
        for code in range(1, 7):
            o, m = gmm.split(code, 3)
            if ci not in m:
                continue
            total = []
            for k in range(2):
                A, mu = MODEL.A[k], MODEL.mu[k]
                if len(m) == 1:
                    a = float(A[ci, ci])
                    slope, noise = {j: float(A[ci, j]) / a for j in o}, [(1 / math.sqrt(a), ci)]
                else:
                    (p, q), j = m, o[0]
                    det = float(A[p, p] * A[q, q] - A[p, q] ** 2)
                    other = q if ci == p else p
                    slope = {j: float(A[other, other] * A[ci, j] - A[ci, other] * A[other, j]) / det}
                    # upper root R of the block: R_pp = sqrt(A_pp), R_pq = A_pq / R_pp, R_qq = sqrt(A_qq - R_pq^2)
                    rpp = math.sqrt(A[p, p])
                    rpq = A[p, q] / rpp
                    rqq = math.sqrt(A[q, q] - rpq**2)
                    noise = [(1 / rpp, p), (-rpq / (rpp * rqq), q)] if ci == p else [(1 / rqq, q)]
                mean = f"{float(mu[ci])!r}" + "".join(f" + ({v!r}) * ({float(mu[j])!r} - {COLS[j]})" for j, v in slope.items())
                total.append(f"z{k} * ({mean}" + "".join(f" + ({float(f)!r}) * {draw(k, j)}" for f, j in noise) + ")")
            parts.append(f"WHEN {code} THEN {' + '.join(total)}")
        return f"coalesce({COLS[ci]}, CASE code {' '.join(parts)} END)"

    filled = ", ".join(f"{expr(i)} AS y{i}" for i in range(3))
    cols = ", ".join([f"{rs(f'sum(y{i}) / 1000')} AS {c}" for i, c in enumerate(COLS)] + [f"{rs(f'sum(y{i} * y{i}) / 1000')} AS {c}_2" for i, c in enumerate(COLS)])
    return f"SELECT l_linenumber, {cols} FROM (SELECT l_linenumber, {filled} FROM ({_scored_sql(MODEL)})) GROUP BY l_linenumber"


# priors shared by fits -----------------------------------------------------------------------------------
def _posteriors(spark, sf_dir):
    """A posterior for each return flag, of three clusters known by the line's number and of unlike spreads, in two channels."""
    k = F.col("l_linenumber") % 3
    rows = gaps(spark, sf_dir).select("l_returnflag", k.alias("k"), (F.col("x1") * (1 + 2 * k)).alias("x1"), (F.coalesce("x2", F.lit(2.0)) * (1 + k)).alias("x2"))
    sums = rows.groupBy("l_returnflag", "k").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("x1", "x2")), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in (("x1", "x1"), ("x1", "x2"), ("x2", "x2"))))
    flags: dict[str, dict] = {}
    for s in sums.orderBy("l_returnflag", "k").collect():  # a row a flag and cluster
        flags.setdefault(s["l_returnflag"], {})[s["k"]] = s
    prior = gmm.make_prior(3, 2, mu=[2.5, 2.0], b=2.0, V=0.5 * np.eye(2), n=4.0)
    out = []
    for f in flags.values():
        s0, s1 = np.array([f[k]["n"] for k in range(3)], float), np.array([[f[k]["x1"], f[k]["x2"]] for k in range(3)])
        s2 = np.array([[[f[k]["x1x1"], f[k]["x1x2"]], [f[k]["x1x2"], f[k]["x2x2"]]] for k in range(3)])
        # a few rows' worth of each group, so that fits differ
        mu, A, b, V, n = gmm.update_clusters(s0 / s0 * 40, s1 / s0[:, None] * 40, s2 / s0[:, None, None] * 40, prior)
        out.append(gmm.Mixture(mu, A, np.full(3, -math.log(3)), b, V, n))
    return out


def gmm_shared_prior(spark, sf_dir):
    """The prior of the flags' fits: means and strengths, and what is left of the equations that the rest must satisfy."""
    from ..functions.special import np_mv_digamma

    fits = _posteriors(spark, sf_dir)
    h = gmm.shared_hyper(fits, 1000, 1e-14)
    s, rows = len(fits), []
    elog = lambda V, p: np_mv_digamma(p / 2, 2) + 2 * math.log(2) + np.linalg.slogdet(V)[1]
    top = elog(h.V0, h.p0) - np.mean([elog(h.V[k], h.p[k]) for k in range(3)])
    for k in range(3):
        total = sum(m.n[k] * m.V[k] for m in fits)
        seen = np.mean([np.linalg.slogdet(m.V[k])[1] + np_mv_digamma(m.n[k] / 2, 2) for m in fits])
        left = [np.abs(np.linalg.inv(h.V[k]) - np.linalg.inv(h.V0) - total).max() / np.abs(total).max(), h.p[k] - h.p0 - s * h.prior.n[k], np_mv_digamma(h.prior.n[k] / 2, 2) - elog(h.V[k], h.p[k]) - seen, np.abs(h.prior.V[k] @ (h.p[k] * h.V[k]) - np.eye(2)).max(), top, np.abs(h.p0 * h.V0 - sum(h.p[c] * h.V[c] for c in range(3)) / 3).max() / np.abs(h.V0).max()]
        rows.append((k, *map(float, h.prior.mu[k]), float(h.prior.b[k]), bool(max(map(abs, left)) < 1e-5)))
    return spark.createDataFrame(rows, "k int, mu1 double, mu2 double, b double, stationary boolean").select("k", *(r(c).alias(c) for c in ("mu1", "mu2", "b")), "stationary")


def _shared_sql():
    """Posteriors and the closed forms of the prior's mean and strength; 2 x 2 inverses written out."""
    return f"""WITH s AS (SELECT l_returnflag, l_linenumber % 3 AS k, avg(x1) * 40 AS a1, avg(y) * 40 AS a2, avg(x1 * x1) * 40 AS q11, avg(x1 * y) * 40 AS q12, avg(y * y) * 40 AS q22
      FROM (SELECT * REPLACE (x1 * (1 + 2 * (l_linenumber % 3)) AS x1), coalesce(x2, 2e0) * (1 + l_linenumber % 3) AS y FROM {GAPS}) GROUP BY 1, 2),
    m AS (SELECT *, (a1 + 5) / 42 AS m1, (a2 + 4) / 42 AS m2 FROM s),
    c AS (SELECT *, q11 + 2 * 6.25 - 42 * m1 * m1 + 2 AS c11, q12 + 2 * 5 - 42 * m1 * m2 AS c12, q22 + 2 * 4 - 42 * m2 * m2 + 2 AS c22 FROM m),
    p AS (SELECT *, 44 * c22 / (c11 * c22 - c12 * c12) AS p11, -44 * c12 / (c11 * c22 - c12 * c12) AS p12, 44 * c11 / (c11 * c22 - c12 * c12) AS p22 FROM c),
    t AS (SELECT k, sum(p11) AS t11, sum(p12) AS t12, sum(p22) AS t22, sum(p11 * m1 + p12 * m2) AS u1, sum(p12 * m1 + p22 * m2) AS u2 FROM p GROUP BY k),
    g AS (SELECT k, (t22 * u1 - t12 * u2) / (t11 * t22 - t12 * t12) AS g1, (t11 * u2 - t12 * u1) / (t11 * t22 - t12 * t12) AS g2 FROM t)
    SELECT k::INT AS k, {rs('any_value(g1)')} AS mu1, {rs('any_value(g2)')} AS mu2, {rs('2 * count(*) / sum(p11 * (m1 - g1) * (m1 - g1) + 2 * p12 * (m1 - g1) * (m2 - g2) + p22 * (m2 - g2) * (m2 - g2) + 2 / 42e0)')} AS b, true AS stationary
    FROM p JOIN g USING (k) GROUP BY k"""


def _stats(weighted, variance=None):
    def run(spark, sf_dir):
        z = gmm.score(gaps(spark, sf_dir), COLS, MODEL)
        w = F.col("l_quantity") if weighted else None
        s = gmm.suffstats(z, COLS, [F.get("z", F.lit(0)), F.get("z", F.lit(1))], w)
        add = lambda c: F.col(c) + (F.col(f"s0_{c[3]}") * variance if variance and c.startswith("s2") and c[5] == c[7] else F.lit(0.0))
        return s.select("code", *(r(add(c) / 1e4).alias(c) for c in s.columns if c != "code"))

    return run


def _stats_sql(weighted, variance=None):
    w = "l_quantity" if weighted else "1e0"
    cols = []
    for k in range(2):
        cols.append(f"{rs(f'sum({w} * z{k}) / 1e4')} AS s0_{k}")
        for i, a in enumerate(COLS):
            cols.append(f"{rs(f'sum({w} * z{k} * {a}) / 1e4')} AS s1_{k}_{i}")
            for j, b in enumerate(COLS):
                if j >= i:
                    more = f" + sum({w} * z{k}) * {variance!r}" if variance and i == j else ""
                    cols.append(f"{rs(f'(sum({w} * z{k} * {a} * {b}){more}) / 1e4')} AS s2_{k}_{i}_{j}")
    return f"SELECT code::BIGINT AS code, {', '.join(cols)} FROM ({_scored_sql(MODEL)}) GROUP BY code"


def gmm_bound_terms(spark, sf_dir):
    """Log-evidence of the rows, and entropy of the responsibilities, by pattern."""
    z = gmm.score(gaps(spark, sf_dir), COLS, MODEL).withColumn("code", observations.pattern_code(COLS))
    h = F.aggregate("z", F.lit(0.0), lambda a, v: a - v * F.log(F.greatest(v, F.lit(1e-300))))
    return z.groupBy("code").agg(r(F.sum("log_evidence") / 1e4).alias("evidence"), r(F.sum(h) / 1e4).alias("entropy"))


_BOUND_SQL = f"SELECT code::BIGINT AS code, {rs('sum(ev) / 1e4')} AS evidence, {rs('sum(-z0 * ln(greatest(z0, 1e-300)) - z1 * ln(greatest(z1, 1e-300))) / 1e4')} AS entropy FROM ({_scored_sql(MODEL)}) GROUP BY code"


# EM on two channels without gaps, unrolled in SQL ----------------------------------------------------
EM_START = gmm.Mixture(np.array([[1.0], [4.0]]), np.array([[[1.0]], [[1.0]]]), np.log(np.array([0.5, 0.5])))
EM_ROUNDS = 3


def _em_rows(model):
    return [(k + 1, float(model.mu[k, 0]), float(1 / model.A[k, 0, 0]), float(model.pi[k])) for k in range(len(model.mu))]


def _em_frame(spark, model):
    return spark.createDataFrame(_em_rows(model), "k int, mu double, var double, pi double").select("k", *(r(c, 5).alias(c) for c in ("mu", "var", "pi")))


def gmm_em_ml(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1e5).alias("x"))
    return _em_frame(spark, gmm.fit(x, ["x"], start=EM_START, iterations=EM_ROUNDS, tolerance=-1.0))


def gmm_hist_mode(spark, sf_dir):
    """The same fit on a weighted histogram, with the bins' variance."""
    x = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1e5).alias("x"))
    bounds = observations.ranges(x, ["x"])["x"]
    h = histogram.histogram(x, ["x"], 64, keep_zero=False).select(F.col("v_x").alias("x"), "w")
    return _em_frame(spark, gmm.fit(h, ["x"], weight="w", start=EM_START, iterations=EM_ROUNDS, tolerance=-1.0, bin_width=(bounds[1] - bounds[0]) / 64))


def gmm_multi_gauss(spark, sf_dir):
    """Two Gaussians of one class: their weights within it after a pass."""
    z = gmm.score(gaps(spark, sf_dir), COLS, MODEL)
    s = z.agg(F.sum(F.get("z", F.lit(0))), F.sum(F.get("z", F.lit(1)))).head()
    w = gmm.class_weights(np.array([s[0], s[1]]), [0, 0])
    return spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(w)], "k int, mg double").select("k", r("mg").alias("mg"))


def gmm_labels(spark, sf_dir):
    """Log-potentials by row: returned lines lean to the first cluster."""
    rows = gaps(spark, sf_dir).withColumns({"g1": F.when(F.col("l_returnflag") == "R", math.log(0.9)).otherwise(math.log(0.5)), "g2": F.when(F.col("l_returnflag") == "R", math.log(0.1)).otherwise(math.log(0.5))})
    return _flag(gmm.score(rows, COLS, MODEL, label_logs=["g1", "g2"]))


def _labels_sql():
    inner = _scored_sql(MODEL).replace("exp(p0)", "g1 * exp(p0)").replace("exp(p1)", "g2 * exp(p1)")
    g = "CASE WHEN l_returnflag = 'R' THEN 0.9e0 ELSE 0.5e0 END AS g1, CASE WHEN l_returnflag = 'R' THEN 0.1e0 ELSE 0.5e0 END AS g2"
    return _FLAG_SQL.format(inner.replace("(SELECT *, CASE code", f"(SELECT *, {g}, CASE code", 1))


def gmm_prune(spark, sf_dir):
    """Of small, middle and large quantities those kinds with a tenth of the rows or more."""
    q = F.col("l_quantity").cast("double")
    rows = table(spark, sf_dir, "lineitem").select(q.alias("q"), F.when(q < 5, 0).when(q < 20, 1).otherwise(2).alias("kind"))
    start = gmm.label_start(rows, ["q"], "kind")
    kept, again = gmm.prune(start, 0.1), gmm.prune(start, 0.1, True)
    return spark.createDataFrame([(float(m[0]), float(p), float(q)) for m, p, q in zip(kept.mu, np.exp(kept.logpi), np.exp(again.logpi))], "mu double, pi double, share double").select(*(r(c).alias(c) for c in ("mu", "pi", "share")))


def gmm_start_linspace(spark, sf_dir):
    c = gmm.start_linspace(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 3)
    return spark.createDataFrame([(i + 1, *map(float, x)) for i, x in enumerate(c)], "k int, q double, p double").select("k", r("q").alias("q"), r(F.col("p")).alias("p"))


def gmm_fit_variational(spark, sf_dir):
    """Variational fit with missing channels; as many rounds as it takes, with no limit, so no SQL."""
    prior = gmm.make_prior(2, 3, mu=[2.5, 2.5, 2.0], b=1e-2, V=0.5 * np.eye(3), n=4.0, alpha=1.0)
    m = gmm.fit(gaps(spark, sf_dir), COLS, 2, prior=prior, start=MODEL, iterations=None, sub_iterations=None)
    return spark.createDataFrame([(k + 1, *map(float, m.mu[k]), float(m.pi[k])) for k in range(2)], "k int, x1 double, x2 double, x3 double, pi double")


def gmm_colours(spark, sf_dir):
    z = gmm.score(gaps(spark, sf_dir), COLS, MODEL).withColumn("rgb", gmm.palette_mix("z", [(1, 0, 0), (0, 0.5, 1)]))
    return z.groupBy("l_linestatus").agg(*(r(F.avg(F.get("rgb", F.lit(i)))).alias(c) for i, c in enumerate(("red", "green", "blue"))))


def _em_sql(source, w="1e0", extra="0e0"):
    out = [f"o AS ({source})", "m0 AS (SELECT 1e0 AS mu1, 4e0 AS mu2, 1e0 AS v1, 1e0 AS v2, 0.5e0 AS q1, 0.5e0 AS q2)"]
    n = lambda k: f"(q{k} * exp(-0.5e0 * (power(x - mu{k}, 2) + {extra}) / v{k}) / sqrt(v{k}))"
    for t in range(EM_ROUNDS):
        out.append(f"z{t} AS (SELECT x, w, {n(1)} / ({n(1)} + {n(2)}) AS z1, {n(2)} / ({n(1)} + {n(2)}) AS z2 FROM o, m{t})")
        f = lambda k: f"sum(w * z{k} * x) / sum(w * z{k}) AS mu{k}, (sum(w * z{k} * x * x) + sum(w * z{k}) * {extra}) / sum(w * z{k}) - power(sum(w * z{k} * x) / sum(w * z{k}), 2) AS v{k}, sum(w * z{k}) / sum(w) AS q{k}"
        out.append(f"m{t + 1} AS (SELECT {f(1)}, {f(2)} FROM z{t})")
    row = lambda k: f"SELECT {k}::INT AS k, {rs(f'mu{k}', 5)} AS mu, {rs(f'v{k}', 5)} AS var, {rs(f'q{k}', 5)} AS pi FROM m{EM_ROUNDS}"
    return f"WITH {', '.join(out)} {row(1)} UNION ALL {row(2)}"


_X = "SELECT o_totalprice / 1e5 AS x FROM orders"
_HIST = f"SELECT lo + (b + 0.5e0) * bw AS x, count(*)::DOUBLE AS w FROM (SELECT lo, bw, least(floor((x - lo) / bw), 63) AS b FROM ({_X}), (SELECT min(x) AS lo, (max(x) - min(x)) / 64 AS bw FROM ({_X}))) GROUP BY lo, bw, b"
_RGB = "SELECT l_linestatus, " + ", ".join(f"{rs(f'avg({e})')} AS {c}" for c, e in (("red", "z0"), ("green", "0.5e0 * z1"), ("blue", "z1"))) + f" FROM ({_scored_sql(MODEL)}) GROUP BY l_linestatus"

QUERIES = {
    "gmm_apply_flag_mass": gmm_apply_flag_mass,
    "gmm_apply_missing": gmm_apply_missing,
    "gmm_apply_dirichlet_props": gmm_apply_dirichlet,
    "gmm_infer_missing": gmm_infer_missing,
    "gmm_suffstat_by_code": _stats(False),
    "gmm_suffstat_weighted": _stats(True),
    "gmm_suffstat_uncertainty": _stats(False, 0.25),
    "gmm_lower_bound_terms": gmm_bound_terms,
    "gmm_em_ml": gmm_em_ml,
    "gmm_hist_mode": gmm_hist_mode,
    "gmm_multi_gauss": gmm_multi_gauss,
    "gmm_labels": gmm_labels,
    "gmm_prune": gmm_prune,
    "gmm_linspace_start": gmm_start_linspace,
    "gmm_fit_variational": gmm_fit_variational,
    "gmm_cat2rgb": gmm_colours,
    "gmm_sample_missing": gmm_sample_missing,
    "gmm_shared_prior": gmm_shared_prior,
}
ORACLE = {
    "gmm_apply_flag_mass": _FLAG_SQL.format(f"SELECT * FROM ({_scored_sql(MODEL)}) WHERE code = 7"),
    "gmm_apply_missing": _FLAG_SQL.format(_scored_sql(MODEL)),
    "gmm_apply_dirichlet_props": _FLAG_SQL.format(_scored_sql(MODEL, _DIRICHLET_LOGS)),
    "gmm_infer_missing": _infer_sql(),
    "gmm_sample_missing": _sample_sql(),
    "gmm_shared_prior": _shared_sql(),
    "gmm_suffstat_by_code": _stats_sql(False),
    "gmm_suffstat_weighted": _stats_sql(True),
    "gmm_suffstat_uncertainty": _stats_sql(False, 0.25),
    "gmm_lower_bound_terms": _BOUND_SQL,
    "gmm_em_ml": _em_sql(_X.replace("AS x", "AS x, 1e0 AS w")),
    "gmm_hist_mode": _em_sql(_HIST, extra="(SELECT power((max(x) - min(x)) / 64, 2) / 12 FROM (" + _X + "))"),
    "gmm_multi_gauss": f"WITH s AS (SELECT sum(z0) AS a, sum(z1) AS b FROM ({_scored_sql(MODEL)})) SELECT 1::INT AS k, {rs('a / (a + b)')} AS mg FROM s UNION ALL SELECT 2, {rs('b / (a + b)')} FROM s",
    "gmm_labels": _labels_sql(),
    "gmm_prune": f"WITH g AS (SELECT avg(l_quantity::DOUBLE) AS mu, count(*) / (SELECT count(*) FROM lineitem) AS pi FROM lineitem GROUP BY CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 20 THEN 1 ELSE 2 END), k AS (SELECT * FROM g WHERE pi >= 0.1) SELECT {rs('mu')} AS mu, {rs('pi')} AS pi, {rs('pi / (SELECT sum(pi) FROM k)')} AS share FROM k",
    "gmm_linspace_start": f"SELECT k::INT AS k, {rs('q0 + (q1 - q0) * k / 4')} AS q, {rs('p0 + (p1 - p0) * k / 4')} AS p FROM (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS p0, max(l_extendedprice) AS p1 FROM lineitem), (SELECT unnest([1, 2, 3]) AS k)",
    "gmm_cat2rgb": _RGB,
}
