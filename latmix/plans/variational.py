"""Queries: variational rounds of a mixture, its parameters and its bound, with the rounds unrolled in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import gmm, views
from .common import r, rs, table
from .distributions import _psi
from .mixtures import EM_START, _X

ROUNDS = 3
#: of each cluster: mean, its degrees, scale, its degrees; and the proportions' count
MU0, B0, V0, N0, ALPHA0 = (1.2, 3.5), 0.5, 0.8, 3.0, 2.0


def _fit(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1e5).alias("x"))
    prior = gmm.make_prior(2, 1, mu=[[m] for m in MU0], b=B0, V=V0, n=N0, alpha=ALPHA0)
    return gmm.fit(x, ["x"], prior=prior, start=EM_START, iterations=ROUNDS, tolerance=-1.0)


def em_variational(spark, sf_dir):
    """Posterior of each cluster after three rounds: mean and its degrees, expected precision and its degrees, Dirichlet count."""
    m = _fit(spark, sf_dir)
    rows = [(k, *map(float, (m.mu[k, 0], m.b[k], m.A[k, 0, 0], m.n[k], m.alpha[k]))) for k in range(2)]
    out = spark.createDataFrame(rows, "k int, mu double, b double, precision double, n double, alpha double")
    return out.select("k", *(r(c, 5).alias(c) for c in out.columns[1:]))


def bound_variational(spark, sf_dir):
    """The bound of each pass, and the rows' terms and divergences that it is made of."""
    return views.bound_trace(spark, _fit(spark, sf_dir)).select("round", "part", r("value", 4).alias("value"))


def _rounds() -> str:
    """o: rows. m<t>: the model that pass t scores with; z<t>: its responsibilities. c is half the expected log-determinant less the mean's spread."""
    out = [f"o AS ({_X})", "m0 AS (SELECT 1e0 AS mu1, 4e0 AS mu2, 1e0 AS a1, 1e0 AS a2, 0e0 AS c1, 0e0 AS c2, ln(0.5) AS l1, ln(0.5) AS l2)"]
    log = lambda k: f"(c{k} - 0.5e0 * ln(2 * pi()) - 0.5 * a{k} * (x - mu{k}) ** 2)"
    for t in range(ROUNDS + 1):
        out.append(f"z{t} AS (SELECT x, {log(1)} AS f1, {log(2)} AS f2, l1, l2, 1 / (1 + exp(l2 + {log(2)} - l1 - {log(1)})) AS z1, 1 / (1 + exp(l1 + {log(1)} - l2 - {log(2)})) AS z2 FROM o CROSS JOIN m{t})")
        if t == ROUNDS:
            break
        sums = ", ".join(f"sum(z{k}) AS s{k}, sum(z{k} * x) AS t{k}, sum(z{k} * x * x) AS u{k}" for k in (1, 2))
        one = ", ".join(f"s{k} + {B0} AS b{k}, s{k} + {N0} AS n{k}, s{k} + {ALPHA0} AS g{k}, (t{k} + {B0 * MU0[k - 1]!r}) / (s{k} + {B0}) AS mu{k}, u{k}" for k in (1, 2))
        # the scatter about the new mean, the prior's mean among the rows
        two = ", ".join(f"*, 1 / (u{k} + {B0 * MU0[k - 1] ** 2!r} - b{k} * mu{k} ** 2 + {1 / V0!r}) AS v{k}".replace("*, ", "", k - 1) for k in (1, 2))
        three = ", ".join(f"n{k} * v{k} AS a{k}, 0.5 * ({_psi(f'n{k} / 2')} + ln(2) + ln(v{k})) - 0.5 / b{k} AS c{k}, {_psi(f'g{k}')} - {_psi('g1 + g2')} AS l{k}" for k in (1, 2))
        out.append(f"m{t + 1} AS (SELECT *, {three} FROM (SELECT {two} FROM (SELECT {one} FROM (SELECT {sums} FROM z{t}))))")
    return f"WITH {', '.join(out)}"


def _model_sql():
    row = lambda k: f"SELECT {k - 1}::INT AS k, " + ", ".join(f"{rs(f'{c}{k}', 5)} AS {n}" for c, n in (("mu", "mu"), ("b", "b"), ("a", "precision"), ("n", "n"), ("g", "alpha"))) + f" FROM m{ROUNDS}"
    return f"{_rounds()} {row(1)} UNION ALL {row(2)}"


def _bound_sql():
    means = " + ".join(f"0.5 * ({B0} / b{k} - 1 + ln(b{k} / {B0}) + {B0} * a{k} * (mu{k} - {MU0[k - 1]}) ** 2)" for k in (1, 2))
    # a Wishart of one dimension is a gamma of shape n / 2 and rate 1 / (2 V)
    precisions = " + ".join(f"((n{k} - {N0}) / 2 * {_psi(f'n{k} / 2')} - lgamma(n{k} / 2) + {math.lgamma(N0 / 2)!r} + {N0 / 2} * ln({V0} / v{k}) + n{k} / 2 * (v{k} / {V0} - 1))" for k in (1, 2))
    shares = f"lgamma(g1 + g2) - lgamma(g1) - lgamma(g2) - {math.lgamma(2 * ALPHA0) - 2 * math.lgamma(ALPHA0)!r} + (g1 - {ALPHA0}) * l1 + (g2 - {ALPHA0}) * l2"
    out = []
    for t in range(ROUNDS + 1):
        rows = f"(SELECT sum(z1 * f1 + z2 * f2) AS lx, sum(z1 * (l1 - ln(greatest(z1, 1e-300))) + z2 * (l2 - ln(greatest(z2, 1e-300)))) AS lz FROM z{t})"
        parts = {"observations": "lx", "responsibilities": "lz"} | ({"means": f"-({means})", "precisions": f"-({precisions})", "proportions": f"-({shares})"} if t else {})
        parts = {"bound": " + ".join(parts.values()), **parts}
        out += [f"SELECT {t}::INT AS round, '{part}' AS part, {rs(of, 4)} AS value FROM {rows} CROSS JOIN m{t}" for part, of in parts.items()]
    return f"{_rounds()} {' UNION ALL '.join(out)}"


QUERIES = {"gmm_em_variational": em_variational, "gmm_bound_variational": bound_variational}
ORACLE = {"gmm_em_variational": _model_sql(), "gmm_bound_variational": _bound_sql()}
