"""Normal, gamma, Wishart and beta families as SQL text over columns.

Each function takes SQL texts of its arguments and returns SQL text, so the same formula serves
``F.expr`` and plain SQL. ``lg``/``psi`` may be replaced where an engine has its own functions.
"""

from __future__ import annotations

import math

import numpy as np

from . import special

LOG2PI = math.log(2 * math.pi)


# normal, one dimension --------------------------------------------------------------------------
def normal_logpdf(x, mu, var):
    return f"(-0.5e0 * ({LOG2PI!r} + ln({var}) + power(({x}) - ({mu}), 2) / ({var})))"


def normal_pdf(x, mu, var):
    return f"exp({normal_logpdf(x, mu, var)})"


def normal_kl(mu1, var1, mu0, var0):
    return f"(0.5e0 * (({var1}) / ({var0}) - ln(({var1}) / ({var0})) - 1e0 + power(({mu1}) - ({mu0}), 2) / ({var0})))"


def normal_kl_conjugate(mu1, n1, mu0, n0, prec):
    return f"(0.5e0 * (({n0}) / ({n1}) - ln(({n0}) / ({n1})) - 1e0 + ({n0}) * ({prec}) * power(({mu1}) - ({mu0}), 2)))"


def normal_logpdf_precision(x, mu, prec, n="1e0"):
    """Of a precision that n degrees scale."""
    return f"(0.5e0 * (ln(({n}) * ({prec})) - {LOG2PI!r} - ({n}) * ({prec}) * power(({x}) - ({mu}), 2)))"


def mv_normal_logpdf(x: list[str], mu, matrix, kind: str = "covariance", n: float = 1.0) -> str:
    """Of K columns; matrix is the covariance or ('precision') the precision, which n degrees scale."""
    a = np.asarray(matrix, float)
    a = np.linalg.inv(a) if kind == "covariance" else n * a
    d = [f"(({c}) - ({float(m)!r}))" for c, m in zip(x, mu)]
    quad = " + ".join(f"({float(a[i, j])!r}) * {d[i]} * {d[j]}" for i in range(len(x)) for j in range(len(x)))
    return f"(-0.5e0 * ({len(x) * LOG2PI - float(np.linalg.slogdet(a)[1])!r} + {quad}))"


def mv_normal_pdf(x, mu, matrix, kind: str = "covariance", n: float = 1.0) -> str:
    return f"exp({mv_normal_logpdf(x, mu, matrix, kind, n)})"


def mv_normal_kl(mu1, cov1, mu0, cov0) -> float:
    d, a0 = np.asarray(mu1, float) - np.asarray(mu0, float), np.linalg.inv(cov0)
    m = a0 @ np.asarray(cov1, float)
    return float(0.5 * (np.trace(m) - np.linalg.slogdet(m)[1] - len(d) + d @ a0 @ d))


def mv_normal_kl_conjugate(mu1, n1, mu0, n0, prec) -> float:
    """Of means whose precisions are n1 and n0 times one matrix."""
    d = np.asarray(mu1, float) - np.asarray(mu0, float)
    return float(0.5 * (len(d) * (n0 / n1 - math.log(n0 / n1) - 1) + n0 * d @ np.asarray(prec, float) @ d))


def normal_update(mu, n, mu0, n0):
    """(mean, degrees)"""
    return f"((({n0}) * ({mu0}) + ({n}) * ({mu})) / (({n0}) + ({n})))", f"(({n0}) + ({n}))"


# gamma ------------------------------------------------------------------------------------------
def gamma_params(a, b, kind="", k="1"):
    """(shape, rate). kind '': as given; 'normal': (rate mean, n) of K dimensions; 'gamma': (rate, n) with shape k."""
    if kind == "normal":
        return f"(0.5e0 * ({k}) * ({b}))", f"(0.5e0 * ({k}) * ({b}) / ({a}))"
    if kind == "gamma":
        return f"(({k}) * ({b}))", f"(({k}) * ({b}) / ({a}))"
    return a, b


def gamma_logpdf(x, a, b, lg=special.lgamma):
    return f"(({a}) * ln({b}) + (({a}) - 1e0) * ln({x}) - ({b}) * ({x}) - {lg(a)})"


def gamma_pdf(x, a, b, lg=special.lgamma):
    return f"exp({gamma_logpdf(x, a, b, lg)})"


def gamma_kl(a1, b1, a0, b0, lg=special.lgamma, psi=special.digamma):
    return f"((({a1}) - ({a0})) * {psi(a1)} - {lg(a1)} + {lg(a0)} - ({a0}) * ln(({b0}) / ({b1})) + ({a1}) * (({b0}) / ({b1}) - 1e0))"


def gamma_mean(a, b):
    return f"(({a}) / ({b}))"


def gamma_var(a, b):
    return f"(({a}) / power({b}, 2))"


def gamma_elog(a, b, psi=special.digamma):
    return f"({psi(a)} - ln({b}))"


def gamma_vlog(a):
    return special.trigamma(a)


def gamma_update(lam, n, lam0, n0):
    """(mean precision, degrees) of two averaged observations."""
    return f"((({n0}) + ({n})) / (({n0}) / ({lam0}) + ({n}) / ({lam})))", f"(({n0}) + ({n}))"


def gamma_update_suffstat(s0, s1, s2, mu, prec, lam0, n0, k="1e0"):
    lam = f"(({k}) * ({s0}) / (({s2}) * ({prec}) - 2e0 * ({mu}) * ({prec}) * ({s1}) + ({s0}) * ({mu}) * ({prec}) * ({mu})))"
    return gamma_update(lam, s0, lam0, n0)


# beta -------------------------------------------------------------------------------------------
def beta_params(kind, p, n, k="1"):
    """(a, b) of a conjugate prior: bernoulli, binomial (k trials), negative binomial (k failures), geometric."""
    return {
        "ber": (f"(({n}) * ({p}))", f"(({n}) * (1e0 - ({p})))"),
        "bin": (f"(({k}) * ({n}) * ({p}))", f"(({k}) * ({n}) * (1e0 - ({p})))"),
        "nbin": (f"(({p}) * ({k}) * ({n}) / (1e0 - ({p})))", f"(({k}) * ({n}))"),
        "geom": (f"(({n}) * 1e0)", f"(({n}) * (1e0 - ({p})) / ({p}))"),
    }[kind]


def beta_logpdf(x, a, b, bl=special.betaln):
    return f"((({a}) - 1e0) * ln({x}) + (({b}) - 1e0) * ln(1e0 - ({x})) - {bl(a, b)})"


def beta_pdf(x, a, b, bl=special.betaln):
    return f"exp({beta_logpdf(x, a, b, bl)})"


def beta_mean(a, b):
    return f"(({a}) / (({a}) + ({b})))"


def beta_var(a, b):
    return f"(({a}) * ({b}) / (power(({a}) + ({b}), 2) * (({a}) + ({b}) + 1e0)))"


def beta_elog(a, b, psi=special.digamma):
    return f"({psi(a)} - {psi(f'({a}) + ({b})')})"


def beta_vlog(a, b):
    return f"({special.trigamma(a)} - {special.trigamma(f'({a}) + ({b})')})"


def beta_kl(a1, b1, a0, b0, bl=special.betaln, psi=special.digamma):
    return (
        f"({bl(a0, b0)} - {bl(a1, b1)} + (({a1}) - ({a0})) * {psi(a1)} + (({b1}) - ({b0})) * {psi(b1)}"
        f" + (({a0}) - ({a1}) + ({b0}) - ({b1})) * {psi(f'({a1}) + ({b1})')})"
    )


def beta_rate(kind, s0, s1, k="1"):
    return {"ber": f"(({s1}) / ({s0}))", "bin": f"(({s1}) / (({k}) * ({s0})))", "nbin": f"(({s1}) / (({k}) * ({s0}) + ({s1})))", "geom": f"(({s0}) / ({s1}))", "fgeom": f"(({s0}) / (({s1}) + ({s0})))"}[kind]


def beta_update(p, n, p0, n0):
    return f"((({n0}) * ({p0}) + ({n}) * ({p})) / (({n0}) + ({n})))", f"(({n0}) + ({n}))"


# Wishart, from log-determinants and traces -------------------------------------------------------
def wishart_logpdf(logdet_x, trace, n, logdet_v, k):
    return f"(0.5e0 * (({n}) - {k} - 1e0) * ({logdet_x}) - 0.5e0 * ({trace}) - 0.5e0 * ({n}) * {k * math.log(2)!r} - 0.5e0 * ({n}) * ({logdet_v}) - {special.mv_lgamma(f'({n}) / 2e0', k)})"


def wishart_pdf(logdet_x, trace, n, logdet_v, k):
    return f"exp({wishart_logpdf(logdet_x, trace, n, logdet_v, k)})"


def wishart_mean(scale, n: float, kind: str = ""):
    """The expected matrix; 'normal': the scale is the expected matrix itself."""
    return np.asarray(scale, float) * (1.0 if kind == "normal" else n)


def wishart_update(mean, n: float, mean0, n0: float) -> tuple[np.ndarray, float]:
    """(expected matrix, degrees) after n observations of an expected matrix: its inverses average by their degrees."""
    total = n + n0
    return total * np.linalg.inv(n0 * np.linalg.inv(mean0) + n * np.linalg.inv(mean)), total


def wishart_kl(n1, logdet1, n0, logdet0, trace, k):
    """trace is that of inverse(V0) V1."""
    h1, h0 = f"({n1}) / 2e0", f"({n0}) / 2e0"
    return (
        f"(0.5e0 * ({n0}) * (({logdet0}) - ({logdet1})) + 0.5e0 * ({n1}) * (({trace}) - {k}) + 0.5e0 * (({n1}) - ({n0})) * {special.mv_polygamma(h1, k)}"
        f" + {special.mv_lgamma(h0, k)} - {special.mv_lgamma(h1, k)})"
    )


def wishart_elogdet(n, logdet, k):
    return f"({special.mv_polygamma(f'({n}) / 2e0', k)} + {k * math.log(2)!r} + ({logdet}))"


def wishart_vlogdet(n, k):
    return special.mv_polygamma(f"({n}) / 2e0", k, 1)


def wishart_logz(n, logdet, k):
    return f"CASE WHEN {k} >= ({n}) + 1e0 THEN 0e0 ELSE 0.5e0 * ({n}) * (({logdet}) + {k * math.log(2)!r}) + {special.mv_lgamma(f'({n}) / 2e0', k)} END"
