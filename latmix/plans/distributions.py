"""Queries: probability families over grouped statistics. The oracle uses DuckDB's own lgamma."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import dist, special
from .common import rs, table


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.avg("value").alias("m"), F.expr("avg(value * value) - avg(value) * avg(value)").alias("v"), F.count("value").cast("double").alias("n"), (F.sum("value") / 100).alias("s1"), (F.sum(F.col("value") * F.col("value")) / 100).alias("s2"))


_EVENTS = "(SELECT event_type, avg(value) AS m, avg(value * value) - avg(value) * avg(value) AS v, count(value)::DOUBLE AS n, sum(value) / 100 AS s1, sum(value * value) / 100 AS s2 FROM events GROUP BY event_type)"


def _family(parts: dict):
    """parts: name to (SQL for Spark, SQL for the oracle)."""

    def run(spark, sf_dir):
        return _events(spark, sf_dir).select("event_type", *(F.expr(f"floor(({a}) * 1e6 + 0.5e0) / 1e6").alias(k) for k, (a, _) in parts.items()))

    sql = f"SELECT event_type, {', '.join(f'{rs(b)} AS {k}' for k, (_, b) in parts.items())} FROM {_EVENTS}"
    return run, sql


def _psi(x):
    """Digamma for the oracle: twenty steps up, then four terms of the series."""
    z = f"(({x}) + 20)"
    return f"(ln({z}) - 0.5 / {z} - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - list_sum([1 / (({x}) + q) FOR q IN range(20)]))"


def _psi1(x):
    z = f"(({x}) + 20)"
    return f"(1 / {z} + 0.5 / {z} ** 2 + 1 / (6 * {z} ** 3) - 1 / (30 * {z} ** 5) + list_sum([1 / ((({x}) + q) * (({x}) + q)) FOR q IN range(20)]))"


_mu, _dn = dist.normal_update("m", "n", "1e0", "10e0")
NORMAL = {
    "logpdf": (dist.normal_logpdf("1.5e0", "m", "v"), "-0.5 * ln(2 * pi() * v) - (1.5 - m) * (1.5 - m) / (2 * v)"),
    "pdf": (dist.normal_pdf("m + 0.1e0", "m", "v"), "exp(-0.005 / v) / sqrt(2 * pi() * v)"),
    "kl": (dist.normal_kl("m", "v", "0e0", "v + 1e0"), "0.5 * (v / (v + 1) - ln(v / (v + 1)) - 1 + m * m / (v + 1))"),
    "kl_conjugate": (dist.normal_kl_conjugate("m / (1e0 + abs(m))", "n", "0e0", "5e0", "1e0 / v"), "0.5 * (5 / n - 1 - ln(5 / n) + 5 / v * (m / (1 + abs(m))) ** 2)"),
    "mu1": (_mu, "(10 * 1e0 + n * m) / (10 + n)"),
    "n1": (_dn, "n + 10"),
}
#: shape and rate from the moments' sizes, kept moderate
_a, _b = "(1e0 + abs(m) / (1e0 + abs(m)) * 5e0)", "(0.5e0 + v / (1e0 + v))"
_na, _nb = dist.gamma_params("v / (1e0 + v)", "4e0", "normal", "3e0")
_ga, _gb = dist.gamma_params("0.5e0", "3e0", "gamma", _a)
_lam, _ln = dist.gamma_update("1e0 + v / (1e0 + v)", "n / 100e0", "2e0", "5e0")
_slam, _sln = dist.gamma_update_suffstat("n / 100e0", "s1", "s2", "m", "1e0 / (1e0 + v)", "2e0", "5e0")
GAMMA = {
    "logpdf": (dist.gamma_logpdf("2e0", _a, _b), f"{_a} * ln(2 * {_b}) - ln(2) - 2 * {_b} - lgamma({_a})"),
    "pdf": (dist.gamma_pdf("0.7e0", _a, _b), f"(0.7 * {_b}) ** {_a} * exp(-0.7 * {_b}) / (0.7 * gamma({_a}))"),
    # shape 6, rate 6 over the mean; shape 3 _a, rate 6 _a
    "pdf_normal": (dist.gamma_pdf("0.7e0", _na, _nb), "(4.2 * (1 + v) / v) ** 6 * exp(-4.2 * (1 + v) / v) / (0.7 * 120)"),
    "pdf_gamma": (dist.gamma_pdf("0.7e0", _ga, _gb), f"(4.2 * {_a}) ** (3 * {_a}) * exp(-4.2 * {_a}) / (0.7 * gamma(3 * {_a}))"),
    "kl": (dist.gamma_kl(_a, _b, "2e0", "1e0"), f"({_a} - 2) * {_psi(_a)} - lgamma({_a}) + 2 * ln({_b}) + {_a} / {_b} - {_a}"),
    "e": (dist.gamma_mean(_a, _b), f"{_a} / {_b}"),
    "var": (dist.gamma_var(_a, _b), f"{_a} / ({_b} * {_b})"),
    "elog": (dist.gamma_elog(_a, _b), f"{_psi(_a)} - ln({_b})"),
    "vlog": (dist.gamma_vlog(_a), _psi1(_a)),
    "up": (_lam, "(5 + n / 100) / (2.5 + n / 100 / (1 + v / (1 + v)))"),
    "up_n": (_ln, "5 + n / 100"),
    "up_suffstat": (_slam, "(5 + n / 100) / (2.5 + (s2 - 2 * m * s1 + n / 100 * m * m) / (1 + v))"),
}
_p = "(0.1e0 + 0.8e0 * abs(m) / (1e0 + abs(m)))"
#: both shapes for 4 observations of 3 trials or failures each; the mean is the share itself
_SHAPES = {
    "ber": (f"(4 * {_p})", f"(4 * (1 - {_p}))"),
    "bin": (f"(12 * {_p})", f"(12 * (1 - {_p}))"),
    "nbin": (f"(12 * {_p} / (1 - {_p}))", "(12::DOUBLE)"),
    "geom": ("(4::DOUBLE)", f"(4 * (1 - {_p}) / {_p})"),
}
BETA = {}
for _kind, (_sx, _sy) in _SHAPES.items():
    _x, _y = dist.beta_params(_kind, _p, "4e0", "3e0")
    _sum = f"({_sx} + {_sy})"
    _norm = f"(lgamma({_sum}) - lgamma({_sx}) - lgamma({_sy}))"
    BETA |= {
        f"logpdf_{_kind}": (dist.beta_logpdf("0.3e0", _x, _y), f"{_norm} + ({_sx} - 1) * ln(0.3) + ({_sy} - 1) * ln(0.7)"),
        f"mean_{_kind}": (dist.beta_mean(_x, _y), _p),
        f"var_{_kind}": (dist.beta_var(_x, _y), f"{_p} * (1 - {_p}) / ({_sum} + 1)"),
        f"elog_{_kind}": (dist.beta_elog(_x, _y), f"{_psi(_sx)} - {_psi(_sum)}"),
        f"vlog_{_kind}": (dist.beta_vlog(_x, _y), f"{_psi1(_sx)} - {_psi1(_sum)}"),
        # against shapes 2 and 3, of which the beta function is 1 / 12
        f"kl_{_kind}": (dist.beta_kl(_x, _y, "2e0", "3e0"), f"{_norm} - ln(12) + ({_sx} - 2) * {_psi(_sx)} + ({_sy} - 3) * {_psi(_sy)} + (5 - {_sum}) * {_psi(_sum)}"),
    }
#: the rates of a quarter as many successes as trials, of 2 trials or failures each
for _kind, _share in (("ber", "0.25"), ("bin", "0.125"), ("nbin", "1 / 9"), ("geom", "4"), ("fgeom", "0.8")):
    _rate = dist.beta_rate(_kind, "n", "n / 4e0", "2e0")
    BETA[f"up_{_kind}"] = (dist.beta_update(_rate, "n", "0.5e0", "10e0")[0], f"(5 + n * ({_share})) / (10 + n)")
_q = "(2 + n / (1 + n))"
BETA["pdf"] = (dist.beta_pdf("0.3e0", "2e0 + n / (1e0 + n)", "3e0"), f"0.3 ** ({_q} - 1) * 0.49 * {_q} * ({_q} + 1) * ({_q} + 2) / 2")

#: two-dimensional: V = [[1 + v', 0.2], [0.2, 1]] with v' bounded
_v = "(1e0 + v / (1e0 + v))"
_ldv = f"ln({_v} - 0.04e0)"


def _mvlg2(x):
    return f"({0.5 * math.log(math.pi)!r} + lgamma({x}) + lgamma(({x}) - 0.5e0))"


WISHART = {
    "elogdet": (dist.wishart_elogdet("5e0", _ldv, 2), f"{_psi('2.5')} + {_psi('2.0')} + 2 * ln(2) + {_ldv}"),
    "vlogdet": (dist.wishart_vlogdet(f"3e0 + {_v}", 2), f"{_psi1(f'(3 + {_v}) / 2')} + {_psi1(f'(2 + {_v}) / 2')}"),
    "logz": (dist.wishart_logz("5e0", _ldv, 2), f"0.5 * 5 * ({_ldv} + 2 * ln(2e0)) + {_mvlg2('2.5e0')}"),
    # of X = identity: trace of the inverse of V is (1 + v11) / det
    "logpdf": (dist.wishart_logpdf("0e0", f"(1e0 + {_v}) / ({_v} - 0.04e0)", "5e0", _ldv, 2), f"-0.5 * (1 + {_v}) / ({_v} - 0.04) - 5 * ln(2e0) - 2.5 * {_ldv} - {_mvlg2('2.5e0')}"),
    "pdf": (dist.wishart_pdf("0e0", f"(1e0 + {_v}) / ({_v} - 0.04e0)", "5e0", _ldv, 2), f"exp(-0.5 * (1 + {_v}) / ({_v} - 0.04)) / (32 * ({_v} - 0.04) ** 2.5 * exp({_mvlg2('2.5e0')}))"),
    # against the identity with 4 degrees: the trace is v11 + 1
    "kl": (dist.wishart_kl("5e0", _ldv, "4e0", "0e0", f"({_v} + 1e0)", 2), f"0.5 * 4 * (0 - {_ldv}) + 2.5 * ({_v} + 1 - 2) + 0.5 * ({_psi('2.5')} + {_psi('2.0')}) + {_mvlg2('2e0')} - {_mvlg2('2.5e0')}"),
    "mv_lgamma": (special.mv_lgamma("2e0 + n / (1e0 + n)", 3), "1.5 * ln(pi()) + lgamma(2 + n / (1 + n)) + lgamma(1.5 + n / (1 + n)) + lgamma(1 + n / (1 + n))"),
    "mv_digamma": (special.mv_polygamma("2e0 + n / (1e0 + n)", 3), f"{_psi('2 + n / (1 + n)')} + {_psi('1.5 + n / (1 + n)')} + {_psi('1 + n / (1 + n)')}"),
}

QUERIES, ORACLE = {}, {}
for _name, _parts in (("normal_family", NORMAL), ("gamma_family", GAMMA), ("beta_family", BETA), ("wishart_family", WISHART)):
    QUERIES[_name], ORACLE[_name] = _family(_parts)
