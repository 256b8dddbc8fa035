"""Queries: what figures show, as rows, of lineitem's groups, the orders' fit and the volume of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bias, gmm, views
from .common import GAPS, OFF, gaps, r, rs, table
from .lattices import _BIAS, _FULL, COEFF, DIM, volume
from .mixtures import COLS, EM_ROUNDS, EM_START, _X, _em_sql

PAIR = ["x1", "x2"]


def density(spark, sf_dir):
    """64 bins of each channel with gaps."""
    return views.channel_density(gaps(spark, sf_dir), COLS).select("channel", "bin", r("centre").alias("centre"), r("density").alias("density"))


def _density_sql():
    each = " UNION ALL ".join(f"SELECT {i} AS channel, {c} AS x FROM {GAPS} WHERE {c} IS NOT NULL" for i, c in enumerate(COLS))
    return f"""WITH o AS ({each}), s AS (SELECT channel, min(x) AS lo, (max(x) - min(x)) / 64 AS bw, count(*) AS n FROM o GROUP BY channel),
c AS (SELECT channel, least(floor((x - lo) / bw), 63)::INT AS bin, count(*) AS w FROM o JOIN s USING (channel) GROUP BY ALL)
SELECT channel::INT AS channel, g.bin::INT AS bin, {rs('lo + (g.bin + 0.5e0) * bw')} AS centre, {rs('coalesce(w, 0) / (n * bw)')} AS density
FROM (s CROSS JOIN (SELECT unnest(range(64)) AS bin) g) LEFT JOIN c USING (channel, bin)"""


def _groups(spark, sf_dir):
    """A cluster for each return flag, of two channels with gaps."""
    return gmm.label_start(gaps(spark, sf_dir), PAIR, "l_returnflag")


#: Clusters with their moments; d is the covariance's determinant.
_MOMENTS = f"""m AS (SELECT *, aa * bb - ab * ab AS d FROM (SELECT (row_number() OVER (ORDER BY l_returnflag) - 1)::INT AS cluster, avg(x1) AS a, avg(x2) AS b, avg(x1 * x1) - avg(x1) * avg(x1) AS aa,
 avg(x2 * x2) - avg(x2) * avg(x2) AS bb, avg(CASE WHEN x2 IS NOT NULL THEN x1 * x2 END) - avg(x1) * avg(x2) AS ab, count(*) / sum(count(*)) OVER () AS share, count(*) OVER () AS k FROM {GAPS} GROUP BY l_returnflag))"""


def curves(spark, sf_dir):
    """Curves of each group's channels."""
    return views.curves(spark, _groups(spark, sf_dir)).select("channel", "cluster", "point", r("x").alias("x"), r("density").alias("density"))


def prior_curves(spark, sf_dir):
    """Curves of a prior about the groups' means: expected precisions are the groups' by 1.2."""
    m = _groups(spark, sf_dir)
    prior = gmm.make_prior(len(m.mu), 2, mu=m.mu, b=1.0, V=m.A / 10, n=12.0)
    return views.prior_curves(spark, prior).select("channel", "cluster", "point", r("x").alias("x"), r("density").alias("density"))


def _curves_sql(share, loose):
    """A channel's variance is what the other leaves of it: the determinant over the other's variance."""
    sides = " UNION ALL ".join(f"SELECT {i} AS channel, cluster, {c} AS mean, sqrt(d / {o} / {loose}) AS sd, {share} AS share FROM m" for i, (c, o) in enumerate((("a", "bb"), ("b", "aa"))))
    return f"""WITH {_MOMENTS}, s AS ({sides}) SELECT channel::INT AS channel, cluster, point::INT AS point, {rs('mean + sd * (6 * point / 99e0 - 3)')} AS x,
{rs('share * exp(-0.5 * (6 * point / 99e0 - 3) ** 2) / (sd * sqrt(2 * pi()))')} AS density FROM s CROSS JOIN (SELECT unnest(range(100)) AS point)"""


def contours(spark, sf_dir):
    """The groups' densities over both channels, and what the middle contour holds."""
    out = views.contours(spark, _groups(spark, sf_dir))
    return out.select("channel", "cluster", "a", "b", r("x").alias("x"), r("y").alias("y"), r("density").alias("density"), "inside")


_CONTOURS = f"""WITH {_MOMENTS}, g AS (SELECT cluster, u.a, v.b, m.a + sqrt(aa) * (6 * u.a / 99e0 - 3) AS x, m.b + sqrt(bb) * (6 * v.b / 99e0 - 3) AS y, m.a AS ma, m.b AS mb, aa, bb, ab, d
FROM m CROSS JOIN (SELECT unnest(range(100)) AS a) u CROSS JOIN (SELECT unnest(range(100)) AS b) v),
h AS (SELECT *, exp(-0.5 * (bb * (x - ma) ** 2 - 2 * ab * (x - ma) * (y - mb) + aa * (y - mb) ** 2) / d) / (2 * pi() * sqrt(d)) AS f FROM g)
SELECT 1::INT AS channel, cluster, a::INT AS a, b::INT AS b, {rs('x')} AS x, {rs('y')} AS y, {rs('f')} AS density, f >= (min(f) OVER (PARTITION BY cluster) + max(f) OVER (PARTITION BY cluster)) / 2 AS inside FROM h"""


def trace(spark, sf_dir):
    """The bound of each pass of a fit, and its parts, by row."""
    x = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1e5).alias("x"))
    fit = gmm.fit(x, ["x"], start=EM_START, iterations=EM_ROUNDS, tolerance=-1.0)
    n = x.agg(F.count("x").alias("n"))
    # one row
    return views.bound_trace(spark, fit).join(F.broadcast(n), how="cross").select("round", "part", r(F.col("value") / F.col("n")).alias("value"))


def _trace_sql():
    rounds = _em_sql(_X.replace("AS x", "AS x, 1e0 AS w"))
    rounds = rounds[: rounds.rindex("SELECT 1::INT AS k")]
    out = []
    for t in range(EM_ROUNDS + 1):
        log = lambda k: f"(-0.5e0 * ln(2 * pi() * v{k}) - (x - mu{k}) ** 2 / (2 * v{k}))"
        z = f"SELECT *, 1 / (1 + exp(ln(q2 / q1) + {log(2)} - {log(1)})) AS z1 FROM o, m{t}"
        inner = f"SELECT avg(z1 * {log(1)} + (1 - z1) * {log(2)}) AS lx, avg(ln(q1 * exp({log(1)}) + q2 * exp({log(2)}))) AS ev FROM ({z})"
        out += [f"SELECT {t}::INT AS round, '{part}' AS part, {rs(of)} AS value FROM ({inner})" for part, of in (("bound", "ev"), ("observations", "lx"), ("responsibilities", "ev - lx"))]
    return f"{rounds} {' UNION ALL '.join(out)}"


def class_slices(spark, sf_dir):
    """Central slices of an image of three classes, whose probabilities follow from the volume; some voxels have none."""
    v = F.col("v")
    z = F.array(v, v * v, F.when(F.col("i") % 2 == 0, 1.0).otherwise(0.0) * v)
    out = views.class_slices(volume(spark, sf_dir).withColumn("z", z), "z", DIM, views.hues(3))
    return out.select("view", "x", "y", *(r(c, 6, OFF).alias(c) for c in ("red", "green", "blue")))


def _slices_sql():
    rgb = ", ".join(f"{rs(f'{c} / nullif(v + v * v + w, 0)', 6, OFF)} AS {n}" for c, n in (("v", "red"), ("v * v", "green"), ("w", "blue")))
    full = f"(SELECT *, CASE WHEN i % 2 = 0 THEN v ELSE 0 END AS w FROM {_FULL})"
    one = lambda view, x, y, c, at: f"SELECT '{view}' AS view, {x} AS x, {y} AS y, {rgb} FROM {full} WHERE {c} = {at}"
    return " UNION ALL ".join((one("axial", "i", "j", "k", 3), one("coronal", "i", "k", "j", 6), one("sagittal", "j", "k", "i", 3)))


def field_slices(spark, sf_dir):
    """The middle slice before and after its field."""
    bases = [bias.dct_basis(5, 3), bias.dct_basis(10, 2), bias.dct_basis(5, 1)]
    out = views.field_slices(bias.reconstruct(volume(spark, sf_dir), bases, COEFF.ravel(order="F")), {"v": "bias"}, DIM[2])
    return out.select("channel", "i", "j", *(r(c, 6, OFF).alias(c) for c in ("original", "corrected", "bias", "low", "high")))


_FIELD = f"""WITH s AS (SELECT i, j, v AS original, exp({_BIAS}) AS bias, v * exp({_BIAS}) AS corrected FROM {_FULL} WHERE k = 3)
SELECT 'v' AS channel, i, j, {', '.join(f'{rs(c, 6, OFF)} AS {c}' for c in ('original', 'corrected', 'bias'))},
{rs('least(min(original) OVER (), min(corrected) OVER ())', 6, OFF)} AS low, {rs('greatest(max(original) OVER (), max(corrected) OVER ())', 6, OFF)} AS high FROM s"""

QUERIES = {
    "view_density": density, "view_curves": curves, "view_prior_curves": prior_curves, "view_contours": contours,
    "view_bound_trace": trace, "view_class_slices": class_slices, "view_field_slices": field_slices,
}
ORACLE = {
    "view_density": _density_sql(), "view_curves": _curves_sql("share", 1), "view_prior_curves": _curves_sql("1e0 / k", "1.2e0"), "view_contours": _CONTOURS,
    "view_bound_trace": _trace_sql(), "view_class_slices": _slices_sql(), "view_field_slices": _FIELD,
}
