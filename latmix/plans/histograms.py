"""Queries: histograms, observation codes, masks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import histogram, observations
from .common import GAPS, gaps, r, rs, table


def hist1d(spark, sf_dir):
    h = histogram.histogram(table(spark, sf_dir, "orders"), ["o_totalprice"], 32)
    return h.select("bin_o_totalprice", r("v_o_totalprice", 3).alias("v_o_totalprice"), "w")


_RANGE1 = "SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 32 AS bw FROM orders"
_HIST1 = f"""WITH b AS ({_RANGE1}), n AS (SELECT least(floor((o_totalprice - lo) / bw), 31)::INT AS i, count(*)::DOUBLE AS w FROM orders, b GROUP BY 1)
SELECT g.i::INT AS bin_o_totalprice, {rs('lo + (g.i + 0.5e0) * bw', 3)} AS v_o_totalprice, coalesce(w, 0) AS w FROM (SELECT unnest(range(32)) AS i) g CROSS JOIN b LEFT JOIN n USING (i)"""


def hist2d(spark, sf_dir):
    """Weighted, with a bin for missing values, empty bins left out."""
    h = histogram.histogram(gaps(spark, sf_dir), ["x1", "x2"], [10, 6], weight="l_quantity", keep_zero=False, missing=True)
    return h.select("bin_x1", "bin_x2", r("v_x1").alias("v_x1"), r("v_x2").alias("v_x2"), "w")


_HIST2 = f"""WITH o AS (SELECT * FROM {GAPS}), b AS (SELECT min(x1) AS l1, (max(x1) - min(x1)) / 10 AS b1, min(x2) AS l2, (max(x2) - min(x2)) / 6 AS b2 FROM o)
SELECT i AS bin_x1, j AS bin_x2, {rs('CASE WHEN i < 10 THEN l1 + (i + 0.5e0) * b1 END')} AS v_x1, {rs('CASE WHEN j < 6 THEN l2 + (j + 0.5e0) * b2 END')} AS v_x2, sum(l_quantity) AS w
FROM (SELECT *, CASE WHEN x1 IS NULL THEN 10 ELSE least(floor((x1 - l1) / b1), 9) END::INT AS i, CASE WHEN x2 IS NULL THEN 6 ELSE least(floor((x2 - l2) / b2), 5) END::INT AS j FROM o, b) GROUP BY i, j, l1, b1, l2, b2"""
CENTRES = [5.0, 15.0, 20.0, 40.0]


def hist_centres(spark, sf_dir):
    h = histogram.histogram(table(spark, sf_dir, "lineitem"), ["l_quantity"], [CENTRES])
    return h.select("bin_l_quantity", "v_l_quantity", "w")


_CENTRES = f"""WITH n AS (SELECT CASE WHEN l_quantity >= 30 THEN 3 WHEN l_quantity >= 17.5 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS i, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1)
SELECT g.i::INT AS bin_l_quantity, ({CENTRES}::DOUBLE[])[g.i + 1] AS v_l_quantity, coalesce(w, 0) AS w FROM (SELECT unnest(range(4)) AS i) g LEFT JOIN n USING (i)"""


def hist_smooth(spark, sf_dir):
    h = histogram.histogram(table(spark, sf_dir, "events"), ["value"], 24, fwhm=2.0)
    return histogram.density(h, 1.0).select("bin_value", r("w", 4).alias("w"), r("density").alias("density"))


def _smooth_sql():
    radius = math.ceil(4 / 2.355 * 2.0)
    k = histogram.gaussian_kernel(2.0, radius)
    w = " + ".join(f"coalesce(lag(w, {s}) OVER (ORDER BY i), 0) * {x!r}" if s >= 0 else f"coalesce(lead(w, {-s}) OVER (ORDER BY i), 0) * {x!r}" for s, x in zip(range(-radius, radius + 1), k))
    return f"""WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 24 AS bw FROM events), n AS (SELECT least(floor((value - lo) / bw), 23)::INT AS i, count(*)::DOUBLE AS w FROM events, b WHERE value IS NOT NULL GROUP BY 1),
g AS (SELECT i::INT AS i, coalesce(w, 0) AS w FROM (SELECT unnest(range(24)) AS i) LEFT JOIN n USING (i)), s AS (SELECT i, {w} AS w FROM g)
SELECT i AS bin_value, {rs('w', 4)} AS w, {rs('w / sum(w) OVER ()')} AS density FROM s"""


def obs_codes(spark, sf_dir):
    rows = observations.canonical(gaps(spark, sf_dir), ["x1", "x2", "x3"]).withColumn("code", observations.pattern_code(["x1", "x2", "x3"]))
    bits = observations.code_bits(F.col("code"), 3)
    out = rows.withColumn("bits", bits).withColumn("back", observations.bits_code(F.col("bits")))
    return out.groupBy("code", "back").agg(F.count("*").alias("n"), F.first(F.size(F.filter("bits", lambda b: b))).alias("observed"))


_CODE = "(CASE WHEN x1 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN x2 IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN x3 IS NOT NULL THEN 4 ELSE 0 END)::BIGINT"


def _mask(modality, only_nan):
    def run(spark, sf_dir):
        x = table(spark, sf_dir, "customer").withColumn("ok", observations.modality_mask(F.col("c_acctbal"), modality, only_nan))
        return x.groupBy("c_mktsegment", "ok").agg(F.count("*").alias("n"))

    return run


_MASK = "SELECT c_mktsegment, {} AS ok, count(*) AS n FROM customer GROUP BY 1, 2"


def drop_missing(spark, sf_dir):
    rows = gaps(spark, sf_dir)
    kept = observations.drop_missing(rows, ["x1", "x2", "x3"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return observations.reinsert(rows.select("l_orderkey").distinct(), kept, "l_orderkey", {"n": 0})


def channel_ranges(spark, sf_dir):
    b = observations.ranges(gaps(spark, sf_dir), ["x1", "x2", "x3"])
    return spark.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in b.items()], "channel string, lo double, hi double").select("channel", r("lo").alias("lo"), r("hi").alias("hi"))


QUERIES = {
    "hist1d": hist1d, "hist2d_weighted_missing": hist2d, "hist_centres": hist_centres, "hist_smooth_density": hist_smooth, "obs_code_counts": obs_codes,
    "msk_mri": _mask("mri", False), "msk_mri_nan": _mask("MRI", True), "msk_ct": _mask("CT", False), "drop_missing_reinsert": drop_missing, "channel_ranges": channel_ranges,
}
ORACLE = {
    "hist1d": _HIST1, "hist2d_weighted_missing": _HIST2, "hist_centres": _CENTRES, "hist_smooth_density": _smooth_sql(),
    "obs_code_counts": f"SELECT code, code AS back, count(*) AS n, bit_count(code)::INT AS observed FROM (SELECT {_CODE} AS code FROM {GAPS}) GROUP BY code",
    "msk_mri": _MASK.format("c_acctbal > 0"), "msk_mri_nan": _MASK.format("c_acctbal >= 0"), "msk_ct": _MASK.format("(c_acctbal <> 0 AND c_acctbal > -1020 AND c_acctbal < 3000)"),
    "drop_missing_reinsert": f"SELECT l_orderkey, count(*) FILTER (x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL) AS n FROM {GAPS} GROUP BY l_orderkey",
    "channel_ranges": " UNION ALL ".join(f"SELECT '{c}' AS channel, {rs(f'min({c})')} AS lo, {rs(f'max({c})')} AS hi FROM {GAPS}" for c in ("x1", "x2", "x3")),
}
