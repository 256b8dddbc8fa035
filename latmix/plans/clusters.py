"""Queries: k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import kmeans
from .common import GAPS, gaps, r, rs, table

CENTRES = np.array([[1.0, 1.0, 1.0], [2.5, 2.5, 2.0], [4.0, 4.0, 3.0]])
COLS = ["x1", "x2", "x3"]


#: Components of an embedding.
CHANNELS = 64


def _dist_sql(c, cols, metric):
    if metric == "sqeuclidian":
        return "sqrt(" + " + ".join(f"coalesce(power({x} - {float(v)!r}, 2), 0)" for x, v in zip(cols, c)) + ")"
    return "(" + " + ".join(f"coalesce(abs({x} - {float(v)!r}), 0)" for x, v in zip(cols, c)) + ")"


def _label_sql(cents, cols, metric, source):
    d = [_dist_sql(c, cols, metric) for c in cents]
    least = f"least({', '.join(d)})"
    case = "CASE " + " ".join(f"WHEN {x} = {least} THEN {i + 1}" for i, x in enumerate(d)) + " END"
    return f"SELECT *, {case} AS label, {least} AS dist FROM {source}"


def _apply(metric, missing):
    def run(spark, sf_dir):
        out = kmeans.assign(gaps(spark, sf_dir), COLS, CENTRES, metric, missing)
        return out.groupBy("label").agg(F.count("*").alias("n"), r(F.sum("dist") / 1000).alias("sumd"))

    return run


def _apply_sql(metric, missing):
    inner = _label_sql(CENTRES, COLS, metric, GAPS)
    if not missing:
        whole = "x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL"
        inner = f"SELECT CASE WHEN {whole} THEN label ELSE 0 END AS label, CASE WHEN {whole} THEN dist END AS dist FROM ({inner})"
    return f"SELECT label, count(*) AS n, {rs('sum(dist) / 1000')} AS sumd FROM ({inner}) GROUP BY label"


ROUNDS = 4
START = np.array([[1.0, 1.0], [3.0, 3.0], [5.0, 4.0]])


def kmeans_fit(spark, sf_dir):
    c, _, sums = kmeans.fit(gaps(spark, sf_dir), ["x1", "x2"], weight="l_quantity", init=START, iterations=ROUNDS, tolerance=-1.0, order="magnitude")
    rows = [(i + 1, float(x[0]), float(x[1]), float(s)) for i, (x, s) in enumerate(zip(c, sums))]
    return spark.createDataFrame(rows, "label int, x1 double, x2 double, sumd double").select("label", r("x1").alias("x1"), r("x2").alias("x2"), r(F.col("sumd") / 1e4, 4).alias("sumd"))


def _fit_sql():
    """Unrolled: centroids as a table, an assignment and an update a round."""
    out = [f"o AS (SELECT row_number() OVER () AS id, x1, x2, l_quantity AS w FROM {GAPS})"]
    out.append("c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(START.tolist())) + ") t(k, c1, c2))")
    for t in range(ROUNDS):
        d = "sqrt(coalesce(power(x1 - c1, 2), 0) + coalesce(power(x2 - c2, 2), 0))"
        out.append(f"d{t} AS (SELECT id, x1, x2, w, k, {d} AS d FROM o, c{t})")
        out.append(f"a{t} AS (SELECT * FROM d{t} QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1)")
        out.append(f"c{t + 1} AS (SELECT k, sum(w * x1) / sum(CASE WHEN x1 IS NOT NULL THEN w END) AS c1, sum(w * x2) / sum(CASE WHEN x2 IS NOT NULL THEN w END) AS c2 FROM a{t} GROUP BY k)")
    t = ROUNDS
    final = f"SELECT c{t}.k, c1, c2, s FROM c{t} JOIN (SELECT k, sum(w * d) AS s FROM a{t - 1} GROUP BY k) USING (k)"
    return f"WITH {', '.join(out)} SELECT (row_number() OVER (ORDER BY sqrt(c1 * c1 + c2 * c2)))::INT AS label, {rs('c1')} AS x1, {rs('c2')} AS x2, {rs('s / 1e4', 4)} AS sumd FROM ({final})"


def kmeans_embeddings(spark, sf_dir):
    """City-block assignment of the embeddings, all channels, and the objective by label."""
    e = table(spark, sf_dir, "embeddings").select("label", *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(CHANNELS))).withColumnRenamed("label", "topic")
    cents = [[0.1 * (k - 1)] * CHANNELS for k in range(3)]
    out = kmeans.assign(e, [f"e{i}" for i in range(CHANNELS)], cents, "cityblock")
    return out.groupBy("topic", "label").agg(F.count("*").alias("n"), r(F.sum("dist")).alias("objective"))


def _embeddings_sql():
    src = "(SELECT label AS topic, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(CHANNELS)) + " FROM embeddings)"
    inner = _label_sql([[0.1 * (k - 1)] * CHANNELS for k in range(3)], [f"e{i}" for i in range(CHANNELS)], "cityblock", src)
    return f"SELECT topic, label, count(*) AS n, {rs('sum(dist)')} AS objective FROM ({inner}) GROUP BY topic, label"


def kmeans_start_linspace(spark, sf_dir):
    c = kmeans.start(table(spark, sf_dir, "customer"), ["c_acctbal"], 4, "linspace")
    return spark.createDataFrame([(i + 1, float(x[0])) for i, x in enumerate(c)], "k int, c double").select("k", r("c").alias("c"))


def kmeans_fit_plus(spark, sf_dir):
    """Seeded k-means++ start on orders; no SQL gives the same draw."""
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1e5).alias("x"), F.dayofyear("o_orderdate").cast("double").alias("d"))
    c, cost, sums = kmeans.fit(o, ["x", "d"], 4, replicates=2, iterations=20)
    return spark.createDataFrame([(i + 1, *map(float, x), float(s)) for i, (x, s) in enumerate(zip(c, sums))], "label int, x double, d double, sumd double")


QUERIES = {
    "kmeans_apply_l2": _apply("sqeuclidian", True),
    "kmeans_apply_l1": _apply("cityblock", True),
    "kmeans_apply_missing": _apply("sqeuclidian", False),
    "kmeans_fit_provided": kmeans_fit,
    "kmeans_objective": kmeans_embeddings,
    "kmeans_start_linspace": kmeans_start_linspace,
    "kmeans_fit_plus": kmeans_fit_plus,
}
ORACLE = {
    "kmeans_apply_l2": _apply_sql("sqeuclidian", True),
    "kmeans_apply_l1": _apply_sql("cityblock", True),
    "kmeans_apply_missing": _apply_sql("sqeuclidian", False),
    "kmeans_fit_provided": _fit_sql(),
    "kmeans_objective": _embeddings_sql(),
    "kmeans_start_linspace": f"SELECT k::INT AS k, {rs('lo + (hi - lo) * k / 5')} AS c FROM (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), (SELECT unnest([1, 2, 3, 4]) AS k)",
}
