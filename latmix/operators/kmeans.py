"""Weighted k-means with missing channels: fit, apply, starts and orders.

Distances are Euclidean (not squared) or city-block; a missing channel adds nothing. Assignment is a
projection; an update is one aggregate with partial sums, so an iteration moves K rows a task.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .observations import ranges

TOLERANCE, MOST = 1e-7, 1000


def distances(cols: list[str], centroids: np.ndarray, metric: str = "sqeuclidian") -> list[Column]:
    """One column for each centroid."""
    out = []
    for c in centroids:
        gap = [F.coalesce(F.abs(F.col(x) - F.lit(float(v))), F.lit(0.0)) for x, v in zip(cols, c) if not math.isnan(v)]
        if metric == "sqeuclidian":
            out.append(F.sqrt(reduce(lambda a, b: a + b, (g * g for g in gap), F.lit(0.0))))
        elif metric == "cityblock":
            out.append(reduce(lambda a, b: a + b, gap, F.lit(0.0)))
        else:
            raise ValueError(f"unknown distance {metric}")
    return out


def assign(df: DataFrame, cols: list[str], centroids, metric: str = "sqeuclidian", missing: bool = True, keep_distances: bool = False) -> DataFrame:
    """df with ``label`` (from 1; the first of equally near centroids) and ``dist``. A projection; streams too.

    missing False: rows with a null channel get label 0 and no distance.
    """
    d = F.array(*distances(cols, np.asarray(centroids, float), metric))
    out = df.withColumn("__d", d).withColumn("dist", F.array_min("__d")).withColumn("label", F.array_position("__d", F.col("dist")).cast("int"))
    if not missing:
        whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))
        out = out.withColumn("label", F.when(whole, F.col("label")).otherwise(0)).withColumn("dist", F.when(whole, F.col("dist")))
    return out.withColumnRenamed("__d", "distances") if keep_distances else out.drop("__d")


def statistics(assigned: DataFrame, cols: list[str], weight: str | None = None) -> DataFrame:
    """Per label: rows, weight, within-cluster distance, weighted means over present channels."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean = lambda c: (F.sum(w * F.col(c)) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0.0))).alias(c)
    return assigned.groupBy("label").agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * F.col("dist")).alias("sumd"), *map(mean, cols))


def start(df: DataFrame, cols: list[str], k: int, method: str = "plus", weight: str | None = None, seed: int = 0, metric: str = "sqeuclidian") -> np.ndarray:
    """K x P centroids: 'plus', 'sample', 'uniform', or 'linspace'. Only K rows reach the driver."""
    rng = np.random.default_rng(seed)
    if method in ("uniform", "linspace"):
        box = ranges(df, cols)
        lo, hi = (np.array([box[c][i] for c in cols], float) for i in (0, 1))
        return rng.uniform(lo, hi, (k, len(cols))) if method == "uniform" else np.stack([lo + (hi - lo) * (i + 1) / (k + 1) for i in range(k)])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.na.drop("any", subset=cols).where(w > 0).select(*(F.col(c).cast("double").alias(c) for c in cols), w.alias("__w"))

    def draw(mass: Column, n: int, salt: int) -> np.ndarray:
        # the n least of Exp(1) / mass are a draw without replacement in proportion to mass
        u = (F.pmod(F.xxhash64(*cols, F.lit(salt)), F.lit(1 << 52)) + 1) / float(1 << 52)
        got = rows.where(mass > 0).select(*cols, (-F.log(u) / mass).alias("__key")).orderBy("__key", *cols).limit(n).collect()
        return np.array([[r[c] for c in cols] for r in got])

    salt = int(rng.integers(1 << 30))
    if method == "sample":
        return draw(F.col("__w"), k, salt)
    if method != "plus":
        raise ValueError(f"unknown start {method}")
    centroids = draw(F.col("__w"), 1, salt)
    while len(centroids) < k:
        near = reduce(F.least, distances(cols, centroids, metric)) if len(centroids) > 1 else distances(cols, centroids, metric)[0]
        more = draw(near * F.col("__w"), 1, salt + len(centroids))
        if not len(more):
            break
        centroids = np.vstack([centroids, more])
    return centroids


def ordered(centroids: np.ndarray, totals: np.ndarray, order: str | None) -> np.ndarray:
    """The permutation that sorts centroids."""
    if order == "magnitude":
        key = np.linalg.norm(centroids, axis=1)
    elif order == "total":
        key = totals
    elif order == "intensity":
        key = centroids[:, 0]
    elif order is None:
        return np.arange(len(centroids))
    else:
        raise ValueError(f"unknown order {order}")
    return np.argsort(key, kind="stable")


def fit(df: DataFrame, cols: list[str], k: int | None = None, weight: str | None = None, metric: str = "sqeuclidian", init="plus", replicates: int = 1, missing: bool = True, order: str | None = "magnitude", seed: int = 0, iterations: int = MOST, tolerance: float = TOLERANCE):
    """(centroids K x P, objective, within-cluster sums). Best of the replicates by the objective.

    An empty cluster keeps its centroid. The frame is cached while it is iterated over.
    """
    base = (df if missing else df.na.drop("any", subset=cols)).select(*(F.col(c).cast("double").alias(c) for c in cols), *([weight] if weight else [])).persist()
    best = None
    try:
        for r in range(replicates):
            c = np.asarray(start(base, cols, k, init, weight, seed + r, metric) if isinstance(init, str) else init, float)
            last, sums = math.inf, None
            for _ in range(iterations):
                got = {s["label"]: s for s in statistics(assign(base, cols, c, metric), cols, weight).collect()}
                cost = sum(s["sumd"] or 0.0 for s in got.values())
                sums = np.array([(got[i + 1]["sumd"] if i + 1 in got else 0.0) for i in range(len(c))])
                totals = np.array([(got[i + 1]["w"] if i + 1 in got else 0.0) for i in range(len(c))])
                if last < math.inf and (last - cost) / max(last, 1e-300) < tolerance:
                    break
                last = cost
                new = c.copy()
                for label, s in got.items():
                    for p, name in enumerate(cols):
                        if s[name] is not None:
                            new[label - 1, p] = s[name]
                c = new
            if best is None or cost < best[1]:
                best = (c, cost, sums, totals)
    finally:
        base.unpersist()
    c, cost, sums, totals = best
    perm = ordered(c, totals, order)
    return c[perm], cost, sums[perm]


def categorical_draw(df: DataFrame, weight: str, key: str, u: Column, buckets: int = 1024) -> DataFrame:
    """Rows with the cumulative share at which an inverse-CDF draw of u picks them (``picked``).

    Rows lie in the order of their buckets (the first 32 bits of the key's MD5, modulo how many there
    are), then of the key: running sums are taken within buckets and of the buckets' totals, so no task
    sees all rows.
    """
    rows = df.withColumn("__bucket", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % buckets)
    sums = rows.groupBy("__bucket").agg(F.sum(weight).alias("__sum"))
    ends = sums.select("__bucket", (F.sum("__sum").over(W.orderBy("__bucket")) - F.col("__sum")).alias("__start"), F.sum("__sum").over(W.partitionBy()).alias("__total"))
    out = rows.join(F.broadcast(ends), "__bucket").withColumn("__run", F.col("__start") + F.sum(weight).over(W.partitionBy("__bucket").orderBy(key)))  # so many rows as there are buckets
    low = (F.col("__run") - F.col(weight)) / F.col("__total")
    out = out.withColumn("cum", F.col("__run") / F.col("__total")).withColumn("picked", (u < F.col("cum")) & (u >= low))
    return out.drop("__bucket", "__start", "__total", "__run")
