"""Weighted histograms of any number of channels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .observations import ranges


def bin_index(x: Column, lo: float, width: float, bins: int) -> Column:
    """From 0; the last bin is closed; null where x is."""
    if width == 0:
        return F.when(x.isNotNull(), F.lit(0))
    # least() alone would put nulls into the last bin
    return F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int"))


def edge_index(x: Column, edges: list[float]) -> Column:
    """Bin by ascending inner edges: a chain of comparisons in generated code."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(x >= F.lit(e), 1).otherwise(0)
    return F.when(x.isNotNull(), out).cast("int")


def histogram(df: DataFrame, cols: list[str], bins=64, weight: str | None = None, keep_zero: bool = True, missing: bool = False, fwhm: float = 0.0) -> DataFrame:
    """(bin_<c>, v_<c> for each channel, w). bins: a number, one per channel, or lists of centres.

    missing: rows with nulls go to a bin of their own (index = number of bins, null centre), else they
    are left out. keep_zero: every combination is a row. One scan for ranges unless centres are given,
    one scan with partial sums; the grid is the product of the bins.
    """
    df = df if missing else df.na.drop("any", subset=cols)
    spec = bins if isinstance(bins, (list, tuple)) and (not bins or isinstance(bins[0], (list, tuple))) else None
    counts = [len(b) for b in spec] if spec else (list(bins) if isinstance(bins, (list, tuple)) else [bins] * len(cols))
    bounds = None if spec else ranges(df, cols)
    keys, centres = [], []
    for i, c in enumerate(cols):
        if spec:
            b = sorted(spec[i])
            keys.append(edge_index(F.col(c), [(x + y) / 2 for x, y in zip(b, b[1:])]))
            centres.append([float(x) for x in b])
        else:
            lo, hi = bounds[c]
            lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
            width = (hi - lo) / counts[i]
            keys.append(bin_index(F.col(c), lo, width, counts[i]))
            centres.append([lo + (k + 0.5) * width for k in range(counts[i])])
    if missing:
        keys = [F.coalesce(k, F.lit(n)) for k, n in zip(keys, counts)]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    out = df.select(*(k.alias(f"bin_{c}") for k, c in zip(keys, cols)), w.alias("w")).groupBy(*(f"bin_{c}" for c in cols)).agg(F.sum("w").alias("w"))
    if keep_zero or fwhm:
        out = grid(df, cols, [n + missing for n in counts]).join(F.broadcast(out) if math.prod(counts) <= 1 << 16 else out, [f"bin_{c}" for c in cols], "left").fillna(0.0, ["w"])
    if fwhm:
        for c, n in zip(cols, counts):
            out = _smooth(out, c, [x for x in cols if x != c], n, fwhm)
    if not keep_zero:
        out = out.where("w <> 0")
    at = lambda c, m: F.get(F.array(*map(F.lit, m)), F.col(f"bin_{c}"))
    return out.select(*(f"bin_{c}" for c in cols), *(at(c, m).alias(f"v_{c}") for c, m in zip(cols, centres)), "w")


def grid(df: DataFrame, cols: list[str], counts: list[int]) -> DataFrame:
    """All combinations of bins, the first channel fastest, from one range."""
    step, keys = 1, []
    for c, n in zip(cols, counts):
        keys.append(F.pmod(F.expr(f"id div {step}"), F.lit(n)).cast("int").alias(f"bin_{c}"))
        step *= n
    return df.sparkSession.range(step).select(*keys)


def gaussian_kernel(fwhm: float, radius: int) -> list[float]:
    sd = fwhm / math.sqrt(8 * math.log(2))
    k = [math.exp(-0.5 * (i / sd) ** 2) for i in range(-radius, radius + 1)]
    return [v / sum(k) for v in k]


def _smooth(h: DataFrame, c: str, others: list[str], bins: int, fwhm: float) -> DataFrame:
    radius = math.ceil(4 / 2.355 * fwhm)
    kernel = gaussian_kernel(fwhm, radius)
    line = W.partitionBy(*(f"bin_{o}" for o in others), (F.col(f"bin_{c}") >= bins)).orderBy(f"bin_{c}")
    total = sum((F.coalesce(F.lag("w", -k).over(line), F.lit(0.0)) * w for k, w in zip(range(-radius, radius + 1), kernel)), F.lit(0.0))
    return h.withColumn("w", F.when(F.col(f"bin_{c}") >= bins, F.col("w")).otherwise(total))


def density(h: DataFrame, volume: float) -> DataFrame:
    total = F.sum("w").over(W.partitionBy())
    return h.withColumn("density", F.col("w") / (total * F.lit(volume)))
