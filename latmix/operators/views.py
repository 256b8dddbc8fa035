"""What figures of mixtures, priors, class images and bias fields show, as rows.

Tables of parameters are as large as the model; points of curves are rows of an exploded sequence.
Densities and slices are one pass over the rows.
"""

from __future__ import annotations

import colorsys
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import gmm
from .histogram import bin_index
from .observations import ranges


def channel_density(df: DataFrame, cols: list[str], bins: int = 64, weight: str | None = None) -> DataFrame:
    """(channel, bin, centre, density) of each channel where it is observed; empty bins too.

    One pass for the ranges and one for all channels' bins. A channel of one value has null densities,
    one without values null centres too.
    """
    box = ranges(df, cols)
    lows, widths, places = [], [], []
    for i, c in enumerate(cols):
        lo, hi = box[c]
        width = None if lo is None else (float(hi) - float(lo)) / bins
        lows.append(F.lit(None if lo is None else float(lo)).cast("double"))
        widths.append(F.lit(width).cast("double"))
        places.append(F.struct(F.lit(i).alias("channel"), (F.lit(None) if lo is None else bin_index(F.col(c), float(lo), width, bins)).cast("int").alias("bin")))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    met = df.select(F.explode(F.array(*places)).alias("at"), w.alias("w")).select("at.*", "w").where("bin IS NOT NULL").groupBy("channel", "bin").agg(F.sum("w").alias("w"))
    sums = met.groupBy("channel").agg(F.sum("w").alias("total"))
    # at most bins rows a channel
    grid = df.sparkSession.range(bins * len(cols)).select(F.expr(f"int(id div {bins})").alias("channel"), F.expr(f"int(id % {bins})").alias("bin"))
    out = grid.join(F.broadcast(met), ["channel", "bin"], "left").join(F.broadcast(sums), "channel", "left")
    low, width = (F.get(F.array(*v), F.col("channel")) for v in (lows, widths))
    density = F.coalesce("w", F.lit(0.0)) / F.nullif(F.col("total") * width, F.lit(0.0))
    return out.select("channel", "bin", (low + (F.col("bin") + 0.5) * width).alias("centre"), density.alias("density"))


def _spread(points: int, name: str = "point") -> tuple[Column, Column]:
    """Points in their order, and where they lie from -3 to 3."""
    return F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias(name), F.col(name) * (6.0 / (points - 1)) - 3.0


def curves(spark: SparkSession, model: gmm.Mixture, points: int = 100, shares=None) -> DataFrame:
    """(channel, cluster, point, x, density): each cluster's curve over three deviations of every channel.

    A channel's variance is the inverse of its own precision. shares: in place of the proportions.
    """
    pi = model.pi if shares is None else np.asarray(shares, float)
    k, p = model.mu.shape
    rows = [(c, i, float(model.mu[i, c]), float(model.A[i, c, c]) ** -0.5, float(pi[i])) for c in range(p) for i in range(k)]
    point, at = _spread(points)
    out = spark.createDataFrame(rows, "channel int, cluster int, mean double, sd double, share double").select("*", point)
    return out.select("channel", "cluster", "point", (F.col("mean") + F.col("sd") * at).alias("x"), (F.col("share") * F.exp(-0.5 * at * at) / (F.col("sd") * math.sqrt(2 * math.pi))).alias("density"))


def prior_curves(spark: SparkSession, prior: gmm.Prior, points: int = 100) -> DataFrame:
    """curves() of a prior: its means, its expected precisions, and clusters of equal shares."""
    k = len(prior.mu)
    return curves(spark, gmm.Mixture(prior.mu, prior.V * prior.n[:, None, None], np.full(k, -math.log(k))), points)


def contours(spark: SparkSession, model: gmm.Mixture, points: int = 100) -> DataFrame:
    """(channel, cluster, a, b, x, y, density, inside): each cluster's density over the first channel and another.

    x are places of the first channel, y of the other, over three deviations; the covariance is the
    inverse of the two channels' block of the precision. inside: at or above the middle between the
    grid's least and greatest density, whose edge is the contour that a figure shows.
    """
    k, p = model.mu.shape
    rows = []
    for c in range(1, p):
        for i in range(k):
            cov = np.linalg.inv(model.A[i][np.ix_([0, c], [0, c])])
            sx, sy = np.sqrt(np.diag(cov))
            rows.append((c, i, float(model.mu[i, 0]), float(model.mu[i, c]), float(sx), float(sy), float(cov[0, 1] / (sx * sy))))
    (a, at), (b, up) = _spread(points, "a"), _spread(points, "b")
    out = spark.createDataFrame(rows, "channel int, cluster int, mx double, my double, sx double, sy double, rho double").select("*", a).select("*", b)
    left = 1 - F.col("rho") * F.col("rho")
    density = F.exp(-0.5 * (at * at - 2 * F.col("rho") * at * up + up * up) / left) / (2 * math.pi * F.col("sx") * F.col("sy") * F.sqrt(left))
    out = out.select("channel", "cluster", "a", "b", (F.col("mx") + F.col("sx") * at).alias("x"), (F.col("my") + F.col("sy") * up).alias("y"), density.alias("density"))
    level = out.groupBy("channel", "cluster").agg(((F.min("density") + F.max("density")) / 2).alias("level"))
    # as many rows as there are clusters and pairs of channels
    return out.join(F.broadcast(level), ["channel", "cluster"]).withColumn("inside", F.col("density") >= F.col("level")).drop("level")


def bound_trace(spark: SparkSession, model: gmm.Mixture) -> DataFrame:
    """(round, part, value): the bound of each pass of a fit and what it is made of; divergences count as losses."""
    rows = [(t, part, float(v)) for t, parts in enumerate(model.parts) for part, v in parts.items()]
    return spark.createDataFrame(rows, "round int, part string, value double")


def hues(k: int) -> list[tuple[float, float, float]]:
    """k full colours, evenly around the circle from red."""
    return [colorsys.hsv_to_rgb(i / k, 1.0, 1.0) for i in range(k)]


def class_slices(img: DataFrame, z: str, dim, palette) -> DataFrame:
    """(view, x, y, red, green, blue) of the central slices of an image of class probabilities.

    img: (i, j, k, z); z is an array of the classes' probabilities. Views are axial (x, y = i, j),
    coronal (i, k) and sagittal (j, k), through floor(d / 2) + 1; an image of one slice has its axial view.
    Where no class has a probability, colours are null.
    """
    views = [("axial", 2, "i", "j")] if dim[2] == 1 else [("axial", 2, "i", "j"), ("coronal", 1, "i", "k"), ("sagittal", 0, "j", "k")]
    centre = lambda axis: F.col("ijk"[axis]) == F.lit(dim[axis] // 2 + 1)
    at = [F.when(centre(axis), F.struct(F.lit(v).alias("view"), F.col(x).alias("x"), F.col(y).alias("y"))) for v, axis, x, y in views]
    rgb = gmm.palette_mix(z, palette)
    seen = img.select(F.explode(F.filter(F.array(*at), lambda s: s.isNotNull())).alias("at"), rgb.alias("rgb"))
    return seen.select("at.*", *(F.get("rgb", F.lit(n)).alias(c) for n, c in enumerate(("red", "green", "blue"))))


def field_slices(img: DataFrame, fields: dict[str, str], depth: int) -> DataFrame:
    """(channel, i, j, original, corrected, bias, low, high) of the slice at ceil(depth / 2).

    fields: channel to the column of its multiplicative field. low and high span both images of a
    channel, so that they are shown alike.
    """
    each = [F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("original"), F.col(b).cast("double").alias("bias")) for c, b in fields.items()]
    out = img.where(F.col("k") == (depth + 1) // 2).select("i", "j", F.explode(F.array(*each)).alias("at")).select("at.channel", "i", "j", "at.original", (F.col("at.original") * F.col("at.bias")).alias("corrected"), "at.bias")
    span = out.groupBy("channel").agg(F.least(F.min("original"), F.min("corrected")).alias("low"), F.greatest(F.max("original"), F.max("corrected")).alias("high"))
    return out.join(F.broadcast(span), "channel")  # a row a channel
