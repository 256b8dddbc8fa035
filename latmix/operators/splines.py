"""B-spline coefficients and sampling of degree 0 to 7 on (i, j, k, value...) tables.

Coefficients: along each axis in turn the voxels of a line meet as one row (a line is as long as the
image's side), lines of a batch are filtered together by the causal and the anti-causal recursion, and
go back to voxels.

Sampling: the image is cut into bricks that also hold the layers around them, and a place goes to the
brick that it lies in, together with the places of its part of the output only, so that many places in
one brick are many tasks. Both sides are shuffled once; a task holds one brick and streams its places.

Boundaries: 'circular'; 'symmetric' mirrors at voxels' edges, 'mirror' at their centres; 'replicate'
moves places to the edge; 'constant' is 0 outside. The last two filter as 'mirror', and 'constant' is
then 0 at places outside the outermost centres (degrees 0 and 1: neighbours outside are 0). A voxel that
is missing, null or NaN is 0; a place that is null or not finite gets 0.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

AXES = ("i", "j", "k")
#: Side of a brick, and of the parts of the output.
BRICK, PART = 32, 64
MODES = ("circular", "symmetric", "mirror", "replicate", "constant")


def pieces(degree: int) -> np.ndarray:
    """(degree + 1) x (degree + 1): the polynomial of t, lowest power first, by which each neighbour is weighted.

    From the Cox-de Boor recursion on uniform knots; t is the part of the way from one knot to the next.
    """
    w = np.ones((1, 1))
    for p in range(1, degree + 1):
        new = np.zeros((p + 1, p + 1))
        for m in range(p + 1):  # the function whose support begins m - p knots from here
            j = m - p
            if m > 0:  # (t - j) / p times the lower one that begins there
                new[m, 1:] += w[m - 1] / p
                new[m, :-1] += -j * w[m - 1] / p
            if m < p:  # (j + p + 1 - t) / p times the next one
                new[m, 1:] += -w[m] / p
                new[m, :-1] += (j + p + 1) * w[m] / p
        w = new
    return w


def poles(degree: int) -> np.ndarray:
    """Roots inside the unit circle of the spline's values at integers."""
    at = 0.0 if degree % 2 else 0.5
    values = pieces(degree) @ at ** np.arange(degree + 1)
    values = values[np.abs(values) > 1e-14]
    roots = np.roots(values)
    return np.sort(roots[np.abs(roots) < 1].real)


def filter_lines(x: np.ndarray, degree: int, bnd: str) -> np.ndarray:
    """Coefficients of the lines of x (lines x n), as of one period of what the boundary makes of them."""
    n = x.shape[1]
    if degree < 2 or n == 1:
        return x
    if bnd == "symmetric":
        c = np.hstack([x, x[:, ::-1]])
    elif bnd == "circular":
        c = x
    else:
        c = np.hstack([x, x[:, -2:0:-1]])
    c = np.ascontiguousarray(c.T)
    period = len(c)
    for z in poles(degree):
        c *= (1 - z) * (1 - 1 / z)
        power = z ** np.arange(period)
        rest = 1 - z**period
        c[0] = (power @ c[-np.arange(period) % period]) / rest
        for i in range(1, period):
            c[i] += z * c[i - 1]
        c[-1] = -z / rest * (power @ c[(period - 1 + np.arange(period)) % period])
        for i in range(period - 2, -1, -1):
            c[i] = z * (c[i + 1] - c[i])
    return c[:n].T


def coefficients(img: DataFrame, dim, degree: int, bnd: str = "mirror", values=("v",), axes=AXES, key=()) -> DataFrame:
    """(key, axes, values): img's values as spline coefficients; every voxel of a line that has one is given."""
    if degree < 2:
        return img.select(*key, *axes, *values)
    clean = lambda v: F.when(F.isnan(F.col(v).cast("double")) | F.col(v).isNull(), 0.0).otherwise(F.col(v).cast("double")).alias(v)
    out = img.select(*key, *axes, *(clean(v) for v in values))
    for a, n in zip(axes, dim):
        out = _along(out, a, n, degree, bnd, values, [*key, *(x for x in axes if x != a)]).select(*key, *axes, *values)
    return out


def _along(img: DataFrame, axis: str, n: int, degree: int, bnd: str, values, others) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            line = batch.column("line")
            at = line.flatten()
            row = np.repeat(np.arange(batch.num_rows), line.value_lengths().to_numpy())
            place = at.field(axis).to_numpy() - 1
            inside = (place >= 0) & (place < n)
            done = []
            for v in values:
                x = np.zeros((batch.num_rows, n))
                x[row[inside], place[inside]] = at.field(v).to_numpy(zero_copy_only=False)[inside]
                done.append(pa.array(np.ascontiguousarray(filter_lines(x, degree, bnd)).ravel()))
            back = np.repeat(np.arange(batch.num_rows), n)
            rest = [batch.column(o).take(pa.array(back)) for o in others]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), batch.num_rows)), *done], names=[*others, axis, *values])

    lines = img.groupBy(*others).agg(F.collect_list(F.struct(F.col(axis).cast("int").alias(axis), *values)).alias("line")).select(*others, "line")
    fields = [f"`{o}` {img.schema[o].dataType.simpleString()}" for o in others] + [f"`{axis}` int"] + [f"`{v}` double" for v in values]
    return lines.mapInArrow(run, ", ".join(fields))


def _images(c: Column, n: int, reach: int, bnd: str) -> Column:
    """Places within reach of 1..n where the boundary shows voxel c."""
    shifts = {"circular": (n, [(1, 0)]), "symmetric": (2 * n, [(1, 0), (-1, 1)]), "mirror": (max(2 * n - 2, 1), [(1, 0), (-1, 2)])}.get(bnd)
    if not shifts:
        return F.array(c)
    period, kinds = shifts
    many = math.ceil((reach + n) / period) + 1
    every = [F.lit(sign) * c + (start + m * period) for sign, start in kinds for m in range(-many, many + 1)]
    return F.array_distinct(F.filter(F.array(*every), lambda p: p.between(1 - reach, n + reach)))


def _folded(y: Column, n: int, bnd: str) -> Column:
    """A place within the image where the boundary shows the same."""
    if bnd == "replicate":
        return F.greatest(F.lit(1.0), F.least(F.lit(float(n)), y))
    if bnd == "circular":
        return F.pmod(y - 1, F.lit(float(n))) + 1
    if bnd == "symmetric":
        r = F.pmod(y - 0.5, F.lit(2.0 * n))
        return F.when(r > n, 2.0 * n - r).otherwise(r) + 0.5
    if bnd == "mirror":
        if n == 1:
            return F.lit(1.0)
        r = F.pmod(y - 1, F.lit(2.0 * n - 2))
        return F.when(r > n - 1, 2.0 * n - 2 - r).otherwise(r) + 1
    return y


def sample(img: DataFrame, warp: DataFrame, dim, values=("v",), degree: int = 1, bnd: str = "circular", keep=AXES, prefiltered: bool = False) -> DataFrame:
    """(keep, values): img's values at the warp's places y1, y2, y3 (in voxels), one row a row of warp.

    keep: the warp's columns that name a place. Of degree 2 on, img is filtered first, unless it holds
    coefficients already.
    """
    if not 0 <= degree <= 7 or bnd not in MODES:
        raise ValueError(f"degrees 0 to 7 and boundaries {MODES}")
    smooth = degree > 1
    inner = ("mirror" if bnd in ("replicate", "constant") else bnd) if smooth else bnd
    if smooth and not prefiltered:
        img = coefficients(img, dim, degree, inner, values)
    reach, half = degree // 2 + 2, 0.0 if degree % 2 else 0.5
    names = [f"_k{n}" for n in range(len(keep))]

    # a place's brick, its part of the output, and whether it counts
    y = [F.col(f"y{n}").cast("double") for n in (1, 2, 3)]
    fine = reduce(Column.__and__, (F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c) for c in y))
    if bnd == "constant":
        far = 0 if smooth else 1
        for c, n in zip(y, dim):
            fine &= (c >= 1 - far) & (c <= n + far)
    at = [F.when(fine, _folded(_folded(c, n, bnd), n, inner)).otherwise(1.0) for c, n in zip(y, dim)]
    spots = warp.select(*(F.col(c).alias(a) for c, a in zip(keep, names)), fine.alias("_fine"), *(a.alias(f"_y{n}") for n, a in enumerate(at)))
    brick = lambda p, n: F.greatest(F.lit(0), F.least(F.floor((p - 1) / BRICK).cast("int"), F.lit((n - 1) // BRICK)))
    part = F.array(*(F.floor(F.col(a) / PART).cast("int") for c, a in zip(keep, names) if c in AXES)).cast("array<int>")
    spots = spots.select("*", *(brick(F.floor(F.col(f"_y{n}") + half), d).alias(f"_b{n}") for n, d in enumerate(dim)), part.alias("_part"))
    bricks, group = [f"_b{n}" for n in range(3)], ["_b0", "_b1", "_b2", "_part"]

    # a voxel goes to every brick that it is in or near
    clean = lambda v: F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(0.0)), F.lit(0.0))
    cells = img.where(reduce(Column.__and__, (F.col(a).between(1, n) for a, n in zip(AXES, dim)))).select(*(F.col(a).cast("int").alias(f"_s{n}") for n, a in enumerate(AXES)), F.array(*(clean(v) for v in values)).alias("_v"))
    for n, d in enumerate(dim):
        cells = cells.withColumn(f"_p{n}", F.explode(_images(F.col(f"_s{n}"), d, reach, inner)))
        last = (d - 1) // BRICK
        near = F.sequence(F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col(f"_p{n}") - 1 - reach) / BRICK).cast("int"))), F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col(f"_p{n}") - 1 + reach) / BRICK).cast("int"))))
        cells = cells.withColumn(f"_b{n}", F.explode(near))
    wanted = spots.select(*group).distinct()
    cells = cells.join(wanted, bricks).select(*group, F.lit(0).alias("_kind"), *(F.col(f"_p{n}").cast("double").alias(f"_y{n}") for n in range(3)), "_v", F.lit(True).alias("_fine"), *(F.lit(None).cast(spots.schema[a].dataType).alias(a) for a in names))
    spots = spots.select(*group, F.lit(1).alias("_kind"), *(f"_y{n}" for n in range(3)), F.lit(None).cast("array<double>").alias("_v"), "_fine", *names)
    met = cells.unionByName(spots).repartition(*group).sortWithinPartitions(*group, "_kind")
    fields = [f"`{a}` {spots.schema[a].dataType.simpleString()}" for a in names] + [f"`{v}` double" for v in values]
    got = met.mapInArrow(_gather(names, list(values), [int(d) for d in dim], degree, reach), ", ".join(fields))
    return got.select(*(F.col(a).alias(c) for c, a in zip(keep, names)), *values)


def _gather(names: list[str], values: list[str], dim: list[int], degree: int, reach: int):
    weights, half, shift, side = pieces(degree), 0.0 if degree % 2 else 0.5, -degree + (degree + 1) // 2, BRICK + 2 * reach + 1

    def run(batches):
        import pyarrow as pa

        own, field, base = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.stack([batch.column(f"_b{n}").to_numpy() for n in range(3)], 1)
            part = batch.column("_part").flatten().to_numpy().reshape(batch.num_rows, -1)
            kind = batch.column("_kind").to_numpy()
            mark = np.hstack([b, part, kind[:, None]])
            starts = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]).any(1)))
            y = np.stack([batch.column(f"_y{n}").to_numpy() for n in range(3)], 1)
            for s, e in zip(starts, [*starts[1:], len(mark)]):
                if own is None or (mark[s, :-1] != own).any():
                    own, base = mark[s, :-1], b[s] * BRICK + 1 - reach
                    field = np.zeros((len(values), side, side, side))
                if kind[s] == 0:
                    p = y[s:e].astype(int) - base
                    field[:, p[:, 0], p[:, 1], p[:, 2]] = batch.column("_v").slice(s, e - s).flatten().to_numpy().reshape(e - s, -1).T
                    continue
                some = batch.slice(s, e - s)
                low = np.floor(y[s:e] + half)
                t = y[s:e] + half - low
                w = [np.polynomial.polynomial.polyval(t[:, n], weights.T) for n in range(3)]  # neighbours x places
                first = low.astype(int) + shift - base
                total = np.zeros((len(values), e - s))
                for m in np.ndindex(*[degree + 1] * 3):
                    at = [np.clip(first[:, n] + m[n], 0, side - 1) for n in range(3)]
                    total += field[:, at[0], at[1], at[2]] * (w[0][m[0]] * w[1][m[1]] * w[2][m[2]])
                total[:, ~some.column("_fine").to_numpy(zero_copy_only=False)] = 0.0
                yield pa.RecordBatch.from_arrays([*(some.column(a) for a in names), *(pa.array(x) for x in total)], names=[*names, *values])

    return run
