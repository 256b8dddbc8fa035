"""Lattice and image operators on (i, j, k, v) tables, indices from 1, and 4 x 4 affines."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import splines
from .splines import AXES


def lattice(spark: SparkSession, dim) -> DataFrame:
    """All voxels, the first index fastest."""
    step, cols = 1, []
    for a, n in zip(AXES, dim):
        cols.append((F.pmod(F.expr(f"id div {step}"), F.lit(n)) + 1).cast("int").alias(a))
        step *= n
    return spark.range(step).select(*cols)


def _at(value, axis: str, offset: int, axes=AXES, key=()) -> Column:
    """The value of the voxel that lies offset further along an axis; null where the table has none there.

    Voxels are found by their index, not by their place in the table, and within one image: key names
    the columns that tell images apart.
    """
    line = W.partitionBy(*key, *(a for a in axes if a != axis)).orderBy(axis)
    return F.max(value).over(line.rangeBetween(offset, offset))


def gradient(img: DataFrame, vx=(1.0, 1.0, 1.0), axes=AXES, key=()) -> DataFrame:
    """img with d<axis>: forward differences, 0 at the far edge and before an absent voxel."""
    return img.withColumns({f"d{a}": F.coalesce((_at("v", a, 1, axes, key) - F.col("v")) / F.lit(float(s)), F.lit(0.0)) for a, s in zip(axes, vx)})


def divergence(field: DataFrame, dim, vx=(1.0, 1.0, 1.0), axes=AXES, key=()) -> DataFrame:
    """Adjoint of the forward differences, from columns d<axis>: (key, axes, v)."""
    total = F.lit(0.0)
    for a, n, s in zip(axes, dim, vx):
        here = F.when(F.col(a) < n, F.col(f"d{a}")).otherwise(0.0)
        total = total + (F.coalesce(_at(f"d{a}", a, -1, axes, key), F.lit(0.0)) - here) / F.lit(float(s))
    return field.select(*key, *axes, total.alias("v"))


def smooth(img: DataFrame, fwhm=10.0, vs=(1.0, 1.0, 1.0), axes=AXES, key=()) -> DataFrame:
    """Separable Gaussian of the given width in mm; what reaches over the edge is left out, not renormalised."""
    for a, s in zip(axes, vs):
        f = fwhm / s
        sd, radius = f / math.sqrt(8 * math.log(2)), round(6 * f / math.sqrt(8 * math.log(2)))
        k = [math.exp(-0.5 * (x / sd) ** 2) for x in range(-radius, radius + 1)] if radius else [1.0]
        total = F.lit(0.0)
        for x, w in zip(range(-radius, radius + 1), k):
            total = total + F.coalesce(_at("v", a, -x, axes, key) if x else F.col("v"), F.lit(0.0)) * F.lit(w / sum(k))
        img = img.withColumn("v", total)
    return img


def source_index(i: Column, n: int, method: str) -> Column:
    """The index within 1..n that position i takes its value from; null for a constant."""
    if method == "circular":
        return F.pmod(i - 1, F.lit(n)) + 1
    if method == "replicate":
        return F.least(F.greatest(i, F.lit(1)), F.lit(n))
    if method == "symmetric":
        r = F.pmod(i - 1, F.lit(2 * n))
        return F.when(r < n, r + 1).otherwise(2 * n - r)
    if method == "mirror":  # at the outermost centres
        r = F.pmod(i - 1, F.lit(max(2 * n - 2, 1)))
        return F.when(r < n, r + 1).otherwise(2 * n - 1 - r)
    if method == "constant":
        return F.when(i.between(1, n), i)
    raise ValueError(f"unknown padding {method}")


def pad(img: DataFrame, dim, size, method="constant", value: float = 0.0, direction: str = "both", axes=AXES) -> DataFrame:
    """Padded image, indices from 1 again. Missing or negative sizes: 0."""
    size = [max(0, s) for s in (*size, *[0] * (len(dim) - len(size)))]
    pre = [s if direction in ("pre", "both") else 0 for s in size]
    post = [s if direction in ("post", "both") else 0 for s in size]
    out = lattice(img.sparkSession, [n + a + b for n, a, b in zip(dim, pre, post)])
    take = out.withColumns({f"s{a}": source_index(F.col(a) - p, n, method).cast("int") for a, n, p in zip(axes, dim, pre)})
    src = img.select(*(F.col(a).alias(f"s{a}") for a in axes), "v")
    return take.join(src, [f"s{a}" for a in axes], "left").select(*axes, F.coalesce("v", F.lit(float(value))).alias("v"))


# warps -------------------------------------------------------------------------------------------
def affine_columns(A, x: list[Column]) -> list[Column]:
    A = np.asarray(A, float)
    return [sum((F.lit(float(A[r, c])) * x[c] for c in range(len(x))), F.lit(float(A[r, len(x)]))) for r in range(len(x))]


def identity_warp(spark, dim, vs=(1.0, 1.0, 1.0)) -> DataFrame:
    return affine_warp(spark, np.eye(4), dim, vs)


def translation_warp(spark, t, dim, vs=(1.0, 1.0, 1.0)) -> DataFrame:
    A = np.eye(4)
    A[:3, 3] = t
    return affine_warp(spark, A, dim, vs)


def linear_warp(spark, L, dim, vs=(1.0, 1.0, 1.0)) -> DataFrame:
    A = np.eye(4)
    A[:3, :3] = L
    return affine_warp(spark, A, dim, vs)


def affine_warp(spark, A, dim, vs=(1.0, 1.0, 1.0)) -> DataFrame:
    """(i, j, k, y1, y2, y3): the affine of the voxel's place in mm."""
    y = affine_columns(A, [F.col(a) * F.lit(float(s)) for a, s in zip(AXES, vs)])
    return lattice(spark, dim).select(*AXES, *(c.alias(f"y{n + 1}") for n, c in enumerate(y)))


def transform_warp(warp: DataFrame, A) -> DataFrame:
    y = affine_columns(A, [F.col(f"y{n}") for n in (1, 2, 3)])
    return warp.select(*AXES, *(c.alias(f"y{n + 1}") for n, c in enumerate(y)))


def mm_to_voxel(warp: DataFrame, vs) -> DataFrame:
    return warp.withColumns({f"y{n + 1}": F.col(f"y{n + 1}") / F.lit(float(s)) for n, s in enumerate(vs)})


def sample(img: DataFrame, warp: DataFrame, dim, values=("v",), degree: int = 1, bnd: str = "circular") -> DataFrame:
    """img's values at the warp's places (in voxels) by splines of degree 0 (nearest), 1 (trilinear) to 7."""
    return splines.sample(img, warp, dim, values, degree, bnd)


def compose(*chain, dim=None, vs=(1.0, 1.0, 1.0), degree: int = 1, bnd: str = "circular") -> DataFrame:
    """The chain's transforms one after another, the last one first: (i, j, k, y1, y2, y3).

    A link is a 4 x 4 affine or a warp; a warp may come with its own lattice and voxel size, as (warp,
    dim, vs). Warps give places in mm. Affines in a row are multiplied first, so a chain costs one
    sampling for each warp but the last: its displacement is sampled where the later links point, with
    the given boundary, and added. The last link is a warp, and its lattice that of the result.
    """
    links = [c if isinstance(c, tuple) else (c, dim, vs) for c in chain]
    if not links or not isinstance(links[-1][0], DataFrame):
        raise ValueError("the last link gives the lattice: it must be a warp")
    out, affine = links[-1][0], np.eye(4)
    flush = lambda w: w if (affine == np.eye(4)).all() else transform_warp(w, affine)
    for link, own_dim, own_vs in reversed(links[:-1]):
        if not isinstance(link, DataFrame):
            affine = np.asarray(link, float) @ affine
            continue
        if own_dim is None:
            raise ValueError("the lattice of a warp that is sampled must be given")
        out, affine = flush(out), np.eye(4)
        moved = link.select(*AXES, *((F.col(f"y{n + 1}") - F.col(a) * F.lit(float(s))).alias(f"u{n + 1}") for n, (a, s) in enumerate(zip(AXES, own_vs))))
        # the places ride along, so the sampled displacement need not be joined back
        places = mm_to_voxel(out.withColumns({f"x{n}": F.col(f"y{n}") for n in (1, 2, 3)}), own_vs)
        got = splines.sample(moved, places, own_dim, ("u1", "u2", "u3"), degree, bnd, keep=(*AXES, "x1", "x2", "x3"))
        out = got.select(*AXES, *((F.col(f"x{n}") + F.col(f"u{n}")).alias(f"y{n}") for n in (1, 2, 3)))
    return flush(out)


# headers and boxes ---------------------------------------------------------------------------------
def voxel_size(M) -> np.ndarray:
    return np.linalg.norm(np.asarray(M, float)[:3, :3], axis=0)


def world_box(M, dim) -> np.ndarray:
    """2 x 3: least and greatest world coordinates of the eight corners."""
    c = np.array([[*x, 1] for x in itertools.product(*((1, n) for n in dim))], float)
    w = (np.asarray(M, float) @ c.T)[:3].T
    return np.stack([w.min(0), w.max(0)])


def union_boxes(boxes) -> np.ndarray:
    b = np.asarray(boxes, float)
    return np.stack([b[:, 0].min(0), b[:, 1].max(0)])


def threshold_box(img: DataFrame, M, mode="fv", threshold: float = 0.0) -> DataFrame:
    """One row (lo1..3, hi1..3): world box of voxels that are not null ('nn'), not zero ('nz') or over the threshold."""
    keep = {"fv": F.lit(True), "nn": F.col("v").isNotNull(), "nz": F.col("v") != 0}.get(mode, F.col("v") > threshold)
    x = affine_columns(M, [F.col(a) for a in AXES])
    w = img.where(keep).select(*(c.alias(f"x{n + 1}") for n, c in enumerate(x)))
    return w.agg(*(F.min(f"x{n}").alias(f"lo{n}") for n in (1, 2, 3)), *(F.max(f"x{n}").alias(f"hi{n}") for n in (1, 2, 3)))


def crop(img: DataFrame, M, box) -> tuple[DataFrame, np.ndarray]:
    """(image, affine) of the voxel box [[i0, i1], [j0, j1], [k0, k1]]."""
    box = np.sort(np.round(np.asarray(box, float)), axis=1).astype(int)
    inside = F.lit(True)
    for a, (lo, hi) in zip(AXES, box):
        inside = inside & F.col(a).between(int(lo), int(hi))
    shift = np.eye(4)
    shift[:3, 3] = box[:, 0] - 1
    out = img.where(inside).select(*((F.col(a) - int(lo) + 1).alias(a) for a, (lo, _) in zip(AXES, box)), "v")
    return out, np.asarray(M, float) @ shift


def world_to_voxel_box(M, world) -> np.ndarray:
    c = np.array([[*x, 1] for x in itertools.product(*zip(*world))], float)
    v = (np.linalg.inv(np.asarray(M, float)) @ c.T)[:3]
    return np.stack([v.min(1), v.max(1)], 1)


def crop_to_union(images: list[tuple[DataFrame, np.ndarray, tuple]], boxes) -> list[tuple[DataFrame, np.ndarray]]:
    union = union_boxes(boxes)
    out = []
    for img, M, dim in images:
        box = np.clip(world_to_voxel_box(M, union), 1, np.array(dim)[:, None])
        out.append(crop(img, M, box))
    return out


def mask_field_of_view(img: DataFrame, M_ref, M_source, dim_source) -> DataFrame:
    """0 where the voxel lies outside the source image."""
    x = affine_columns(np.linalg.solve(np.asarray(M_source, float), np.asarray(M_ref, float)), [F.col(a) for a in AXES])
    inside = F.lit(True)
    for c, n in zip(x, dim_source):
        inside = inside & (c >= 1) & (c <= n)
    return img.withColumn("v", F.when(inside, F.col("v")).otherwise(0.0))


def reset_origin(M, dim) -> np.ndarray:
    """Centre-origin affine of the same voxel sizes; the first axis flips where the determinant was negative."""
    vs = voxel_size(M)
    out = np.diag([*vs, 1.0])
    if np.linalg.det(np.asarray(M, float)[:3, :3]) < 0:
        out[0, 0] *= -1
    out[:3, 3] = -out[:3, :3] @ ((np.array(dim) + 1) / 2)
    return out


def resize(img: DataFrame, M, dim, vx, box=None, degree: int = 1) -> tuple[DataFrame, np.ndarray, tuple]:
    """(image, affine, dims) resampled to voxels of vx mm over a world box (its own by default)."""
    M = np.asarray(M, float)
    box = world_box(M, dim) if box is None else np.asarray(box, float)
    vx = np.where(np.isnan(np.asarray(vx, float)), voxel_size(M), vx)
    new = tuple(int(x) for x in np.ceil((box[1] - box[0]) / vx + 1 - 1e-9))
    out = np.diag([*vx, 1.0])
    out[:3, 3] = box[0] - vx
    warp = affine_warp(img.sparkSession, np.linalg.solve(M, out), new)
    return sample(img, warp, dim, degree=degree, bnd="constant"), out, new


def downsample(img: DataFrame, M, dim, axes=(0, 1), least: float = 1.0):
    """Nearest-neighbour resampling of some axes to at least so many mm."""
    vs = voxel_size(M)
    factor = np.array([max(1.0, least / v) if a in axes else 1.0 for a, v in enumerate(vs)])
    new = tuple(int(x) for x in np.maximum(1, np.floor(np.array(dim) / factor)))
    T = np.diag([*factor, 1.0])
    T[:3, 3] = 0.5 - factor * 0.5  # centres of blocks
    T[:3, 3] += 0.0
    return sample(img, affine_warp(img.sparkSession, T, new), dim, degree=0, bnd="replicate"), np.asarray(M, float) @ T, new


def reslice(images: list[tuple[DataFrame, np.ndarray, tuple]], ref: int | None = None, degree: int = 1) -> list[DataFrame]:
    """All images on the grid of the one with the largest field of view (or a given one), 0 outside their own."""
    volume = [float(np.prod(voxel_size(M) * np.asarray(dim))) for _, M, dim in images]
    r = int(np.argmax(volume)) if ref is None else ref
    img, M_ref, dim_ref = images[r]
    out = []
    for n, (own, M, dim) in enumerate(images):
        if n == r:
            out.append(own)
            continue
        warp = affine_warp(own.sparkSession, np.linalg.solve(np.asarray(M, float), np.asarray(M_ref, float)), dim_ref)
        out.append(mask_field_of_view(sample(own, warp, dim, degree=degree, bnd="replicate"), M_ref, M, dim))
    return out


def reference_image(headers: DataFrame, rule: str = "smallest_voxel") -> DataFrame:
    """The one row of (name, vx1..3, d1..3) with the smallest voxel volume or the largest field of view."""
    voxel = F.col("vx1") * F.col("vx2") * F.col("vx3")
    key = voxel.asc() if rule == "smallest_voxel" else (voxel * F.col("d1") * F.col("d2") * F.col("d3")).desc()
    return headers.orderBy(key, "name").limit(1)


def central_slice(img: DataFrame, dim, axis: str = "k") -> DataFrame:
    """The slice at floor(d / 2) + 1, its plane as (i, j)."""
    plane = [a for a in AXES if a != axis]
    return img.where(F.col(axis) == dim[AXES.index(axis)] // 2 + 1).select(F.col(plane[0]).alias("i"), F.col(plane[1]).alias("j"), F.lit(1).alias("k"), "v")


def linspace_vec(x1, x2, n: int) -> np.ndarray:
    return np.linspace(np.asarray(x1, float), np.asarray(x2, float), n, axis=-1)


def affine_basis(kind: str = "affine", flat: bool = False) -> np.ndarray:
    """Generators of the translation, rotation, rigid, similitude or affine algebra, 4 x 4 each."""
    e = lambda r, c: np.eye(1, 16, 4 * r + c).reshape(4, 4)
    d = 2 if flat else 3
    shifts = [e(a, 3) for a in range(d)]
    turns = [e(0, 1) - e(1, 0)] if flat else [e(0, 1) - e(1, 0), e(0, 2) - e(2, 0), e(1, 2) - e(2, 1)]
    zoom = [sum(e(a, a) for a in range(d))]
    zooms = [e(a, a) for a in range(d)]
    shears = [e(a, b) + e(b, a) for a in range(d) for b in range(a + 1, d)]
    return np.array({"translation": shifts, "rotation": turns, "rigid": shifts + turns, "similitude": shifts + turns + zoom, "affine": shifts + turns + zooms + shears}[kind])


def regularised(kind: str = "affine", flat: bool = False) -> list[int]:
    """Which generators of ``affine_basis`` (from 0) are neither shifts nor turns."""
    rigid = len(affine_basis("rigid", flat))
    return list(range(rigid, len(affine_basis(kind, flat)))) if kind in ("similitude", "affine") else []


# headers as a table ------------------------------------------------------------------------------------
def expm(a: np.ndarray) -> np.ndarray:
    """Exponential of a small matrix, by squaring a series."""
    halvings = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-300)))) + 4)
    x, term, out = a / 2**halvings, np.eye(len(a)), np.eye(len(a))
    for n in range(1, 14):
        term = term @ x / n
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


def logm(a: np.ndarray) -> np.ndarray:
    """Principal logarithm of a small matrix without eigenvalues on the negative axis, by square roots and a series."""
    eye, roots = np.eye(len(a)), 0
    while np.abs(a - eye).max() > 0.05 and roots < 60:
        y, z = a, eye
        for _ in range(50):  # both converge, to the root and to its inverse
            y, z, old = (y + np.linalg.inv(z)) / 2, (z + np.linalg.inv(y)) / 2, y
            if np.abs(y - old).max() <= 1e-15 * np.abs(y).max():
                break
        a, roots = y, roots + 1
    x = np.linalg.solve(a + eye, a - eye)
    out, term = np.zeros_like(x), x
    for n in range(1, 40, 2):
        out = out + 2 * term / n
        term = term @ x @ x
    return out * 2**roots


def to_axial(M, dim) -> tuple[np.ndarray, tuple]:
    """(affine, dims) with axes permuted and flipped so that its rotation is as near to none as can be."""
    M, dim = np.asarray(M, float), np.asarray(dim, float)
    turn = M[:3, :3] / voxel_size(M)
    ways = [np.diag(f) @ np.eye(3)[list(p)] for p in itertools.permutations(range(3)) for f in itertools.product((-1.0, 1.0), repeat=3)]
    best = min(ways, key=lambda w: ((turn @ w.T - np.eye(3)) ** 2).sum())  # its inverse is its transpose
    new, back = np.abs(best @ dim), np.eye(4)
    back[:3, :3] = best.T
    back[:3, 3] = best.T @ ((best.T.sum(0) - 1) / 2 * (new + 1))  # a flipped axis counts from its other end
    return M @ back, tuple(int(n) for n in new)


def without_shear(M) -> np.ndarray:
    """The nearest product of a rigid motion and zooms, by Gauss-Newton; M itself if it has no shear."""
    M = np.asarray(M, float)
    gram = M[:3, :3].T @ M[:3, :3]
    zooms = np.sqrt(np.diag(gram))
    if np.abs(gram / np.outer(zooms, zooms) - np.eye(3)).max() < 1e-8:
        return M
    u, _, vt = np.linalg.svd(M[:3, :3] / zooms)
    rigid = np.eye(4)
    rigid[:3, :3], rigid[:3, 3] = u @ vt, M[:3, 3]
    basis, log_zoom = affine_basis("rigid"), np.log(zooms)
    for _ in range(1000):
        zoom = np.diag([*np.exp(log_zoom), 1.0])
        now = rigid @ zoom
        ways = [(rigid @ b @ zoom).ravel() for b in basis] + [(now @ np.diag(np.eye(4)[a])).ravel() for a in range(3)]
        J = np.array(ways).T
        gap = (now - M).ravel()
        step = np.linalg.lstsq(J, gap, rcond=None)[0]
        rigid, log_zoom = rigid @ expm(-np.tensordot(step[:6], basis, 1)), log_zoom - step[6:]
        if ((J.T @ gap) ** 2).sum() < 1e-20:
            break
    return rigid @ np.diag([*np.exp(log_zoom), 1.0])


def _folded_headers(headers: DataFrame, of_one, fold) -> np.ndarray | None:
    """fold of of_one(affine, dims) over a header table (mat: 16 numbers by row, dim): one row a task reaches the driver."""

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            for m, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.asarray(of_one(np.array(m).reshape(4, 4), d), float)
                total = got if total is None else fold(total, got)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    out = None
    for row in headers.select("mat", "dim").mapInArrow(run, "s binary").toLocalIterator():
        got = np.frombuffer(row[0])
        out = got if out is None else fold(out, got)
    return out


def header_geometry(headers: DataFrame) -> DataFrame:
    """headers (mat: 16 numbers by row, dim: 3) with vs, lo, hi and origin: voxel sizes, the world box, and where ``reset_origin`` puts the first voxel's neighbour."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(np.array(m).reshape(4, 4), d) for m, d in zip(batch.column("mat").to_pylist(), batch.column("dim").to_pylist())]
            made = [[voxel_size(m) for m, _ in rows], [world_box(m, d)[0] for m, d in rows], [world_box(m, d)[1] for m, d in rows], [reset_origin(m, d)[:3, 3] for m, d in rows]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x.tolist() for x in c], pa.list_(pa.float64())) for c in made)], names=[*batch.schema.names, "vs", "lo", "hi", "origin"])

    triple = lambda n: StructField(n, ArrayType(DoubleType()))
    return headers.mapInArrow(run, StructType([*headers.schema.fields, *map(triple, ("vs", "lo", "hi", "origin"))]))


def average_header(headers: DataFrame, rounds: int = 100) -> tuple[np.ndarray, tuple]:
    """(affine, dims) of an average image over a header table (mat: 16 numbers by row, dim: 3).

    Headers are brought to axial, averaged by the mean of their logarithms about the average (a pass a
    round, until that mean is 0), stripped of shear, and the grid is set to the box of all images in the
    average's voxels, without a twentieth at its upper ends and at the lower ones of the first two axes.
    Flat images keep one slice.
    """
    return _average(lambda of_one, fold: _folded_headers(headers, of_one, fold), rounds)


def average_affine(mats, dims) -> tuple[np.ndarray, tuple]:
    """``average_header`` of a few headers that are at hand."""
    return _average(lambda of_one, fold: functools.reduce(fold, (np.asarray(of_one(np.asarray(m, float), d), float) for m, d in zip(mats, dims))), 100)


def _average(over, rounds: int) -> tuple[np.ndarray, tuple]:
    first = over(lambda m, d: [1.0, *to_axial(m, d)[0].ravel(), float(d[2] > 1)], np.add)
    if first is None:
        raise ValueError("no headers")
    count, mean = first[0], first[1:17].reshape(4, 4) / first[0]
    for _ in range(rounds):
        inverse = np.linalg.inv(mean)
        off = over(lambda m, d, i=inverse: logm(i @ to_axial(m, d)[0]).ravel(), np.add).reshape(4, 4) / count
        mean = mean @ expm(off)
        if (off**2).sum() < 1e-20:
            break
    mean = without_shear(mean)
    inverse = np.linalg.inv(mean)

    def corners(m, d):
        c = np.array([[*x, 1] for x in itertools.product(*((1, n) for n in d))], float)
        v = (inverse @ m @ c.T)[:3]
        return np.concatenate([v.min(1), -v.max(1)])

    box = over(corners, np.minimum)
    low, high = box[:3], -box[3:]
    near = lambda x: np.where(np.abs(x - np.round(x)) < 1e-9, np.round(x), x)
    high = np.ceil(near(high - (high - low) * 0.05))
    low = np.floor(near(low + (high - low) * np.array([0.05, 0.05, 0.0])))
    dim = high - low + 1
    if first[17] == 0:
        low[2], dim[2] = 1, 1
    shift = np.eye(4)
    shift[:3, 3] = low - 1
    return mean @ shift, tuple(int(n) for n in dim)


def reorient(img: DataFrame, M, dim, vx=1.0, degree: int = 4) -> tuple[DataFrame, np.ndarray, tuple]:
    """(image, affine, dims) in transverse orientation with voxels of vx mm: the grid begins at the least corner, to whole mm, and reaches the largest."""
    M, vx = np.asarray(M, float), np.broadcast_to(np.asarray(vx, float), (3,))
    whole = lambda x: np.sign(x) * np.floor(np.abs(x) + 0.5)
    low, high = whole(world_box(M, dim))
    out = np.diag([*vx, 1.0])
    out[:3, 3] = low - vx
    new = tuple(int(n) for n in np.ceil((high - out[:3, 3]) / vx - 1e-9))
    warp = affine_warp(img.sparkSession, np.linalg.solve(M, out), new)
    return sample(img, warp, dim, degree=degree, bnd="constant"), out, new
