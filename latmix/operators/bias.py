"""Smooth multiplicative bias fields: bases, regularisers, Gauss-Newton, and the alternating fit.

A field is a product of one basis a dimension: coefficients are contracted with the basis rows of a
batch's voxels one dimension at a time, and sums over voxels the other way round, so neither holds a
row of all coefficients for every voxel. A pass over the image is one job whose tasks send sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field as default

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import gmm

#: Unknowns of all channels up to which they are solved for at once. Fixed value.
JOINT = 3000
#: Unknowns up to which the Hessian is summed up; beyond, conjugate gradients ask for products with it.
DENSE = 600
BOUNDARIES = ("neumann", "circulant", "dirichlet")


def components(lat, vs, fwhm) -> list[int]:
    """Number of bases by dimension for a field no rougher than fwhm (mm)."""
    return [max(1, math.ceil(2 * v * n / f)) for n, v, f in zip(lat, vs, np.broadcast_to(fwhm, (len(lat),)))]


def component_count(side, vs, fwhm: float):
    """``components`` of columns: one axis of a header table."""
    return F.greatest(F.lit(1), F.ceil(2 * vs * side / F.lit(float(fwhm)))).cast("int")


def lattice_of(img: DataFrame, axes=("i", "j", "k")) -> tuple[list[str], tuple]:
    """(channels, sides) of an image table: every other column is a channel, a side is the largest index; trailing axes that are missing are left out."""
    have = [a for a in axes if a in img.columns]
    top = img.agg(*(F.max(a) for a in have)).head()
    return [c for c in img.columns if c not in axes], tuple(int(n or 0) for n in top)


# bases and energies -----------------------------------------------------------------------------------
def dct_basis(n: int, k: int) -> np.ndarray:
    """n x k orthonormal cosines."""
    x = np.arange(n)[:, None]
    b = np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * np.arange(k) / (2 * n))
    b[:, 0] = 1 / math.sqrt(n)
    return b


def dft_basis(n: int, k: int) -> np.ndarray:
    return np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(k)) / n) / math.sqrt(n)


def dst_basis(n: int, k: int) -> np.ndarray:
    """n x k orthonormal sines, 0 one voxel outside."""
    return math.sqrt(2 / (n + 1)) * np.sin(np.pi * np.outer(np.arange(1, n + 1), np.arange(1, k + 1)) / (n + 1))


def derivative_bases(n: int, k: int, v: float, bnd: str) -> list[np.ndarray]:
    """The basis of a boundary, its first and its second derivative at the voxels (per mm)."""
    if bnd == "circulant":
        w = 2 * np.pi * np.arange(k) / (n * v)
        return [dft_basis(n, k) * (-1j * w) ** p for p in range(3)]
    if bnd == "dirichlet":
        w = np.pi * np.arange(1, k + 1) / ((n + 1) * v)
        cos = math.sqrt(2 / (n + 1)) * np.cos(np.pi * np.outer(np.arange(1, n + 1), np.arange(1, k + 1)) / (n + 1))
        return [dst_basis(n, k), cos * w, -dst_basis(n, k) * w**2]
    if bnd != "neumann":
        raise ValueError(f"unknown boundary {bnd}")
    w = np.pi * np.arange(k) / (n * v)
    sin = math.sqrt(2 / n) * np.sin(np.pi * (2 * np.arange(n)[:, None] + 1) * np.arange(k) / (2 * n))
    return [dct_basis(n, k), -sin * w, -dct_basis(n, k) * w**2]


@dataclass
class Energy:
    """A quadratic form of coefficients: a sum of products over dimensions of small matrices.

    terms: (component, component, factor, one matrix a dimension). Coefficients are arrays of
    nb[0] x nb[1] ... x components; flat ones have the first dimension fastest.
    """

    nb: tuple
    count: int
    terms: list = default(default_factory=list)

    def apply(self, c: np.ndarray) -> np.ndarray:
        out = np.zeros(c.shape, np.result_type(c, *(m for t in self.terms for m in t[3]))) if self.terms else np.zeros(c.shape)
        for a, b, by, ms in self.terms:
            x = c[..., b]
            for d, m in enumerate(ms):
                x = np.moveaxis(np.tensordot(m, x, (1, d)), 0, d)
            out[..., a] += by * x
        return out

    def value(self, c: np.ndarray) -> float:
        return float(np.vdot(c, self.apply(c)).real)

    def dense(self) -> np.ndarray:
        n = math.prod(self.nb)
        out = np.zeros((self.count, n, self.count, n), complex)
        for a, b, by, ms in self.terms:
            k = np.ones((1, 1))
            for m in ms:
                k = np.kron(m, k)
            out[a, :, b] += by * k
        out = out.reshape(self.count * n, self.count * n)
        return out if np.abs(out.imag).max(initial=0) > 1e-12 * max(np.abs(out).max(initial=0), 1e-300) else out.real

    def diagonal(self) -> np.ndarray:
        out = np.zeros((*self.nb, self.count))
        for a, b, by, ms in self.terms:
            if a == b:
                x = np.array(by)
                for m in ms:
                    x = np.multiply.outer(x, np.diagonal(m).real)
                out[..., a] += x
        return out


def energy(lat, nb, vs, absolute=0.0, membrane=0.0, bending=0.0, elastic1=0.0, elastic2=0.0, bnd: str = "neumann") -> Energy:
    """Energies of a field in coefficients of a boundary's basis, summed over voxels.

    absolute |f|^2, membrane |grad f|^2, bending the squares of all second derivatives. The elastic
    terms make it a field of vectors, a component a dimension: elastic1 |(J + J') / 2|^2, elastic2
    div^2 / 2; the others then hold for every component.
    """
    d = len(lat)
    bases = [derivative_bases(n, k, v, bnd) for n, k, v in zip(lat, nb, vs)]
    gram = [[[p.conj().T @ q for q in b] for p in b] for b in bases]
    vector = bool(elastic1 or elastic2)
    out = Energy(tuple(nb), d if vector else 1)

    def term(a, b, by, left=(), right=()):
        """The product of the derivatives along ``left`` of one component and along ``right`` of another."""
        if by:
            out.terms.append((a, b, by, [gram[i][left.count(i)][right.count(i)] for i in range(d)]))

    for c in range(out.count):
        term(c, c, absolute)
        for i in range(d):
            term(c, c, membrane, (i,), (i,))
            for j in range(d):
                term(c, c, bending, (i, j), (i, j))
    if vector:
        for a in range(d):
            for b in range(d):
                term(a, a, elastic1 / 2, (b,), (b,))
                term(a, b, elastic1 / 2, (b,), (a,))
                term(a, b, elastic2 / 2, (a,), (b,))
    return out


def regulariser(lat, nb, vs, absolute=0.0, membrane=0.0, bending=1.0, elastic1=0.0, elastic2=0.0) -> np.ndarray:
    """Energy of a scalar field in cosine coefficients (diagonal there), the first dimension fastest."""
    freq = [(np.pi * np.arange(k) / (n * v)) ** 2 for n, k, v in zip(lat, nb, vs)]
    grids = np.meshgrid(*freq, indexing="ij")
    total = sum(grids)
    energy = absolute + (membrane + 2 * elastic1 + elastic2) * total + bending * total**2
    return np.diag(energy.ravel(order="F") * np.prod(vs))


def design(lat, nb) -> list[np.ndarray]:
    return [dct_basis(n, k) for n, k in zip(lat, nb)]


# contraction ---------------------------------------------------------------------------------------------
class Contraction:
    """Basis rows of given voxels (indices from 1): fields from coefficients, and sums from values at voxels."""

    def __init__(self, bases: list[np.ndarray], index: list[np.ndarray]):
        self.bases, self.index, self.levels = bases, index, []
        parent = np.zeros(len(index[0]), np.int64)
        for d in range(len(bases) - 1, 0, -1):  # voxels of one slice, then of one line, are one group
            side = len(bases[d])
            groups, own = np.unique(parent * side + index[d] - 1, return_inverse=True)
            self.levels.append((groups // side, bases[d][groups % side]))
            parent = own
        self.levels.append((parent, bases[0][index[0] - 1]))

    def rows(self) -> list[np.ndarray]:
        return [b[x - 1] for b, x in zip(self.bases, self.index)]

    def forward(self, c: np.ndarray) -> np.ndarray:
        """voxels x fields, of coefficients nb[0] x ... x fields."""
        t = c[None]
        for parent, rows in self.levels:
            t = np.einsum("g...af,ga->g...f", t[parent], rows)
        return t

    def adjoint(self, r: np.ndarray) -> np.ndarray:
        """nb[0] x ... x fields: values at voxels (voxels x fields), times the bases, summed."""
        t = r
        for n, (parent, rows) in enumerate(reversed(self.levels)):
            groups = 1 if n == len(self.levels) - 1 else len(self.levels[-2 - n][0])
            each = rows.reshape(len(rows), *[1] * (t.ndim - 2), rows.shape[1], 1) * t[..., None, :]
            order = np.argsort(parent, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(parent[order]) != 0))
            t = np.zeros((groups, *each.shape[1:]))
            t[parent[order][starts]] = np.add.reduceat(each[order], starts, axis=0)
        return t[0]


def _columns(batch, names) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1) if names else np.zeros((batch.num_rows, 0))


def _shaped(coeff, bases) -> np.ndarray:
    return np.asarray(coeff, float).reshape([b.shape[1] for b in bases], order="F")


def fields(img: DataFrame, bases: list[np.ndarray], coeff: dict, mode: str = "mult", axes=("i", "j", "k")) -> DataFrame:
    """img with the fields of its voxels, one column for each name of coeff: their exponentials if 'mult'."""
    c, names = np.stack([_shaped(v, bases) for v in coeff.values()], -1), list(coeff)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                at = Contraction(bases, [batch.column(a).to_numpy() for a in axes[: len(bases)]])
                f = at.forward(c)
                f = np.exp(f) if mode == "mult" else f
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f[:, k]) for k in range(len(names)))], names=[*batch.schema.names, *names])

    return img.mapInArrow(run, StructType([*img.schema.fields, *(StructField(n, DoubleType()) for n in names)]))


def reconstruct(img: DataFrame, bases: list[np.ndarray], coeff, mode: str = "mult", name: str = "bias", axes=("i", "j", "k")) -> DataFrame:
    """img with the field at its voxels: separable bases times coefficients, its exponential if 'mult'."""
    if coeff is None or not np.size(coeff):
        return img.withColumn(name, F.lit(1.0 if mode == "mult" else 0.0))
    return fields(img, bases, {name: coeff}, mode, axes)


# derivatives and objective ---------------------------------------------------------------------------------
def voxel_terms(x: np.ndarray, z: np.ndarray, model: gmm.Mixture, variance=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, Hessian, log-likelihood) of each voxel, by channel: of minus the log-likelihood plus
    log-field, towards the logarithm of the field.

    x: corrected channels, NaN where missing. z: responsibilities. variance: of binned values, by voxel
    and channel. A pattern of gaps has the precision that its observed channels are left with; a missing
    channel has no derivatives. Gauss-Newton: products of first derivatives only.
    """
    n, p = x.shape
    g, h, ll = np.zeros((n, p)), np.zeros((n, p, p)), np.zeros(n)
    code = (~np.isnan(x)) @ (1 << np.arange(p))
    for c in np.unique(code[code > 0]):
        rows = np.flatnonzero(code == c)
        _, _, o = gmm.pattern_terms(model, int(c), 0)
        cells = np.ix_(rows, o)
        y, extra = x[cells], np.zeros((len(rows), len(o))) if variance is None else variance[cells]
        own_g, own_h = np.zeros((len(rows), len(o))), np.zeros((len(rows), len(o), len(o)))
        for k in range(z.shape[1]):
            A, const, _ = gmm.pattern_terms(model, int(c), k)
            w, diagonal = z[rows, k], np.diagonal(A)
            pull = (y - model.mu[k, o]) @ A
            own_g += w[:, None] * (y * pull + diagonal * extra)
            own_h += w[:, None, None] * (A * y[:, :, None] * y[:, None, :])
            own_h[:, range(len(o)), range(len(o))] += w[:, None] * diagonal * extra
            ll[rows] += w * (const + y @ (A @ model.mu[k, o]) - 0.5 * ((y @ A) * y).sum(1) - 0.5 * extra @ diagonal)
        g[cells] = own_g - 1
        h[np.ix_(rows, o, o)] = own_h
    return g, h, ll


def _sums(obs: DataFrame, cols, z, model, bases, coeff: dict, axes, bin_width, of_batch, size: int) -> np.ndarray:
    """The sum over batches of what of_batch makes of (contraction, corrected channels, fields, responsibilities, variance)."""
    c = np.stack([_shaped(coeff[q], bases) for q in cols], -1)
    width = None if bin_width is None else np.broadcast_to(np.asarray(bin_width, float), (len(cols),))

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                at = Contraction(bases, [batch.column(a).to_numpy() for a in axes])
                x, r = _columns(batch, cols), _columns(batch, z)
                f = np.where(np.isnan(x), 0.0, at.forward(c))
                b = np.exp(f)
                total += of_batch(at, x * b, f, r, None if width is None else (width * b) ** 2 / 12)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    out = np.zeros(size)
    for row in obs.select(*axes, *cols, *z).mapInArrow(run, "s binary").toLocalIterator():
        out += np.frombuffer(row[0])
    return out


def conditional(obs: DataFrame, cols, z, model, bases, coeff: dict, axes=("i", "j", "k"), bin_width=None) -> tuple[float, float]:
    """(log-likelihood of the corrected channels under given responsibilities, sum of the log-fields of what is observed)."""

    def of_batch(at, x, f, r, variance):
        return np.array([voxel_terms(x, r, model, variance)[2].sum(), f.sum()])

    lx, lb = _sums(obs, cols, z, model, bases, coeff, axes[: len(bases)], bin_width, of_batch, 2)
    return float(lx), float(lb)


def derivatives(obs: DataFrame, cols, z, model, bases, coeff: dict, channels=None, axes=("i", "j", "k"), bin_width=None, hessian: bool = True):
    """(gradient, Hessian) of minus ``conditional``'s sum in the coefficients of the channels (all by default).

    The gradient is nb... x channels; the Hessian, of all channels' flat coefficients one after the
    other, holds the blocks between channels too (None without ``hessian``).
    """
    pick = [cols.index(c) for c in (channels or cols)]
    nb, q = [b.shape[1] for b in bases], len(pick)
    n = math.prod(nb)

    def of_batch(at, x, f, r, variance):
        g, h, _ = voxel_terms(x, r, model, variance)
        parts = [at.adjoint(g[:, pick]).ravel(order="F")]
        if hessian:
            phi = None
            for rows in at.rows():
                phi = rows if phi is None else (rows[:, :, None] * phi[:, None, :]).reshape(len(phi), -1)  # the first dimension fastest
            block = np.zeros((q, n, q, n))
            for a in range(q):
                for b in range(a, q):
                    block[a, :, b] = phi.T @ (phi * h[:, pick[a], pick[b], None])
                    block[b, :, a] = block[a, :, b].T
            parts.append(block.ravel())
        return np.concatenate(parts)

    got = _sums(obs, cols, z, model, bases, coeff, axes[: len(bases)], bin_width, of_batch, n * q + (n * q) ** 2 * hessian)
    g = got[: n * q].reshape([*nb, q], order="F")
    return g, got[n * q :].reshape(n * q, n * q) if hessian else None


def hessian_product(obs: DataFrame, cols, z, model, bases, coeff: dict, v: np.ndarray, channels=None, axes=("i", "j", "k"), bin_width=None) -> np.ndarray:
    """The Hessian of ``derivatives`` times v (nb... x channels), without the Hessian: a pass over the image."""
    pick = [cols.index(c) for c in (channels or cols)]

    def of_batch(at, x, f, r, variance):
        h = voxel_terms(x, r, model, variance)[1][:, pick][:, :, pick]
        return at.adjoint(np.einsum("nab,nb->na", h, at.forward(v))).ravel(order="F")

    return _sums(obs, cols, z, model, bases, coeff, axes[: len(bases)], bin_width, of_batch, v.size).reshape(v.shape, order="F")


def conjugate_gradients(product, b: np.ndarray, precondition: np.ndarray, rounds: int = 60, tolerance: float = 1e-6) -> np.ndarray:
    x, r = np.zeros_like(b), b.copy()
    s = r / precondition
    p, rs = s.copy(), float((r * s).sum())
    first = rs
    for _ in range(rounds):
        if rs <= tolerance**2 * first:
            break
        ap = product(p)
        step = rs / float((p * ap).sum())
        x, r = x + step * p, r - step * ap
        s = r / precondition
        new = float((r * s).sum())
        p, rs = s + new / rs * p, new
    return x


def newton_step(obs, cols, z, model, bases, coeff, reg: Energy, by: float, channels, axes, bin_width=None) -> np.ndarray:
    """nb... x channels: (Hessian + penalty) \\ (gradient + penalty's), summed up for few unknowns, else by conjugate gradients."""
    n, q = math.prod(reg.nb), len(channels)
    c = np.stack([_shaped(coeff[p], bases) for p in channels], -1)
    penalty = lambda v: by * np.stack([reg.apply(v[..., a, None])[..., 0] for a in range(q)], -1)
    small = n * q <= DENSE
    g, h = derivatives(obs, cols, z, model, bases, coeff, channels, axes, bin_width, hessian=small)
    g = g + penalty(c)
    if small:
        r = by * reg.dense()
        for a in range(q):
            h[a * n : (a + 1) * n, a * n : (a + 1) * n] += r
        load = 1e-10 * np.trace(h) / (n * q)
        return np.linalg.solve((h + h.T) / 2 + load * np.eye(n * q), g.ravel(order="F")).reshape(g.shape, order="F")
    ask = lambda v: hessian_product(obs, cols, z, model, bases, coeff, v, channels, axes, bin_width) + penalty(v)
    # bases are orthonormal, so the mean of the voxels' Hessians is about its diagonal
    flat = np.zeros_like(g)
    flat[(0,) * len(reg.nb)] = 1.0
    data = np.abs((flat * hessian_product(obs, cols, z, model, bases, coeff, flat, channels, axes, bin_width)).sum(tuple(range(len(reg.nb)))))
    return conjugate_gradients(ask, g, by * reg.diagonal() + data + 1e-300)


# fit -----------------------------------------------------------------------------------------------------
def gauss_newton(obs: DataFrame, cols, z, model, bases, coeff: dict, reg: Energy, by: float, joint: bool | None = None, iterations: int = 1024, tolerance: float = 1e-4, line_search: int = 6, axes=("i", "j", "k"), bin_width=None):
    """(coefficients, trace of (log-likelihood, log-field, penalty), whether any step gained) for a given mixture.

    joint: all channels at once, with the Hessian's blocks between them; by default up to JOINT unknowns.
    A step is halved until it gains, line_search times at most.
    """
    axes = axes[: len(bases)]
    n = math.prod(reg.nb)
    joint = n * len(cols) <= JOINT if joint is None else joint

    def value(co):
        lx, lb = conditional(obs, cols, z, model, bases, co, axes, bin_width)
        return lx, lb, -0.5 * by * sum(reg.value(_shaped(co[c], bases)[..., None]) for c in cols)

    trace, any_gain = [value(coeff)], False
    for _ in range(iterations):
        gained = 0.0
        for channels in [cols] if joint else [[c] for c in cols]:
            step = newton_step(obs, cols, z, model, bases, coeff, reg, by, channels, axes, bin_width)
            now, scale = sum(trace[-1]), 1.0
            for _ in range(line_search):
                trial = coeff | {c: np.asarray(coeff[c], float) - scale * step[..., a].ravel(order="F") for a, c in enumerate(channels)}
                got = value(trial)
                if sum(got) > now:
                    coeff, any_gain = trial, True
                    trace.append(got)
                    break
                scale /= 2
            sums = [sum(t) for t in trace]
            gained += (sums[-1] - now) / max(max(sums) - min(sums), 1e-300)
        if gained < tolerance:
            break
    return coeff, trace, any_gain


def fit(img: DataFrame, cols: list[str] | None = None, lat=None, vs=(1.0, 1.0, 1.0), k: int = 3, fwhm: float = 60.0, reg=1e7, iterations: int = 8, line_search: int = 6, tolerance: float = 1e-4, seed: int = 0, joint: bool | None = None, steps: int = 3, bin_width=None, history: list | None = None, **mixture):
    """(coefficients by channel, model, objective trace). Mixture and field in turn.

    reg: the bending energy's weight, or weights one after another: once a weight's gain falls under
    tolerance the next one takes its place (the penalty so far is scaled to it), and the last one ends the
    fit. cols and lat: by default all other columns, and the largest indices. Rows with gaps count by
    their observed channels. steps: of Gauss-Newton in each round. history: gets a row a round: round,
    weight, log-likelihood, log-field, penalty, objective, gain. mixture: options of the mixture's fit.
    """
    found = lattice_of(img)
    cols, lat = cols or found[0], lat or found[1]
    axes = ("i", "j", "k")[: len(lat)]
    nb = components(lat, vs, fwhm)
    bases = design(lat, nb)
    penalty = energy(lat, nb, vs[: len(lat)], bending=float(np.prod(vs[: len(lat)])))
    schedule = [float(x) for x in np.atleast_1d(reg)]
    coeff = {c: np.zeros(math.prod(nb)) for c in cols}
    base = img.select(*axes, *(F.col(c).cast("double").alias(c) for c in cols)).persist()
    log_names = {c: f"lb_{c}" for c in cols}

    def corrected(co):
        out = fields(base, bases, {log_names[c]: co[c] for c in cols}, "add", axes)
        return out.withColumns({c: F.col(c) * F.exp(log_names[c]) for c in cols})

    try:
        model, trace, z = None, [], [f"z_{i}" for i in range(k)]
        weight = schedule.pop(0)
        for turn in range(iterations):
            start = corrected(coeff)
            model = gmm.fit(start, cols, k, iterations=20, seed=seed, **mixture) if model is None else gmm.fit(start, cols, start=model, iterations=3, **mixture)
            scored = gmm.score(start, cols, model).select(*axes, *cols, *log_names.values(), *(F.get("z", F.lit(i)).alias(f"z_{i}") for i in range(k)))
            obs = scored.withColumns({c: F.col(c) * F.exp(-F.col(log_names[c])) for c in cols}).drop(*log_names.values()).persist()
            try:
                coeff, inner, ok = gauss_newton(obs, cols, z, model, bases, coeff, penalty, weight, joint, steps, tolerance, line_search, axes, bin_width)
                evidence = objective(corrected(coeff), cols, model, log_names)
            finally:
                obs.unpersist()
            now = evidence + inner[-1][2]
            gain = (now - trace[-1]) / max(max(*trace, now) - min(*trace, now), 1e-300) if trace else math.inf
            trace.append(now)
            if history is not None:
                history.append({"round": turn, "weight": weight, "log_likelihood": inner[-1][0], "log_field": inner[-1][1], "penalty": inner[-1][2], "objective": now, "gain": gain})
            if not ok:
                break
            if gain < tolerance:
                if not schedule:
                    break
                before, weight = weight, schedule.pop(0)
                trace = [t - inner[-1][2] + inner[-1][2] * weight / before if n == len(trace) - 1 else t for n, t in enumerate(trace)]
        return coeff, model, trace
    finally:
        base.unpersist()


def objective(obs: DataFrame, cols, model: gmm.Mixture, log_fields: dict | str | None = None) -> float:
    """Log-evidence of corrected rows plus the log of the field's Jacobian: of a column, or by channel of what is observed."""
    s = gmm.score(obs, cols, model)
    if isinstance(log_fields, dict):
        extra = sum((F.when(F.col(c).isNotNull(), F.col(b)).otherwise(0.0) for c, b in log_fields.items()), F.lit(0.0))
    else:
        extra = F.col(log_fields) if log_fields else F.lit(0.0)
    return float(s.agg(F.sum(F.col("log_evidence") + extra)).head()[0] or 0.0)
