"""Gaussian mixtures: maximum likelihood or variational, missing channels inferred.

A pass over the rows is one aggregate by missing-channel pattern (2^P rows at most): it yields the
sufficient statistics of every pattern and cluster, and the bound's row terms. All else, completing
the statistics, updating clusters and proportions, the bound, is small linear algebra on the driver.
Equal rows of a task are merged once before the passes and weigh as many. Statistics are summed in
Arrow batches with numpy, one row a task and pattern, by all tasks at once; scoring is a projection
of built-in functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.special import np_digamma, np_mv_digamma, np_mv_lgamma, np_mv_trigamma
from . import kmeans
from .observations import ranges

EPS = float(np.finfo(float).eps)


@dataclass
class Mixture:
    """Model: means K x P, precisions K x P x P (of A, or of V with n), proportions."""

    mu: np.ndarray
    A: np.ndarray
    logpi: np.ndarray
    b: np.ndarray | None = None
    V: np.ndarray | None = None
    n: np.ndarray | None = None
    alpha: np.ndarray | None = None
    bound: list[float] = field(default_factory=list)
    #: What each of the bounds is made of.
    parts: list[dict] = field(default_factory=list)

    @property
    def pi(self) -> np.ndarray:
        if self.alpha is not None:
            return self.alpha / self.alpha.sum()
        e = np.exp(self.logpi - self.logpi.max())
        return e / e.sum()


@dataclass
class Prior:
    """Gauss-Wishart prior of every cluster, and Dirichlet prior of the proportions."""

    mu: np.ndarray
    b: np.ndarray
    V: np.ndarray
    n: np.ndarray
    alpha: np.ndarray | None = None


def make_prior(k: int, p: int, mu=None, b=None, V=None, n=None, alpha=None) -> Prior:
    """Defaults: b a tiny number where the mean has no degrees, n = P where V has none; scalars replicate."""
    mu = np.broadcast_to(np.zeros((k, p)) if mu is None else np.asarray(mu, float), (k, p)).copy()
    b = np.broadcast_to(np.asarray(EPS if b is None else b, float), (k,)).copy()
    V = np.eye(p) if V is None else np.asarray(V, float)
    V = np.broadcast_to(V * np.eye(p) if V.ndim == 0 else V, (k, p, p)).copy()
    n = np.broadcast_to(np.asarray(p if n is None else n, float), (k,)).copy()
    return Prior(mu, b, V, n, None if alpha is None else np.broadcast_to(np.asarray(alpha, float), (k,)).copy())


def dirichlet_logpi(alpha) -> np.ndarray:
    alpha = np.asarray(alpha, float)
    return np.array([np_digamma(a) for a in alpha]) - np_digamma(alpha.sum())


def proportions(values) -> tuple[np.ndarray, np.ndarray | None]:
    """(logpi, alpha): values that don't sum to 1 are Dirichlet parameters."""
    values = np.asarray(values, float)
    if abs(values.sum() - 1) > np.finfo(np.float32).eps:
        return dirichlet_logpi(values), values
    return np.log(np.maximum(values, EPS)), None


# per-pattern constants -----------------------------------------------------------------------------
def split(code: int, p: int) -> tuple[list[int], list[int]]:
    o = [i for i in range(p) if code >> i & 1]
    return o, [i for i in range(p) if not code >> i & 1]


def observed_precision(A: np.ndarray, o, m) -> np.ndarray:
    if not m:
        return A[np.ix_(o, o)]
    return A[np.ix_(o, o)] - A[np.ix_(o, m)] @ np.linalg.solve(A[np.ix_(m, m)], A[np.ix_(m, o)])


def pattern_terms(model: Mixture, code: int, k: int) -> tuple[np.ndarray, float, list[int]]:
    """(expected precision of the observed channels, constant, observed channels) of a pattern and cluster."""
    p = model.mu.shape[1]
    o, m = split(code, p)
    mu = model.mu[k, o]
    if model.V is not None:
        V, n = observed_precision(model.V[k], o, m), model.n[k] - len(m)
        A = n * V
        elog = np_mv_digamma(n / 2, len(o)) + len(o) * math.log(2) + np.linalg.slogdet(V)[1]
    else:
        A = observed_precision(model.A[k], o, m)
        elog = np.linalg.slogdet(A)[1] if o else 0.0
    const = -0.5 * len(o) * math.log(2 * math.pi) + 0.5 * elog - 0.5 * mu @ A @ mu
    if model.b is not None and model.b[k] > 0:
        const -= 0.5 * len(o) / model.b[k]
    return A, const, o


# scoring: a projection -------------------------------------------------------------------------------
def log_density(model: Mixture, cols: list[str], k: int, code: int, variance=None) -> Column:
    A, const, o = pattern_terms(model, code, k)
    out = F.lit(float(const - (0.5 * sum(variance[i] * A[j, j] for j, i in enumerate(o)) if variance is not None else 0.0)))
    mu = model.mu[k, o]
    linear = A @ mu
    for i, ci in enumerate(o):
        x = F.col(cols[ci])
        out = out + x * (F.lit(float(linear[i])) - F.lit(float(0.5 * A[i, i])) * x)
        for j in range(i + 1, len(o)):
            out = out - F.lit(float(A[i, j])) * x * F.col(cols[o[j]])
    return out


#: Channels up to which every pattern of gaps has its expression; with more, those that occur are looked up.
ALL_CODES = 4


def code_of(cols: list[str]) -> Column:
    return sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))


def observed_codes(df: DataFrame, cols: list[str]) -> list[int]:
    """The patterns that expressions are built for: all of few channels, else those that occur (a pass; all on a stream)."""
    if len(cols) <= ALL_CODES or df.isStreaming:
        return list(range(1 << len(cols)))
    return sorted(r[0] for r in df.select(code_of(cols).alias("code")).distinct().collect())


def score(df: DataFrame, cols: list[str], model: Mixture, missing: bool = True, variance=None, label_logs: list[str] | None = None, log_mg=None, row_logpi: list[str] | None = None, name: str = "z", codes: list[int] | None = None) -> DataFrame:
    """df with ``name``: array of responsibilities, and ``log_evidence``. A projection; streams too.

    codes: the patterns of gaps that occur (looked up by default). A row with nothing observed gets the proportions. missing False: rows with a null get nulls.
    label_logs: columns added to the clusters' log-probabilities; row_logpi: columns in place of the
    model's proportions; log_mg: weights of clusters within their class.
    """
    p, k = len(cols), len(model.mu)
    code = code_of(cols)
    full = (1 << p) - 1
    codes = (observed_codes(df, cols) if codes is None else codes) if missing else []

    def logp(i: int) -> Column:
        prior = F.col(row_logpi[i]) if row_logpi else F.lit(float(model.logpi[i]))
        if log_mg is not None:
            prior = prior + F.lit(float(log_mg[i]))
        if label_logs:
            prior = prior + F.col(label_logs[i])
        chain = F.when(F.col("__code") == full, log_density(model, cols, i, full, variance))
        if missing:
            for c in sorted({*codes} - {0, full}):
                chain = chain.when(F.col("__code") == c, log_density(model, cols, i, c, variance))
            chain = chain.when(F.col("__code") == 0, F.lit(0.0))
        return chain + prior

    # a column a cluster, not an array: scalars stay in generated code
    logs, parts = [f"__l{i}" for i in range(k)], [f"__e{i}" for i in range(k)]
    out = df.withColumn("__code", code).withColumns({n: logp(i) for i, n in enumerate(logs)})
    out = out.withColumn("__m", F.greatest(*logs) if k > 1 else F.col(logs[0])).withColumns({e: F.exp(F.col(n) - F.col("__m")) for e, n in zip(parts, logs)})
    out = out.withColumn("__s", sum((F.col(e) for e in parts[1:]), F.col(parts[0])))
    out = out.withColumn(name, F.array(*(F.col(e) / F.col("__s") for e in parts))).withColumn("log_evidence", F.col("__m") + F.log("__s"))
    return out.drop("__code", "__m", "__s", *logs, *parts)


def normal_draw(seed: int, *parts) -> Column:
    """A standard normal number that follows from the seed and the parts alone, whatever the partitions.

    Box-Muller on two 48-bit pieces of a hash of them, colons between; a null counts as empty.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts))
    piece = lambda at: (F.conv(F.substring(F.md5(text), at, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)
    return F.sqrt(-2 * F.log(piece(1))) * F.cos(F.lit(2 * math.pi) * piece(13))


def infer_missing(scored: DataFrame, cols: list[str], model: Mixture, z: str = "z", suffix: str = "", sample: int | None = None, key: tuple = (), codes: list[int] | None = None) -> DataFrame:
    """Missing channels become sums over clusters of z times the conditional mean.

    sample: a seed; each cluster's mean then gets a draw from the conditional covariance of the row's
    pattern, by the row's columns ``key``: rows of one key draw alike.
    """
    p, full = len(cols), (1 << len(cols)) - 1
    code = code_of(cols)
    codes = [c for c in (observed_codes(scored, cols) if codes is None else codes) if c != full]
    values = {}
    for ci, c in enumerate(cols):
        chain = None
        for code_value in codes:
            o, m = split(code_value, p)
            if ci not in m:
                continue
            total = F.lit(0.0)
            for k in range(len(model.mu)):
                prec = model.A[k]
                s = np.linalg.solve(prec[np.ix_(m, m)], prec[np.ix_(m, o)]) if o else np.zeros((len(m), 0))
                mean = F.lit(float(model.mu[k, ci]))
                for j, oj in enumerate(o):
                    mean = mean + F.lit(float(s[m.index(ci), j])) * (F.lit(float(model.mu[k, oj])) - F.col(cols[oj]))
                if sample is not None:
                    # the inverse of the precision's upper root: its square is the conditional covariance
                    root = np.linalg.inv(np.linalg.cholesky(prec[np.ix_(m, m)]).T)[m.index(ci)]
                    for j, mj in enumerate(m):
                        if root[j]:
                            mean = mean + F.lit(float(root[j])) * normal_draw(sample, *(F.col(x) for x in key), k, mj)
                total = total + F.get(z, F.lit(k)) * mean
            chain = (F if chain is None else chain).when(code == code_value, total)
        values[c + suffix] = F.coalesce(F.col(c), chain) if chain is not None else F.col(c)
    return scored.withColumns(values)


# one pass: sufficient statistics -----------------------------------------------------------------------
def suffstats(df: DataFrame, cols: list[str], z: list[Column], weight: Column | None = None) -> DataFrame:
    """By pattern code: s0_<k>, s1_<k>_<p>, s2_<k>_<p>_<q> (p <= q) of observed channels. One aggregate, SQL functions only."""
    w = weight if weight is not None else F.lit(1.0)
    code = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0)).cast("long")
    sums = []
    for k, zk in enumerate(z):
        sums.append(F.sum(w * zk).alias(f"s0_{k}"))
        for i, a in enumerate(cols):
            sums.append(F.sum(w * zk * F.col(a)).alias(f"s1_{k}_{i}"))
            sums += [F.sum(w * zk * F.col(a) * F.col(b)).alias(f"s2_{k}_{i}_{j}") for j, b in enumerate(cols) if j >= i]
    return df.withColumn("code", code).groupBy("code").agg(*sums)


#: Bytes of rows that a task holds while it merges equal ones.
HELD = 1 << 25


def merge_equal(df: DataFrame, weight: str) -> DataFrame:
    """Equal rows of a task as one with their summed weight; nothing is shuffled.

    Rows pass through in pieces of at most HELD bytes where over half of them differ. A null weight counts as NaN.
    """
    keys = [c for c in df.columns if c != weight]

    def run(batches):
        import pyarrow as pa

        def merge(held):
            out = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([(weight, "sum")])
            return pa.Table.from_arrays(out.select([*keys, f"{weight}_sum"]).columns, schema=held[0].schema).combine_chunks().to_batches()

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > HELD:
                held = merge(held)
                size = sum(b.nbytes for b in held)
                if 2 * size > HELD:
                    yield from held
                    held, size = [], 0
        if held:
            yield from merge(held)

    return df.select(*keys, F.coalesce(F.col(weight).cast("double"), F.lit(math.nan)).alias(weight)).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + f", `{weight}` double")


#: Numbers in a block of rows and their products.
BLOCK = 1 << 20


def _pass(df: DataFrame, cols, model: Mixture, weight, variance, log_mg, label_logs, row_logpi):
    """{code: (s0 K, s1 K x P, s2 K x P x P)}, sum of w z log p, of w z (log pi + ...), of w z log z.

    A block of a pattern's rows is a matrix of ones, values and products of pairs: the log-densities are
    a product of it from the left, the statistics one from the right.
    """
    p, k = len(cols), len(model.mu)
    extra = [*([weight] if weight else []), *(label_logs or []), *(row_logpi or [])]

    def factors(code: int):
        """Observed channels, pairs of them (as places among them), and the factors K x (1 + observed + pairs)."""
        o = split(code, p)[0]
        left, right = np.triu_indices(len(o))
        out = []
        for i in range(k):
            A, const, _ = pattern_terms(model, code, i)
            if variance is not None:
                const -= 0.5 * (np.diag(A) * variance[o]).sum()
            out.append(np.concatenate([[const], A @ model.mu[i, o], np.where(left == right, -0.5, -1.0) * A[left, right]]))
        return o, left, right, np.array(out)

    def run(batches):
        import pyarrow as pa

        acc: dict[int, list] = {}
        terms: dict[int, tuple] = {}  # of the patterns that occur
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            x = np.stack([get(c) for c in cols])
            w = get(weight) if weight else np.ones(x.shape[1])
            codes = (1 << np.arange(p)) @ ~np.isnan(x)
            prior = np.stack([get(c) for c in row_logpi]) if row_logpi else np.repeat((model.logpi + (0 if log_mg is None else log_mg))[:, None], x.shape[1], 1)
            if label_logs:
                prior = prior + np.stack([get(c) for c in label_logs])
            for code in np.unique(codes).tolist():
                if code == 0:
                    continue  # nothing observed tells nothing
                if code not in terms:
                    terms[code] = factors(code)
                o, left, right, theta = terms[code]
                size = theta.shape[1]
                rows = np.flatnonzero(codes == code)
                s = acc.setdefault(code, [np.zeros((k, size)), np.zeros(3)])
                step = max(1, BLOCK // size)
                for block in (rows[at : at + step] for at in range(0, len(rows), step)):
                    f = np.empty((size, len(block)))
                    f[0] = 1
                    f[1 : 1 + len(o)] = x[np.ix_(o, block)]
                    for j, (a, b) in enumerate(zip(left, right), 1 + len(o)):
                        np.multiply(f[1 + a], f[1 + b], out=f[j])
                    logp, own = theta @ f, prior[:, block]
                    z = logp + own
                    z = np.exp(z - z.max(0))
                    z /= z.sum(0)
                    zw = z * w[block]
                    s[0] += zw @ f.T
                    s[1] += (zw * logp).sum(), (zw * own).sum(), (zw * np.log(np.maximum(z, EPS))).sum()
        blobs = []
        for code, (sums, tail) in acc.items():
            o, left, right, _ = terms[code]
            s1, s2, oi = np.zeros((k, p)), np.zeros((k, p, p)), np.array(o)
            s1[:, o] = sums[:, 1 : 1 + len(o)]
            s2[:, oi[left], oi[right]] = s2[:, oi[right], oi[left]] = sums[:, 1 + len(o) :]
            blobs.append(np.concatenate([sums[:, 0], s1.ravel(), s2.ravel(), tail]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int64()), pa.array(blobs, pa.binary())], names=["code", "sums"])

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(v.as_py()) for v in table.column("sums"))
        return pa.table({"code": table.column("code")[:1].cast(pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    sums = df.select(*cols, *extra).mapInArrow(run, "code long, sums binary")
    if p > ALL_CODES:  # many patterns: a row for each, not for each task, reaches the driver
        sums = sums.groupBy("code").applyInArrow(add, "code long, sums binary")
    out: dict[int, list] = {}
    tail = np.zeros(3)
    for code, blob in sums.collect():
        v = np.frombuffer(blob)
        s = [v[:k], v[k : k + k * p].reshape(k, p), v[k + k * p : k + k * p + k * p * p].reshape(k, p, p)]
        if variance is not None:
            s[2] = s[2] + s[0][:, None, None] * np.diag([variance[i] if code >> i & 1 else 0.0 for i in range(p)])
        tail += v[-3:]
        had = out.get(code)
        out[code] = s if had is None else [a + b for a, b in zip(had, s)]
    return out, tail


def complete(stats: dict[int, list], mu: np.ndarray, A: np.ndarray):
    """Statistics of all channels: missing ones by the conditional Gaussian of each pattern."""
    k, p = mu.shape
    t0, t1, t2 = np.zeros(k), np.zeros((k, p)), np.zeros((k, p, p))
    for code, (s0, s1, s2) in stats.items():
        o, m = split(code, p)
        t0 += s0
        for i in range(k):
            a1, a2 = s1[i].copy(), s2[i].copy()
            if m:
                inv = np.linalg.inv(A[i][np.ix_(m, m)])
                S = inv @ A[i][np.ix_(m, o)]
                mo, mm, x1, x2 = mu[i, o], mu[i, m], s1[i, o], s2[i][np.ix_(o, o)]
                a1[m] = s0[i] * mm + S @ (s0[i] * mo - x1)
                cross = np.outer(mm, x1) + S @ (np.outer(mo, x1) - x2)
                a2[np.ix_(m, o)], a2[np.ix_(o, m)] = cross, cross.T
                T = np.outer(S @ (s0[i] * mo - x1), mm)
                a2[np.ix_(m, m)] = s0[i] * np.outer(mm, mm) + T + T.T + S @ (x2 + s0[i] * np.outer(mo, mo) - np.outer(mo, x1) - np.outer(x1, mo)) @ S.T + s0[i] * inv
            t1[i] += a1
            t2[i] += a2
    return t0, t1, t2


def update_clusters(s0, s1, s2, prior: Prior | None):
    """(mu, A, b, V, n): maximum likelihood without a prior, else the Gauss-Wishart posterior."""
    k, p = s1.shape
    if prior is None:
        mu = s1 / np.maximum(s0, EPS)[:, None]
        A = np.stack([np.linalg.inv(s2[i] / max(s0[i], EPS) - np.outer(mu[i], mu[i]) + 1e-12 * np.eye(p)) for i in range(k)])
        return mu, A, None, None, None
    b, n = prior.b + s0, prior.n + s0
    mu = (s1 + prior.b[:, None] * prior.mu) / b[:, None]
    V = np.stack([np.linalg.inv(s2[i] + prior.b[i] * np.outer(prior.mu[i], prior.mu[i]) - b[i] * np.outer(mu[i], mu[i]) + np.linalg.inv(prior.V[i])) for i in range(k)])
    return mu, n[:, None, None] * V, b, V, n


def update_proportions(s0, alpha0=None):
    """(logpi, alpha)"""
    if alpha0 is None:
        s0 = np.maximum(s0, EPS)
        return np.log(s0 / s0.sum()), None
    alpha = alpha0 + s0
    return dirichlet_logpi(alpha), alpha


def class_weights(s0: np.ndarray, lkp) -> np.ndarray:
    """Weights of clusters within their class."""
    lkp = np.asarray(lkp)
    return np.array([s0[i] / max(s0[lkp == lkp[i]].sum(), EPS) for i in range(len(s0))])


def kl_dirichlet(alpha, alpha0) -> float:
    alpha, alpha0 = np.asarray(alpha, float), np.asarray(alpha0, float)
    g = np.vectorize(math.lgamma)
    return float(math.lgamma(alpha.sum()) - g(alpha).sum() - math.lgamma(alpha0.sum()) + g(alpha0).sum() + ((alpha - alpha0) * dirichlet_logpi(alpha)).sum())


def kl_wishart(V1, n1, V0, n0) -> float:
    p = len(V1)
    return float(
        0.5 * n0 * (np.linalg.slogdet(V0)[1] - np.linalg.slogdet(V1)[1]) + 0.5 * n1 * (np.trace(np.linalg.solve(V0, V1)) - p) + 0.5 * (n1 - n0) * np_mv_digamma(n1 / 2, p) + np_mv_lgamma(n0 / 2, p) - np_mv_lgamma(n1 / 2, p)
    )


def kl_gauss_wishart(model: Mixture, prior: Prior) -> float:
    total, p = 0.0, model.mu.shape[1]
    for k in range(len(model.mu)):
        d = model.mu[k] - prior.mu[k]
        r = prior.b[k] / model.b[k]
        total += 0.5 * (p * (r - math.log(r) - 1) + prior.b[k] * model.n[k] * d @ model.V[k] @ d) + kl_wishart(model.V[k], model.n[k], prior.V[k], prior.n[k])
    return total


def marginal_sum(stats: dict[int, list], model: Mixture) -> float:
    """Expected log-likelihood of the rows from their statistics."""
    total = 0.0
    for code, (s0, s1, s2) in stats.items():
        for k in range(len(model.mu)):
            A, const, o = pattern_terms(model, code, k)
            total += const * s0[k] + s1[k, o] @ A @ model.mu[k, o] - 0.5 * np.trace(A @ s2[k][np.ix_(o, o)])
    return float(total)


def initial(df: DataFrame, cols, k, method="kmeans", weight=None, prior: Prior | None = None, seed=0) -> Mixture:
    """Start of the fit: k-means clusters, prior means, sampled rows, uniform or even spacing."""
    p = len(cols)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    row = df.agg(*(f.alias(n) for c in cols for f, n in ((F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w)), f"m_{c}"), (F.sum(w * F.col(c) ** 2) / F.sum(F.when(F.col(c).isNotNull(), w)), f"q_{c}")))).head()
    var = np.array([max(row[f"q_{c}"] - row[f"m_{c}"] ** 2, 1e-12) for c in cols])
    spread = 1.0
    if method == "kmeans":
        mu, _, _ = kmeans.fit(df, cols, k, weight=weight, init="plus", seed=seed, iterations=25)
        spread = float(k)
    elif method == "prior" and prior is not None:
        A = prior.n[:, None, None] * prior.V
        return Mixture(prior.mu.copy(), A, np.full(k, -math.log(k)))
    elif method in ("sample", "uniform", "linspace"):
        mu = kmeans.start(df, cols, k, method, weight, seed)
        spread = float(k)
    else:
        raise ValueError(f"unknown start {method}")
    return Mixture(mu, np.tile(np.diag(spread ** (2 / p) / var), (k, 1, 1)), np.full(k, -math.log(k)))


#: Updates between two bounds of the sub-EM. Fixed value.
UPDATES = 4


def sub_em(stats: dict[int, list], model: Mixture, prior: Prior | None, iterations: int | None = 1024, tolerance: float = 1e-4, trace: list | None = None):
    """(mu, A, b, V, n) of given statistics by pattern: responsibilities stay, what is missing is completed anew.

    One pattern needs one update. A cluster whose precision turns out not positive definite keeps its
    last one. iterations None: until the bound gains less than tolerance. trace: gets the bounds.
    """

    def bound(now: Mixture) -> float:
        return marginal_sum(stats, now) - (kl_gauss_wishart(now, prior) if prior is not None and now.V is not None else 0.0)

    now, bounds = model, [bound(model)]
    for _ in count() if iterations is None else range(iterations):
        for _ in range(UPDATES if len(stats) > 1 else 1):
            mu, A, b, V, n = update_clusters(*complete(stats, now.mu, now.A), prior)
            for i in range(len(A)):
                if not np.linalg.eigvalsh((A[i] + A[i].T) / 2).min() > 0:
                    A[i] = now.A[i]
                    if V is not None and now.V is not None:
                        V[i], n[i] = now.V[i], now.n[i]
            now = Mixture(mu, A, model.logpi, b, V, n, model.alpha)
        bounds.append(bound(now))
        step = bounds[-1] - bounds[-2]
        # so put that a bound that is no number ends it too
        if len(stats) == 1 or not (step > np.finfo(np.float32).eps * abs(bounds[-1]) and step > tolerance * (max(bounds[1:]) - min(bounds[1:]))):
            break
    if trace is not None:
        trace += bounds
    return now.mu, now.A, now.b, now.V, now.n


def fit(df: DataFrame, cols: list[str], k: int | None = None, weight: str | None = None, prior: Prior | None = None, start="kmeans", missing: bool = True, iterations: int | None = 1000, tolerance: float = 1e-4, bin_width=None, lkp=None, label_logs=None, row_logpi=None, fixed_pi: bool = False, seed: int = 0, sub_iterations: int | None = 1024, sub_tolerance: float = 1e-4, last_score: bool = True) -> Mixture:
    """EM. start: a method's name or a Mixture. bin_width adds the variance of binned values.

    A round passes over the rows once and then runs a fixed-point loop on the patterns' statistics (sub-EM:
    clusters complete what is missing, and are updated by it) until its bound gains less than
    sub_tolerance, or sub_iterations. The rounds end when what they reach, the bound of a round's new model
    under the responsibilities that made it, changes by tolerance of its span or less, or after iterations
    (None: only so). The start's own bound lacks the divergences and would widen the span, so it isn't in it.
    last_score: the last model is scored too, so that the last bound is of the model that is returned.
    """
    rows = df if missing else df.na.drop("any", subset=cols)
    base = rows.select(*(F.col(c).cast("double").alias(c) for c in cols), *([F.col(weight).cast("double").alias(weight)] if weight else []), *(label_logs or []), *(row_logpi or []))
    given = isinstance(start, Mixture)
    if not given:
        base.persist()  # starts draw among the rows as they are, in several passes
    mass = weight or "__w"
    each = merge_equal(base if weight else base.withColumn(mass, F.lit(1.0)), mass).persist()
    variance = None if bin_width is None else np.broadcast_to(np.asarray(bin_width, float) ** 2 / 12, (len(cols),))
    try:
        model = start if given else initial(base, cols, k, start, weight, prior, seed)
        k = len(model.mu)
        mg, bounds = None if lkp is None else class_weights(np.ones(k), lkp), []
        parts: list[dict] = []

        def shares(mg):
            return None if mg is None else np.log(np.maximum(mg, EPS))

        def divergences(model) -> dict:
            of = {}
            if prior is not None and model.V is not None:
                precisions = sum(kl_wishart(model.V[i], model.n[i], prior.V[i], prior.n[i]) for i in range(k))
                of |= {"means": precisions - kl_gauss_wishart(model, prior), "precisions": -precisions}
                if prior.alpha is not None and model.alpha is not None:
                    of["proportions"] = -kl_dirichlet(model.alpha, prior.alpha)
            return of

        def passed(model, mg):
            """Statistics of a pass, and its rows' term of responsibilities; the bound of the model that it scores with is kept."""
            stats, (lx, lz, entropy) = _pass(each, cols, model, mass, variance, shares(mg), label_logs, row_logpi)
            of = {"observations": float(lx), "responsibilities": float(lz - entropy), **divergences(model)}
            parts.append({"bound": sum(of.values()), **of})
            bounds.append(parts[-1]["bound"])
            return stats, of["responsibilities"]

        reached: list[float] = []
        for _ in count() if iterations is None else range(iterations):
            stats, held = passed(model, mg)
            before = model, shares(mg)
            mu, A, b, V, n = sub_em(stats, model, prior, sub_iterations, sub_tolerance)
            s0 = sum((s[0] for s in stats.values()), np.zeros(k))
            logpi, alpha = (model.logpi, model.alpha) if fixed_pi or row_logpi else update_proportions(s0, None if prior is None else prior.alpha)
            mg = None if lkp is None else class_weights(s0, lkp)
            model = Mixture(mu, A, logpi, b, V, n, alpha)
            if not row_logpi:  # else rows have proportions of their own
                held += s0 @ (model.logpi - before[0].logpi + (0 if mg is None else shares(mg) - before[1]))
            reached.append(float(marginal_sum(stats, model) + held + sum(divergences(model).values())))
            # so put that a bound that is no number ends it too
            if len(reached) > 1 and not abs(reached[-1] - reached[-2]) > tolerance * (max(reached) - min(reached)):
                break
        if last_score and iterations != 0:
            passed(model, mg)
        model.bound, model.parts = bounds, parts
        return model
    finally:
        each.unpersist()
        if not given:
            base.unpersist()


def prune(model: Mixture, threshold: float, renormalise: bool = False) -> Mixture:
    """Clusters with at least this share stay."""
    keep = model.pi >= threshold
    pick = lambda a: None if a is None else a[keep]
    logpi = model.logpi[keep]
    if renormalise:
        logpi = logpi - np.log(np.exp(logpi).sum())
    return Mixture(model.mu[keep], model.A[keep], logpi, pick(model.b), pick(model.V), pick(model.n), pick(model.alpha))


#: How fast a split cluster's spread passes to its parts' means. Fixed value.
SPLIT_RATE = 0.25


def more_gaussians(model: Mixture, lkp, seed: int = 0) -> Mixture:
    """Cluster k as so many parts as lkp holds k (from 0).

    With n parts a share of the covariance, from 0 for one towards a half, goes to the parts' means,
    which are drawn along its root and put in order; the rest is every part's covariance.
    """
    of = np.sort(np.asarray(lkp))
    parts = np.bincount(of, minlength=len(model.mu))[of]
    share = np.tanh(SPLIT_RATE * (parts - 1) / 2) / 2
    cov = np.linalg.inv(model.A)
    values, vectors = np.linalg.eigh(cov)
    root = np.einsum("kij,kj,klj->kil", vectors, np.sqrt(np.maximum(values, 0)), vectors)
    draws = np.random.default_rng(seed).normal(size=(len(of), model.mu.shape[1]))
    for d in range(draws.shape[1]):  # in order within a cluster
        draws[:, d] = draws[np.lexsort((draws[:, d], of)), d]
    mu = model.mu[of] + share[:, None] * np.einsum("kij,kj->ki", root[of], draws)
    return Mixture(mu, np.linalg.inv(cov[of] * (1 - share)[:, None, None]), model.logpi[of] - np.log(parts))


def label_start(df: DataFrame, cols: list[str], label: str, weight: str | None = None) -> Mixture:
    """Moments of labelled rows as a start, labels in order: means of what is observed, and covariances
    of pairs that are observed together. One aggregate; a row a label reaches the driver."""
    p = len(cols)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = [F.col(c).cast("double") for c in cols]
    both = lambda i, j: x[i].isNotNull() & x[j].isNotNull()
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(w).alias("n"), *(F.sum(w * x[i]).alias(f"m{i}") for i in range(p)), *(F.sum(F.when(x[i].isNotNull(), w)).alias(f"w{i}") for i in range(p))]
    sums += [F.sum(F.when(both(i, j), w * x[i] * x[j])).alias(f"q{i}_{j}") for i, j in pairs] + [F.sum(F.when(both(i, j), w)).alias(f"c{i}_{j}") for i, j in pairs]
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(*sums).orderBy(label).collect()
    mu = np.array([[r[f"m{i}"] / r[f"w{i}"] for i in range(p)] for r in rows])
    cov = np.zeros((len(rows), p, p))
    for k, r in enumerate(rows):
        for i, j in pairs:
            if r[f"c{i}_{j}"]:
                cov[k, i, j] = cov[k, j, i] = r[f"q{i}_{j}"] / r[f"c{i}_{j}"] - mu[k, i] * mu[k, j]
    n = np.array([r["n"] for r in rows])
    return Mixture(mu, np.linalg.inv(cov), np.log(n / n.sum()))


def collapse_gaussians(model: Mixture, lkp) -> Mixture:
    """One cluster for each class: moments of its clusters, weighted by their shares."""
    lkp, out = np.asarray(lkp), ([], [], [])
    for c in np.unique(lkp):
        w = model.pi[lkp == c]
        mus, covs = model.mu[lkp == c], np.stack([np.linalg.inv(a) for a in model.A[lkp == c]])
        mean = w @ mus / w.sum()
        cov = sum(x * (s + np.outer(m - mean, m - mean)) for x, s, m in zip(w, covs, mus)) / w.sum()
        out[0].append(mean)
        out[1].append(np.linalg.inv(cov))
        out[2].append(math.log(w.sum()))
    return Mixture(*map(np.array, out))


def wishart_order(mean: np.ndarray, elog: float) -> float:
    """n of the Wishart with this mean whose expected log-determinant this is: psi_p(n / 2) - p log(n / 2) + log|mean| = elog, by bisection."""
    p = len(mean)
    gap = lambda n: np_mv_digamma(n / 2, p) - p * math.log(n / 2) + np.linalg.slogdet(mean)[1] - elog
    lo, hi = p - 1 + 1e-6, 1e8
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if gap(mid) < 0 else (lo, mid)
    return lo


@dataclass
class SharedPrior:
    """A prior whose clusters' inverse scales are draws of one Wishart: V0, p0 of that, V and p of each cluster's, and the bound by round."""

    prior: Prior
    V0: np.ndarray
    p0: float
    V: np.ndarray
    p: np.ndarray
    bound: list


def shared_hyper(models: list[Mixture], rounds: int = 200, tolerance: float = 1e-10) -> SharedPrior:
    """Empirical Bayes with one Wishart over all clusters' inverse scale matrices.

    Means and their strengths are those of ``update_hyper``. In turn: each cluster's posterior of the
    inverse scale given the shared prior, p = p0 + S n0 and V^-1 = V0^-1 + the fits' summed mean
    precisions; each cluster's n0 where the gradient of the expected likelihood is 0, by Newton with p
    tied to it; then the shared V0 and p0 that make the posteriors most likely. It ends when the bound
    (minus the divergences from the shared prior) gains less than tolerance of its size.
    """
    out = update_hyper(models)
    k, d = models[0].mu.shape
    s = len(models)
    precision = np.array([[m.n[i] * m.V[i] for m in models] for i in range(k)])  # cluster, fit
    total = precision.sum(1)
    seen = np.array([np.mean([np.linalg.slogdet(m.V[i])[1] + np_mv_digamma(m.n[i] / 2, d) for m in models]) for i in range(k)])
    p0, V0 = s * out.n.mean(), np.linalg.inv(precision).sum((0, 1)) / k / (s * out.n.mean())
    V, p, bounds = np.zeros((k, d, d)), np.zeros(k), []
    for _ in range(rounds):
        for i in range(k):
            V[i] = np.linalg.inv(np.linalg.inv(V0) + total[i])
            n = out.n[i]
            for _ in range(100):
                p[i] = p0 + s * n
                # the scale's expected log-determinant is minus that of its inverse
                log_scale = -(np_mv_digamma(p[i] / 2, d) + d * math.log(2) + np.linalg.slogdet(V[i])[1])
                g = 0.5 * s * (log_scale - seen[i] + np_mv_digamma(n / 2, d))
                h = 0.25 * s * (np_mv_trigamma(n / 2, d) - s * np_mv_trigamma(p[i] / 2, d))
                step = g / h if h > 0 else 4 * g / (s * np_mv_trigamma(n / 2, d))
                new = max(n - step, (n + d - 1) / 2)
                if abs(new - n) <= 1e-13 * n:
                    break
                n = new
            out.n[i], p[i] = n, p0 + s * n
            out.V[i] = np.linalg.inv(p[i] * V[i])
        mean = np.einsum("i,ijk->jk", p, V) / k
        elog = np.mean([np_mv_digamma(p[i] / 2, d) + d * math.log(2) + np.linalg.slogdet(V[i])[1] for i in range(k)])
        p0 = wishart_order(mean, elog)
        V0 = mean / p0
        bounds.append(-sum(kl_wishart(V[i], p[i], V0, p0) for i in range(k)))
        if len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) <= tolerance * max(abs(bounds[-1]), 1e-300):
            break
    return SharedPrior(out, V0, p0, V, p, bounds)


def collapse_prior(prior: Prior, lkp) -> Prior:
    """One cluster for each class of a prior: means of the clusters' means, strengths and degrees, and the mean of their expected covariances."""
    lkp = np.asarray(lkp)
    covs = np.linalg.inv(prior.n[:, None, None] * prior.V)
    of = [lkp == c for c in np.unique(lkp)]
    n = np.array([prior.n[o].mean() for o in of])
    V = np.array([np.linalg.inv(covs[o].mean(0)) for o in of]) / n[:, None, None]
    alpha = None if prior.alpha is None else np.array([prior.alpha[o].sum() for o in of])
    return Prior(np.array([prior.mu[o].mean(0) for o in of]), np.array([prior.b[o].mean() for o in of]), V, n, alpha)


def update_hyper(models: list[Mixture], iterations: int = 50) -> Prior:
    """Empirical Bayes: the Gauss-Wishart prior that makes the posteriors of several fits most likely, each cluster by itself."""
    k, p = models[0].mu.shape
    out = make_prior(k, p)
    for i in range(k):
        EA = [m.n[i] * m.V[i] for m in models]
        total = sum(EA)
        out.mu[i] = np.linalg.solve(total, sum(a @ m.mu[i] for a, m in zip(EA, models)))
        quad = sum((m.mu[i] - out.mu[i]) @ a @ (m.mu[i] - out.mu[i]) + p / m.b[i] for a, m in zip(EA, models))
        out.b[i] = len(models) * p / max(quad, EPS)
        mean_a = total / len(models)
        elog = np.mean([np_mv_digamma(m.n[i] / 2, p) + p * math.log(2) + np.linalg.slogdet(m.V[i])[1] for m in models])
        out.n[i] = wishart_order(mean_a, elog)
        out.V[i] = mean_a / out.n[i]
    return out


def palette_mix(z: str, palette: list[tuple[float, float, float]]) -> Column:
    """Responsibilities to a colour: the palette weighted by them; nulls where they sum to 0."""
    total = F.nullif(sum((F.get(z, F.lit(i)) for i in range(len(palette))), F.lit(0.0)), F.lit(0.0))
    return F.array(*(sum((F.get(z, F.lit(i)) * F.lit(float(c[j])) for i, c in enumerate(palette)), F.lit(0.0)) / total for j in range(3)))


def start_linspace(df: DataFrame, cols: list[str], k: int) -> np.ndarray:
    box = ranges(df, cols)
    return np.stack([[box[c][0] + (box[c][1] - box[c][0]) * (i + 1) / (k + 1) for c in cols] for i in range(k)])
