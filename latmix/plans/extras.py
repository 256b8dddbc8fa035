"""Queries: general matrices, multivariate normals, Wishart updates, starts from labels, warps, resampling, files."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from ..functions import dist, linalg
from ..operators import gmm, kmeans, lattice
from ..sources import catalog
from .common import OFF, r, rs, table
from .lattices import _FULL, DIM, volume


# matrices of any size ----------------------------------------------------------------------------------
def _e(n):
    return f"embedding[{n + 1}]::DOUBLE"


def _general(n, m, p, sym_a=False, sym_b=False, trans=False):
    """The product's elements, from a at the embedding's start and b at its 33rd component."""
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
        out = linalg.matmul(F.col("e"), F.slice("e", 33, 32), n, m, p, sym_a=sym_a, sym_b=sym_b, trans_a=trans)
        return e.select("vec_id", *(r(F.get(out, F.lit(k))).alias(f"m{k}") for k in range(n * p)))

    a = lambda i, k: _e(_packed(i, k, m) if sym_a else k * n + i if trans else i * m + k)
    b = lambda k, j: _e(32 + (_packed(k, j, m) if sym_b else k * p + j))
    return run, "SELECT vec_id, " + ", ".join(f"{rs(' + '.join(f'{a(i, k)} * {b(k, j)}' for k in range(m)))} AS m{i * p + j}" for i in range(n) for j in range(p)) + " FROM embeddings"


def _packed(i, j, n):
    """Where a symmetric matrix's element is packed: counted out, row by row."""
    order = [(k, k) for k in range(n)] + [(x, y) for x in range(n) for y in range(x + 1, n)]
    return order.index((min(i, j), max(i, j)))


def _shape(spark, sf_dir):
    """Transpose and dot of general size."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    t = linalg.transpose(F.col("e"), 4, 2)
    return e.select("vec_id", *(r(F.get(t, F.lit(k))).alias(f"t{k}") for k in range(8)), r(linalg.dot(F.slice("e", 1, 32), F.slice("e", 33, 32))).alias("dot"))


_SHAPE = "SELECT vec_id, " + ", ".join(f"{rs(_e((k % 4) * 2 + k // 4))} AS t{k}" for k in range(8)) + f", {rs(' + '.join(f'{_e(k)} * {_e(32 + k)}' for k in range(32)))} AS dot FROM embeddings"


# small matrices on the driver -----------------------------------------------------------------------------
_MOMENTS = "(SELECT l_returnflag AS g, avg(l_quantity / 10e0) AS ma, avg(l_discount * 50e0) AS mb, avg(l_quantity * l_quantity / 100e0) AS aa, avg(l_quantity / 10e0 * l_discount * 50e0) AS ab, avg(l_discount * l_discount * 2500e0) AS bb, count(*) AS n FROM lineitem GROUP BY l_returnflag)"


def _moments(spark, sf_dir):
    """Second moments of two channels by return flag: a row a flag."""
    x, y = F.col("l_quantity") / 10.0, F.col("l_discount") * 50.0
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg(x).alias("ma"), F.avg(y).alias("mb"), F.avg(x * x).alias("aa"), F.avg(x * y).alias("ab"), F.avg(y * y).alias("bb"), F.count("*").alias("n")).collect()
    return [(q["l_returnflag"], np.array([q["ma"], q["mb"]], float), np.array([[q["aa"], q["ab"]], [q["ab"], q["bb"]]], float), q["n"]) for q in rows]


def _round(x, digits=6, half=0.5):
    return float(np.floor(x * 10.0**digits + half) / 10.0**digits)


def small_matrices(spark, sf_dir):
    """Log-determinant, inverse, diagonal load and clamped spectrum of each flag's matrix."""
    out = []
    for g, _, m, _ in _moments(spark, sf_dir):
        flat = np.array([[m[0, 0], m[0, 0]], [m[0, 0], m[0, 0]]])
        loaded, clamped, inv = linalg.load_diag(flat), linalg.threshold_eig(m), linalg.inverse(m)
        out.append((g, _round(linalg.logdet(m)), *(_round(v) for v in (inv[0, 0], inv[0, 1], inv[1, 1])), _round(loaded[0, 0] / m[0, 0] - 1, 9), *(_round(v) for v in (clamped[0, 0], clamped[0, 1], clamped[1, 1]))))
    return spark.createDataFrame(out, "g string, logdet double, inv0 double, inv1 double, inv2 double, load double, clamp0 double, clamp1 double, clamp2 double")


_DET = "(aa * bb - ab * ab)"
#: ones everywhere: eigenvalues 2 and 0, so the load is the first with (0 + load) / (2 + load) >= 1e-5, of 1e-7, 1.1e-6, 1.11e-5, 1.111e-4 by compounding
_LOAD = "(1 + 1e-7) * (1 + 1e-6) * (1 + 1e-5) * (1 + 1e-4) - 1"
SMALL = f"SELECT g, {rs(f'ln({_DET})')} AS logdet, {rs(f'bb / {_DET}')} AS inv0, {rs(f'-ab / {_DET}')} AS inv1, {rs(f'aa / {_DET}')} AS inv2, {rs(_LOAD, 9)} AS load, {rs('aa')} AS clamp0, {rs('ab')} AS clamp1, {rs('bb')} AS clamp2 FROM {_MOMENTS}"


def wishart_updates(spark, sf_dir):
    """Expected matrix, and the update of a prior of twice the identity with 7 degrees by each flag's matrix."""
    out = []
    for g, _, m, n in _moments(spark, sf_dir):
        up, total = dist.wishart_update(m, n, 2 * np.eye(2), 7.0)
        mean = dist.wishart_mean(m, 3.0)
        out.append((g, *(_round(v) for v in (mean[0, 0], mean[0, 1], dist.wishart_mean(m, 3.0, "normal")[1, 1], up[0, 0], up[0, 1], up[1, 1])), float(total)))
    return spark.createDataFrame(out, "g string, mean0 double, mean1 double, normal2 double, up0 double, up1 double, up2 double, n double")


_P = [f"(3.5 + n * bb / {_DET})", f"(-n * ab / {_DET})", f"(3.5 + n * aa / {_DET})"]
_PD = f"({_P[0]} * {_P[2]} - {_P[1]} * {_P[1]})"
WISHART_UP = f"SELECT g, {rs('3 * aa')} AS mean0, {rs('3 * ab')} AS mean1, {rs('bb')} AS normal2, {rs(f'(n + 7) * {_P[2]} / {_PD}')} AS up0, {rs(f'-(n + 7) * {_P[1]} / {_PD}')} AS up1, {rs(f'(n + 7) * {_P[0]} / {_PD}')} AS up2, n + 7e0 AS n FROM {_MOMENTS}"


def kl_terms(spark, sf_dir):
    """Divergences between priors and what each flag's counts and matrices make of them."""
    out = []
    for g, mu, m, n in _moments(spark, sf_dir):
        nu, b = 5.0 + n / (1.0 + n), 2.0 + n / (1.0 + n)
        model = gmm.Mixture(mu[None], (nu * m)[None], np.zeros(1), np.array([b]), m[None], np.array([nu]))
        prior = gmm.make_prior(1, 2, mu=np.ones((1, 2)), b=1.5, V=np.eye(2) * 2, n=4.0)
        alpha = [1.0 + n / (1.0 + n), 2.0, 3.5]
        other = m + np.eye(2)
        terms = gmm.kl_dirichlet(alpha, [1.0, 1.0, 2.0]), gmm.kl_wishart(m, nu, np.eye(2) * 2, 4.0), gmm.kl_gauss_wishart(model, prior), dist.mv_normal_kl(mu, m, [1.0, 2.0], other), dist.mv_normal_kl_conjugate(mu, b, [1.0, 2.0], 1.5, m)
        out.append((g, *(_round(t, half=OFF) for t in terms)))
    return spark.createDataFrame(out, "g string, dirichlet double, wishart double, gauss_wishart double, normal double, conjugate double")


def _kl_sql():
    from .distributions import _psi

    t, nu, b = "(n / (1e0 + n))", "(5 + n / (1e0 + n))", "(2 + n / (1e0 + n))"
    dirichlet = f"lgamma(6.5 + {t}) - lgamma(1 + {t}) - lgamma(2) - lgamma(3.5) - lgamma(4) + lgamma(1) + lgamma(1) + lgamma(2) + {t} * ({_psi(f'1 + {t}')} - {_psi(f'6.5 + {t}')}) + ({_psi('2.0')} - {_psi(f'6.5 + {t}')}) + 1.5 * ({_psi('3.5')} - {_psi(f'6.5 + {t}')})"
    # the constants in pi of both multivariate gammas cancel
    wishart = f"2 * (2 * ln(2) - ln({_DET})) + 0.5 * {nu} * ((aa + bb) / 2 - 2) + 0.5 * ({nu} - 4) * ({_psi(f'{nu} / 2')} + {_psi(f'({nu} - 1) / 2')}) + lgamma(2) + lgamma(1.5) - lgamma({nu} / 2) - lgamma(({nu} - 1) / 2)"
    quad = lambda x, y: f"(aa * ({x}) * ({x}) + 2 * ab * ({x}) * ({y}) + bb * ({y}) * ({y}))"
    gauss = f"0.5 * (2 * (1.5 / {b} - ln(1.5 / {b}) - 1) + 1.5 * {nu} * {quad('ma - 1', 'mb - 1')}) + {wishart}"
    d0 = "((aa + 1) * (bb + 1) - ab * ab)"
    normal = f"0.5 * (((bb + 1) * aa - 2 * ab * ab + (aa + 1) * bb) / {d0} - ln({_DET} / {d0}) - 2 + ((bb + 1) * (ma - 1) ** 2 - 2 * ab * (ma - 1) * (mb - 2) + (aa + 1) * (mb - 2) ** 2) / {d0})"
    conjugate = f"0.5 * (2 * (1.5 / {b} - ln(1.5 / {b}) - 1) + 1.5 * {quad('ma - 1', 'mb - 2')})"
    return f"SELECT g, {rs(dirichlet, half=OFF)} AS dirichlet, {rs(wishart, half=OFF)} AS wishart, {rs(gauss, half=OFF)} AS gauss_wishart, {rs(normal, half=OFF)} AS normal, {rs(conjugate, half=OFF)} AS conjugate FROM {_MOMENTS}"


MU, COV = [2.5, 2.4], [[2.0, 0.3], [0.3, 1.5]]


def mv_normal(spark, sf_dir):
    """Densities of two channels under a given normal, summed by flag, and one channel's by precision."""
    x = ["l_quantity / 10e0", "l_discount * 50e0"]
    parts = {"logpdf": dist.mv_normal_logpdf(x, MU, COV), "pdf": dist.mv_normal_pdf(x, MU, COV), "scaled": dist.mv_normal_logpdf(x, MU, COV, "precision", 3.0), "single": dist.normal_logpdf_precision(x[0], "2.5e0", "0.5e0", "4e0")}
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(r(F.sum(F.expr(v)), 4).alias(k) for k, v in parts.items()))


_DX, _DY = "(l_quantity / 10e0 - 2.5)", "(l_discount * 50e0 - 2.4)"
_LP = f"(-ln(2 * pi()) - 0.5 * ln(2.91) - (1.5 * {_DX} * {_DX} - 0.6 * {_DX} * {_DY} + 2 * {_DY} * {_DY}) / 5.82)"
_SC = f"(-ln(2 * pi()) + 0.5 * ln(9 * 2.91) - 1.5 * (2 * {_DX} * {_DX} + 0.6 * {_DX} * {_DY} + 1.5 * {_DY} * {_DY}))"
MV = f"SELECT l_returnflag, {rs(f'sum({_LP})', 4)} AS logpdf, {rs(f'sum(exp({_LP}))', 4)} AS pdf, {rs(f'sum({_SC})', 4)} AS scaled, {rs(f'sum(0.5 * ln(2 / (2 * pi())) - {_DX} * {_DX})', 4)} AS single FROM lineitem GROUP BY l_returnflag"


# starts from labels ------------------------------------------------------------------------------------------
def start_from_labels(spark, sf_dir):
    """Means, covariances and shares of labelled rows with gaps."""
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 10.0).alias("a"), F.when(line % 3 != 0, F.col("l_discount") * 50.0).alias("b"))
    m = gmm.label_start(rows, ["a", "b"], "l_returnflag")
    cov = np.linalg.inv(m.A)
    return spark.createDataFrame([(k, *(_round(v) for v in (*m.mu[k], cov[k, 0, 0], cov[k, 0, 1], cov[k, 1, 1], np.exp(m.logpi[k])))) for k in range(len(m.mu))], "k int, a double, b double, aa double, ab double, bb double, share double")


STARTS = f"""WITH g AS (SELECT l_returnflag, l_quantity / 10e0 AS a, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount * 50e0 END AS b FROM lineitem),
s AS (SELECT l_returnflag, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(a * b) AS ab, avg(b * b) AS bb FROM g GROUP BY l_returnflag)
SELECT (row_number() OVER (ORDER BY l_returnflag) - 1)::INT AS k, {rs('ma')} AS a, {rs('mb')} AS b, {rs('aa - ma * ma')} AS aa, {rs('ab - ma * mb')} AS ab, {rs('bb - mb * mb')} AS bb, {rs('n / sum(n) OVER ()')} AS share FROM s"""


def draw(spark, sf_dir):
    """The customer that a draw at half of all positive balances picks, its share's end, and how many are picked."""
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").cast("double").alias("w"))
    out = kmeans.categorical_draw(rows, "w", "c_custkey", F.lit(0.5))
    return out.agg(F.sum(F.col("picked").cast("long")).alias("picked"), r(F.max("cum")).alias("top"), F.count("*").alias("n"), r(F.sum("w"), 2).alias("total"), F.max(F.when(F.col("picked"), F.col("c_custkey"))).alias("c_custkey"), r(F.max(F.when(F.col("picked"), F.col("cum")))).alias("cum"))


DRAW = f"""WITH b AS (SELECT c_custkey, c_acctbal::DOUBLE AS w, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 8))::BIGINT % 1024 AS bucket FROM customer WHERE c_acctbal > 0),
s AS (SELECT *, sum(w) OVER (ORDER BY bucket, c_custkey) AS run, sum(w) OVER () AS total FROM b),
p AS (SELECT *, run > 0.5 * total AND run - w <= 0.5 * total AS picked FROM s)
SELECT (count(*) FILTER (WHERE picked))::BIGINT AS picked, {rs('max(run / total)')} AS top, count(*) AS n, {rs('sum(w)', 2)} AS total,
max(c_custkey) FILTER (WHERE picked) AS c_custkey, {rs('max(run / total) FILTER (WHERE picked)')} AS cum FROM p"""


# warps and resampling ------------------------------------------------------------------------------------------
def warp_family(spark, sf_dir):
    """Identity, translation and linear warps, an affine of one, and the nearest voxels of the volume there."""
    one = lattice.identity_warp(spark, DIM, (1.0, 2.0, 0.5))
    two = lattice.translation_warp(spark, [0.5, -1.0, 2.0], DIM)
    three = lattice.transform_warp(lattice.linear_warp(spark, [[0.5, 0.0, 0.1], [0.0, 2.0, 0.0], [0.0, 0.3, 1.0]], DIM), np.array([[1, 0, 0, 1.0], [0, 0, 1, 0], [0, 1, 0, -1], [0, 0, 0, 1]]))
    name = lambda w, p: w.select("i", "j", "k", *(r(f"y{n}").alias(f"{p}{n}") for n in (1, 2, 3)))
    places = name(one, "a").join(name(two, "b"), ["i", "j", "k"]).join(name(three, "c"), ["i", "j", "k"])
    img, seen = volume(spark, sf_dir), []
    for w, n in ((one, "va"), (two, "vb"), (three, "vc")):
        got = lattice.sample(img, w, DIM, degree=0, bnd="replicate")
        seen.append(got.select("i", "j", "k", r("v").alias(n)))
    return places.join(seen[0], ["i", "j", "k"]).join(seen[1], ["i", "j", "k"]).join(seen[2], ["i", "j", "k"])


def _at(n):
    """The nearest voxel of the places n1, n2, n3, moved to the edge."""
    on = " AND ".join(f"{n}.{a} = least(greatest(floor(w.{n}{m + 1} + 0.5), 1), {d})" for m, (a, d) in enumerate(zip("ijk", DIM)))
    return f" JOIN f {n} ON {on}"


WARPS = f"WITH f AS (SELECT * FROM {_FULL}), w AS (SELECT i, j, k, {rs('i * 1e0')} AS a1, {rs('j * 2e0')} AS a2, {rs('k * 0.5e0')} AS a3, {rs('i + 0.5e0')} AS b1, {rs('j - 1e0')} AS b2, {rs('k + 2e0')} AS b3, {rs('0.5e0 * i + 0.1e0 * k + 1')} AS c1, {rs('0.3e0 * j + k')} AS c2, {rs('2e0 * j - 1')} AS c3 FROM f) SELECT w.*, {rs('a.v')} AS va, {rs('b.v')} AS vb, {rs('c.v')} AS vc FROM w{_at('a')}{_at('b')}{_at('c')}"


def downsample(spark, sf_dir):
    """In-plane nearest-neighbour reduction to 1 mm from voxels of half a millimetre."""
    out, M, dim = lattice.downsample(volume(spark, sf_dir), np.diag([0.5, 0.5, 2.0, 1.0]), DIM)
    return out.select("i", "j", "k", r("v").alias("v"), F.lit(float(M[0, 0])).alias("size"), F.lit(int(np.prod(dim))).alias("voxels"))


# voxel i of the coarse grid lies at 2 i - 0.5, which rounds up to 2 i
DOWN = f"WITH f AS (SELECT * FROM {_FULL}) SELECT (i // 2)::INT AS i, (j // 2)::INT AS j, k, {rs('v')} AS v, 1e0 AS size, 50::INT AS voxels FROM f WHERE i % 2 = 0 AND j % 2 = 0"


def resized(spark, sf_dir):
    """Twice the voxel size along the second axis, trilinear, over the image's own box."""
    out, M, dim = lattice.resize(volume(spark, sf_dir), np.eye(4), DIM, (np.nan, 1.5, np.nan))
    return out.select("i", "j", "k", r("v").alias("v"), F.lit(int(dim[1])).alias("rows"), F.lit(float(M[1, 1])).alias("size"))


RESIZED = f"""WITH f AS (SELECT * FROM {_FULL}), o AS (SELECT i, j2::INT AS j, k, 1 + 1.5e0 * (j2 - 1) AS y FROM (SELECT DISTINCT i, k FROM f), (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS j2))
SELECT o.i, o.j, o.k, {rs('coalesce(a.v, 0) * (1 - (y - floor(y))) + coalesce(b.v, 0) * (y - floor(y))')} AS v, 7::INT AS rows, 1.5e0 AS size
FROM o LEFT JOIN f a ON a.i = o.i AND a.k = o.k AND a.j = floor(y) LEFT JOIN f b ON b.i = o.i AND b.k = o.k AND b.j = floor(y) + 1"""


def resliced(spark, sf_dir):
    """A shifted part of the volume on the whole volume's grid, and the crop of both to the union of boxes."""
    img = volume(spark, sf_dir)
    part, M = lattice.crop(img, np.eye(4), [[2, 4], [3, 8], [1, 5]])
    both = lattice.reslice([(img, np.eye(4), DIM), (part, M, (3, 6, 5))], degree=0)
    boxes = lattice.union_boxes([lattice.world_box(M, (3, 6, 5)), [[1, 3, 1], [2, 4, 5]]])
    cropped, _ = lattice.crop_to_union([(img, np.eye(4), DIM)], [boxes])[0]
    return both[1].select("i", "j", "k", r("v").alias("v")).join(cropped.select("i", "j", "k", r("v").alias("cropped")), ["i", "j", "k"], "left")


RESLICED = f"WITH f AS (SELECT * FROM {_FULL}) SELECT f.i, f.j, f.k, {rs('CASE WHEN f.i BETWEEN 2 AND 4 AND f.j BETWEEN 3 AND 8 THEN f.v ELSE 0 END')} AS v, {rs('g.v')} AS cropped FROM f LEFT JOIN f g ON g.i = f.i + 0 AND g.j = f.j + 2 AND g.k = f.k AND f.i <= 4 AND f.j <= 6"


# files -----------------------------------------------------------------------------------------------------------
def _folder(spark, name):
    """A new folder that all tasks share."""
    import uuid

    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        given = "file://" + tempfile.mkdtemp(prefix="latmix-")
        spark.sparkContext.setCheckpointDir(given)
    return f"{given.rstrip('/')}/latmix-{name}-{uuid.uuid4().hex}"


def _put(spark, path: str, data: bytes) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p)
    out.write(bytearray(data))
    out.close()


def json_scan(spark, sf_dir):
    """Records of JSON files below a folder, a list or an object each, by region; hidden and other files don't count."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey").orderBy("n_nationkey").collect()
    root = _folder(spark, "json")
    for region in sorted({q["r_name"] for q in rows}):
        recs = [{"name": q["n_name"], "population": region, "pth": f" {q['n_name']}.nii ", "extra": str(q["n_nationkey"])} for q in rows if q["r_name"] == region]
        _put(spark, f"{root}/{region[:2]}/all.json", json.dumps(recs[:-1]).encode())
        _put(spark, f"{root}/{region[:2]}/deep/one.JSON", json.dumps(recs[-1]).encode())
        _put(spark, f"{root}/{region[:2]}/.hidden.json", b'{"name": "hidden"}')
        _put(spark, f"{root}/{region[:2]}/.dir/x.json", b'{"name": "hidden"}')
        _put(spark, f"{root}/{region[:2]}/note.txt", b'{"name": "text"}')
    recs = catalog.validate(catalog.read_records(spark, root)).withColumn("subject", catalog.subject_key())
    return recs.select("subject", "population", "protocol", "pth", F.element_at("open", "extra").alias("extra"), F.regexp_extract("file", "([^/]+)$", 1).alias("file"))


JSON = """SELECT r_name || '_' || n_name AS subject, r_name AS population, 'unknown' AS protocol, n_name || '.nii' AS pth, n_nationkey::VARCHAR AS extra,
CASE WHEN row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey DESC) = 1 THEN 'one.JSON' ELSE 'all.json' END AS file FROM nation JOIN region ON n_regionkey = r_regionkey"""


QUERIES, ORACLE = {}, {}
for _name, (_run, _sql) in {
    "general_mm": _general(4, 2, 3), "general_ms": _general(2, 4, 4, sym_b=True), "general_sm": _general(4, 4, 2, sym_a=True), "general_ss": _general(4, 4, 4, True, True),
    "general_tmm": _general(4, 2, 3, trans=True), "general_mv": _general(4, 5, 1), "general_sv": _general(4, 4, 1, sym_a=True), "general_tmv": _general(5, 4, 1, trans=True),
    "general_t_vv": (_shape, _SHAPE), "small_matrices": (small_matrices, SMALL), "wishart_updates": (wishart_updates, WISHART_UP), "kl_terms": (kl_terms, _kl_sql()), "mv_normal": (mv_normal, MV),
    "gmm_start_labels": (start_from_labels, STARTS), "categorical_draw": (draw, DRAW),
    "warp_family": (warp_family, WARPS), "downsample": (downsample, DOWN), "resize": (resized, RESIZED), "reslice": (resliced, RESLICED),
    "cat_json_scan": (json_scan, JSON),
}.items():
    QUERIES[_name], ORACLE[_name] = _run, _sql
