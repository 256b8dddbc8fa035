"""Queries: catalogue maintenance, completed statistics, collapsed clusters, proportions by row, images of reference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import gmm, lattice, observations
from ..sources import catalog
from .catalogues import _CAT, _SUBJ, recs
from .common import OFF, gaps, r, rs, table
from .headers import _HEADERS, headers
from .lattices import _FULL, volume
from .mixtures import COLS, MODEL, _logp_sql, _scored_sql


# catalogue --------------------------------------------------------------------------------------------------
def cat_merge(spark, sf_dir):
    """Of subjects in two catalogues the first one's entry stays: labels first, all records then."""
    rows = recs(spark, sf_dir)
    both = catalog.merge_catalogues(catalog.subjects(rows.where("type = 'label'")), catalog.subjects(rows))
    return both.select("subject", "seq", "records", F.coalesce(F.size("labels"), F.lit(0)).alias("labels"), F.coalesce(F.size("modalities"), F.lit(0)).alias("modalities"))


_MERGE = f"""WITH a AS (SELECT subject, min(seq) AS seq, count(*) AS records FROM {_SUBJ} WHERE type = 'label' GROUP BY subject)
SELECT coalesce(a.subject, c.subject) AS subject, coalesce(a.seq, c.seq) AS seq, coalesce(a.records, c.records) AS records, (CASE WHEN a.subject IS NOT NULL THEN a.records ELSE c.labels END)::INT AS labels, CASE WHEN a.subject IS NOT NULL THEN 0 ELSE c.modalities END::INT AS modalities
FROM ({_CAT}) c LEFT JOIN a USING (subject)"""


def cat_keep_channels(spark, sf_dir):
    """Of each subject's first modality two channels, of the others all."""
    cut = catalog.keep_channels(catalog.subjects(recs(spark, sf_dir)), ["c0", "c2"])
    m = cut.select("subject", F.explode("modalities").alias("m")).select("subject", "m.modality", F.explode("m.channels").alias("c"))
    return m.groupBy("subject", "modality").agg(F.count("*").alias("channels"), F.min("c.channel").alias("first"), F.max("c.channel").alias("last"))


_KEEP = f"""WITH c AS (SELECT subject, modality, channel, min(seq) AS seq FROM {_SUBJ} WHERE type = 'image' GROUP BY ALL), m AS (SELECT subject, modality, min(seq) AS seq FROM c GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY seq) AS place FROM m)
SELECT subject, modality, count(*) AS channels, min(channel) AS first, max(channel) AS last FROM c JOIN n USING (subject, modality) WHERE place > 1 OR channel IN ('c0', 'c2') GROUP BY ALL"""


def _listed(spark, sf_dir):
    """Records in folders of their own, and the files that exist: every third lacks one, every fourth names none."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("/d"), F.col("event_id") % 7, F.lit("/r"), F.col("event_id"), F.lit(".json")).alias("file"))
    rows = e.withColumn("pth", F.when(F.col("seq") % 4 == 0, "").when(F.col("seq") % 4 == 1, F.concat(F.lit("/abs/"), F.col("seq"), F.lit(".nii"))).otherwise(F.concat(F.lit("x"), F.col("seq"), F.lit(".img"))))
    folder = F.concat(F.lit("/d"), F.col("seq") % 7, F.lit("/"))
    there = F.when(F.col("seq") % 4 == 0, F.concat(folder, F.lit("r"), F.col("seq"), F.when(F.col("seq") % 8 == 0, ".nii.gz").otherwise(".img"))).when(F.col("seq") % 4 == 1, F.col("pth")).otherwise(F.concat(folder, F.col("pth")))
    return rows, rows.where("seq % 3 <> 0").select(there.alias("path"))


def cat_paths(spark, sf_dir):
    """Absolute paths of records, '' where no file is there, and the bare names of those that lie beside their record."""
    rows, files = _listed(spark, sf_dir)
    found = catalog.resolve_paths(rows, files)
    return found.select("seq", F.col("pth").alias("path")).join(catalog.relative_paths(found, files).select("seq", F.col("pth").alias("relative")), "seq")


_PATHS = """WITH e AS (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 4 = 0 THEN '/d' || event_id % 7 || '/r' || event_id || CASE WHEN event_id % 8 = 0 THEN '.nii.gz' ELSE '.img' END
 WHEN event_id % 4 = 1 THEN '/abs/' || event_id || '.nii' ELSE '/d' || event_id % 7 || '/x' || event_id || '.img' END AS path FROM events)
SELECT seq, path, CASE WHEN path LIKE '/d%' THEN regexp_extract(path, '[^/]+$') ELSE path END AS relative FROM e"""


def cat_image_dimension(spark, sf_dir):
    return catalog.image_dimension(headers(spark, sf_dir))


# mixtures ----------------------------------------------------------------------------------------------------
def _statistics(spark, sf_dir):
    """Sufficient statistics by pattern, as the fit holds them."""
    z = gmm.score(gaps(spark, sf_dir), COLS, MODEL)
    out = {}
    for row in gmm.suffstats(z, COLS, [F.get("z", F.lit(0)), F.get("z", F.lit(1))]).collect():  # a row a pattern
        s2 = np.zeros((2, 3, 3))
        for k in range(2):
            for i in range(3):
                for j in range(i, 3):
                    s2[k, i, j] = s2[k, j, i] = row[f"s2_{k}_{i}_{j}"] or 0.0
        out[row["code"]] = [np.array([row[f"s0_{k}"] for k in range(2)]), np.array([[row[f"s1_{k}_{i}"] or 0.0 for i in range(3)] for k in range(2)]), s2]
    return out


def gmm_complete(spark, sf_dir):
    """Statistics of all channels: what is missing by its conditional moments."""
    s0, s1, s2 = gmm.complete(_statistics(spark, sf_dir), MODEL.mu, MODEL.A)
    rows = [(k, float(s0[k]), *map(float, s1[k]), *(float(s2[k, i, j]) for i in range(3) for j in range(i, 3))) for k in range(2)]
    names = ["s0", *(f"s1_{i}" for i in range(3)), *(f"s2_{i}_{j}" for i in range(3) for j in range(i, 3))]
    return spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names)).select("k", *(r(F.col(n) / 1e4).alias(n) for n in names))


def _complete_sql():
    """By covariance blocks: the mean of what is missing, and its covariance given the rest, for each pattern."""
    parts = []
    for k in range(2):
        cov, mu = np.linalg.inv(MODEL.A[k]), MODEL.mu[k]
        means, extra = [[] for _ in range(3)], {}
        for code in range(1, 8):
            o, m = gmm.split(code, 3)
            gain = cov[np.ix_(m, o)] @ np.linalg.inv(cov[np.ix_(o, o)])
            left = cov[np.ix_(m, m)] - gain @ cov[np.ix_(o, m)]
            for n, c in enumerate(m):
                means[c].append(f"WHEN {code} THEN {float(mu[c])!r}" + "".join(f" + ({float(gain[n, q])!r}) * ({COLS[x]} - {float(mu[x])!r})" for q, x in enumerate(o)))
                for q, x in enumerate(m):
                    extra.setdefault((c, x), []).append(f"WHEN {code} THEN {float(left[n, q])!r}")
        y = ", ".join(f"coalesce({COLS[c]}, CASE code {' '.join(means[c])} END) AS y{c}" for c in range(3))
        cols = [f"{rs(f'sum(z{k}) / 1e4')} AS s0"] + [f"{rs(f'sum(z{k} * y{c}) / 1e4')} AS s1_{c}" for c in range(3)]
        cols += [f"{rs(f'sum(z{k} * (y{i} * y{j} + CASE code {chr(32).join(extra[i, j])} ELSE 0 END)) / 1e4')} AS s2_{i}_{j}" for i in range(3) for j in range(i, 3)]
        parts.append(f"SELECT {k}::INT AS k, {', '.join(cols)} FROM (SELECT *, {y} FROM s)")
    return f"WITH s AS ({_scored_sql(MODEL)}) {' UNION ALL '.join(parts)}"


def gmm_marginal_sum(spark, sf_dir):
    """The expected log-likelihood of all rows, from statistics alone."""
    return spark.createDataFrame([(gmm.marginal_sum(_statistics(spark, sf_dir), MODEL),)], "total double").select(r(F.col("total") / 1e4).alias("total"))


def _marginal_sql():
    case = lambda k: "CASE code " + " ".join(f"WHEN {c} THEN {_logp_sql(MODEL, c, k)}" for c in range(8)) + " END"
    return f"SELECT {rs(f'sum(z0 * ({case(0)}) + z1 * ({case(1)})) / 1e4')} AS total FROM ({_scored_sql(MODEL)})"


def _kinds(spark, sf_dir):
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("double") * (1 + line % 3)).alias("q"), F.col("l_discount").cast("double").alias("d"), (line % 4).alias("kind"))


def gmm_collapse(spark, sf_dir):
    """Four clusters by line number as two: their moments are those of the rows of both."""
    m = gmm.collapse_gaussians(gmm.label_start(_kinds(spark, sf_dir), ["q", "d"], "kind"), [0, 1, 1, 0])
    cov = np.linalg.inv(m.A)
    rows = [(k, *map(float, m.mu[k]), float(cov[k, 0, 0]), float(cov[k, 0, 1]), float(cov[k, 1, 1]), float(np.exp(m.logpi[k]))) for k in range(2)]
    return spark.createDataFrame(rows, "k int, q double, d double, qq double, qd double, dd double, pi double").select("k", *(r(c, half=OFF).alias(c) for c in ("q", "d", "qq", "qd", "dd", "pi")))


_COLLAPSE = f"""SELECT k, {rs('avg(q)', half=OFF)} AS q, {rs('avg(d)', half=OFF)} AS d, {rs('var_pop(q)', half=OFF)} AS qq, {rs('covar_pop(q, d)', half=OFF)} AS qd, {rs('var_pop(d)', half=OFF)} AS dd, {rs('count(*) / (SELECT count(*) FROM lineitem)', half=OFF)} AS pi
FROM (SELECT l_quantity::DOUBLE * (1 + l_linenumber % 3) AS q, l_discount::DOUBLE AS d, CASE WHEN l_linenumber % 4 IN (1, 2) THEN 1 ELSE 0 END::INT AS k FROM lineitem) GROUP BY k"""


def gmm_row_proportions(spark, sf_dir):
    """Each row with proportions of its own."""
    share = 0.1 + 0.2 * (F.col("l_linenumber") % 4)
    rows = gaps(spark, sf_dir).withColumns({"p0": F.log(share), "p1": F.log(1 - share)})
    z = gmm.score(rows, COLS, MODEL, row_logpi=["p0", "p1"])
    return z.groupBy("l_linenumber").agg(r(F.sum(F.get("z", F.lit(0))) / 1000).alias("mass"), r(F.sum("log_evidence") / 1e4).alias("evidence"))


def _row_sql():
    case = lambda k: "CASE code " + " ".join(f"WHEN {c} THEN {_logp_sql(MODEL, c, k)}" for c in range(8)) + " END"
    share = "(0.1e0 + 0.2e0 * (l_linenumber % 4))"
    return f"SELECT l_linenumber, {rs('sum(a / (a + b)) / 1000')} AS mass, {rs('sum(ln(a + b)) / 1e4')} AS evidence FROM (SELECT l_linenumber, {share} * exp({case(0)}) AS a, (1 - {share}) * exp({case(1)}) AS b FROM ({_scored_sql(MODEL)})) GROUP BY l_linenumber"


# images ------------------------------------------------------------------------------------------------------
def reference_images(spark, sf_dir):
    """The header of the smallest voxels and the one of the largest field of view."""
    g = lattice.header_geometry(headers(spark, sf_dir)).select(F.col("p_brand").alias("name"), *(F.get("vs", F.lit(n)).alias(f"vx{n + 1}") for n in range(3)), *(F.get("dim", F.lit(n)).alias(f"d{n + 1}") for n in range(3)))
    one = lambda rule: lattice.reference_image(g, rule).select(F.lit(rule).alias("rule"), "name")
    return one("smallest_voxel").union(one("largest_fov"))


_REFERENCE = f"WITH h AS (SELECT p_brand AS name, round(z0 * z1 * z2, 9) AS v, d0 * d1 * d2 AS n FROM {_HEADERS}) SELECT 'smallest_voxel' AS rule, arg_min(name, (v, name)) AS name FROM h UNION ALL SELECT 'largest_fov', arg_min(name, (-v * n, name)) FROM h"


def non_finite(spark, sf_dir):
    """Quotients of the volume: what is infinite or no number is missing."""
    v = volume(spark, sf_dir).withColumn("q", F.expr("CASE WHEN i = 2 THEN double('infinity') WHEN j = 3 THEN double('-infinity') WHEN k = 4 THEN double('nan') ELSE v END"))
    some, all_of = observations.canonical(v, ["q"]), observations.canonical(v, ["q"], finite=True)
    return some.select("i", "j", "k", F.col("q").isNull().alias("no_number")).join(all_of.select("i", "j", "k", r("q").alias("v")), ["i", "j", "k"])


_FINITE = f"SELECT i, j, k, i <> 2 AND j <> 3 AND k = 4 AS no_number, CASE WHEN i <> 2 AND j <> 3 AND k <> 4 THEN {rs('v')} END AS v FROM {_FULL}"

QUERIES = {
    "cat_merge": cat_merge, "cat_keep_channels": cat_keep_channels, "cat_paths": cat_paths, "cat_image_dimension": cat_image_dimension,
    "gmm_complete": gmm_complete, "gmm_marginal_sum": gmm_marginal_sum, "gmm_collapse": gmm_collapse, "gmm_row_proportions": gmm_row_proportions,
    "reference_images": reference_images, "non_finite": non_finite,
}
ORACLE = {
    "cat_merge": _MERGE, "cat_keep_channels": _KEEP, "cat_paths": _PATHS,
    "cat_image_dimension": f"SELECT CASE WHEN min(d2) > 1 THEN 3 ELSE 2 END::INT AS dimension FROM {_HEADERS}",
    "gmm_complete": _complete_sql(), "gmm_marginal_sum": _marginal_sql(), "gmm_collapse": _COLLAPSE, "gmm_row_proportions": _row_sql(),
    "reference_images": _REFERENCE, "non_finite": _FINITE,
}
