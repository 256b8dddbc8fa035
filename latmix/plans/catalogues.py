"""Queries: the subject catalogue, on records made of events, customers and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalog
from ..streaming import scoring
from .common import r, rs, table


def recs(spark, sf_dir):
    """Customers are subjects, regions of their nation populations, event types modalities, weekdays channels."""
    e, c, n = (table(spark, sf_dir, t) for t in ("events", "customer", "nation"))
    rows = e.join(c, (e.user_id % 1000 + 1) == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.select(
        F.when(F.col("event_id") % 50 != 0, F.col("c_name")).alias("name"), F.when(F.col("n_regionkey") != 0, F.concat(F.lit("P"), F.col("n_regionkey"))).alias("population"),
        F.col("event_type").alias("modality"), F.concat(F.lit("c"), F.col("event_id") % 3).alias("channel"), F.lit(None).cast("string").alias("hospital"), F.concat(F.lit("r"), F.col("event_id") % 2).alias("rater"),
        F.lit(None).cast("string").alias("protocol"), F.concat(F.lit("t"), F.col("event_id") % 4).alias("tissue"), F.when(F.col("event_id") % 5 == 1, "label").when(F.col("event_id") % 5 == 2, "segmentation").alias("type"),
        F.concat(F.lit(" /d/"), F.col("event_id"), F.lit(".nii ")).alias("pth"), F.lit(1).alias("ix_img"), F.from_json("props", "map<string,string>").alias("open"), F.lit("f.json").alias("file"), F.col("event_id").alias("seq"),
    )


_RECS = """(SELECT CASE WHEN event_id % 50 <> 0 THEN c_name END AS name, CASE WHEN n_regionkey <> 0 THEN 'P' || n_regionkey ELSE '' END AS population, event_type AS modality, 'c' || (event_id % 3) AS channel,
 CASE WHEN event_id % 5 = 1 THEN 'label' WHEN event_id % 5 = 2 THEN 'segmentation' ELSE 'image' END AS type, 'r' || (event_id % 2) AS rater, 't' || (event_id % 4) AS tissue, props, event_id AS seq
 FROM events JOIN customer ON user_id % 1000 + 1 = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_SUBJ = f"(SELECT *, CASE WHEN population <> '' THEN population || '_' || name ELSE name END AS subject FROM {_RECS} WHERE name IS NOT NULL)"


def cat_subjects(spark, sf_dir):
    s = catalog.subjects(recs(spark, sf_dir))
    return s.select("subject", "seq", "name", "population", "records", F.coalesce(F.size("modalities"), F.lit(0)).alias("modalities"), F.coalesce(F.size("labels"), F.lit(0)).alias("labels"), F.coalesce(F.size("segmentations"), F.lit(0)).alias("segmentations"), F.try_element_at("open", F.lit("k")).alias("k"))


_CAT = f"""SELECT subject, min(seq) AS seq, arg_min(name, seq) AS name, arg_min(population, seq) AS population, count(*) AS records, (count(DISTINCT modality) FILTER (type = 'image'))::INT AS modalities,
 (count(*) FILTER (type = 'label'))::INT AS labels, (count(*) FILTER (type = 'segmentation'))::INT AS segmentations, arg_max(json_extract_string(props, '$.k'), seq) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS k FROM {_SUBJ} GROUP BY subject"""


def cat_channels(spark, sf_dir):
    s = catalog.subjects(recs(spark, sf_dir)).select("subject", F.explode("modalities").alias("m")).select("subject", "m.modality", F.explode("m.channels").alias("c"))
    return s.select("subject", "modality", F.col("c.channel").alias("channel"), F.col("c.seq").alias("seq"), F.col("c.n").alias("n"))


def cat_populations(spark, sf_dir):
    return catalog.populations(catalog.subjects(recs(spark, sf_dir))).withColumn("n_modalities", F.coalesce("n_modalities", F.lit(0)))


_POP = f"SELECT population, min(seq) AS seq, count(*) AS subjects, coalesce(arg_min(modalities, seq), 0)::INT AS n_modalities FROM ({_CAT}) GROUP BY population"


def cat_set_subjects(spark, sf_dir):
    return catalog.select_subjects(catalog.subjects(recs(spark, sf_dir)), {"P1": 3, "P2": 0}).select("subject", "population")


def cat_dimensions(spark, sf_dir):
    v = catalog.validate(recs(spark, sf_dir))
    parts = [catalog.dimension(v, c).select(F.lit(c).alias("dim"), "value", "index") for c in ("modality", "channel", "population")]
    return parts[0].union(parts[1]).union(parts[2])


def cat_json_edit(spark, sf_dir):
    rec = F.from_json("props", "map<string,string>")
    e = table(spark, sf_dir, "events").select("event_id", catalog.set_field(rec, "site", F.col("event_type")).alias("a"), catalog.rename_field(rec, "k", "key").alias("b"))
    return e.select("event_id", F.try_element_at("a", F.lit("site")).alias("site"), F.try_element_at("a", F.lit("k")).alias("k"), F.try_element_at("b", F.lit("key")).alias("renamed"))


def path_functions(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?:/", "").alias("path"), F.length("html").alias("n"))
    folder, stem, ext = catalog.file_parts(F.col("path"))
    return p.select("page_id", folder.alias("folder"), stem.alias("stem"), ext.alias("ext"), catalog.is_absolute(F.col("path")).alias("absolute"), catalog.pretty_bytes(F.col("n")).alias("bytes"))


_P = "(SELECT page_id, regexp_replace(url, '^https?:/', '') AS path, length(html) AS n FROM pages)"


def conjugate_update(spark, sf_dir):
    """The running normal update, over a table as it is over a stream."""
    return scoring.running_normal(table(spark, sf_dir, "events"), "event_type", "value", 1.0, 10.0).select("event_type", r("mu").alias("mu"), "degrees")


def windowed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s1"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", r("s1", 3).alias("s1"))


QUERIES = {"cat_subjects": cat_subjects, "cat_channels": cat_channels, "cat_populations": cat_populations, "cat_set_subjects": cat_set_subjects, "cat_dimension_tables": cat_dimensions, "cat_json_edit": cat_json_edit, "path_functions": path_functions, "stream_conjugate_update": conjugate_update, "stream_windowed_moments": windowed}
ORACLE = {
    "cat_subjects": _CAT,
    "cat_channels": f"SELECT subject, modality, channel, min(seq) AS seq, count(*)::INT AS n FROM {_SUBJ} WHERE type = 'image' GROUP BY subject, modality, channel",
    "cat_populations": _POP,
    "cat_set_subjects": f"SELECT subject, population FROM (SELECT *, row_number() OVER (PARTITION BY population ORDER BY seq) AS n FROM ({_CAT})) WHERE n <= CASE population WHEN 'P1' THEN 3 WHEN 'P2' THEN 1 ELSE 1000000000 END",
    "cat_dimension_tables": " UNION ALL ".join(f"SELECT '{c}' AS dim, value, (row_number() OVER (ORDER BY seq))::INT AS index FROM (SELECT {c} AS value, min(seq) AS seq FROM {_SUBJ} GROUP BY 1)" for c in ("modality", "channel", "population")),
    "cat_json_edit": "SELECT event_id, event_type AS site, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS renamed FROM events",
    "path_functions": f"SELECT page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext, regexp_matches(path, '^(/|[A-Za-z]:[\\\\/])') AS absolute, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN ceil(n / 1024)::BIGINT || ' KB' ELSE ceil(n / 1048576)::BIGINT || ' MB' END AS bytes FROM {_P}",
    "stream_conjugate_update": f"SELECT event_type, {rs('(10 + sum(value)) / (count(value) + 10)')} AS mu, (count(value) + 10)::DOUBLE AS degrees FROM events GROUP BY event_type",
    "stream_windowed_moments": f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, {rs('sum(value)', 3)} AS s1 FROM events GROUP BY 1, 2",
}
