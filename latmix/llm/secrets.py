"""Secret scans over a content-addressed blob ledger.

Every version of every path is addressed by the SHA-256 of its text. A blob is scanned once for
each version of the rules: pairs (blob, rule version) that the ledger holds are not scanned again,
and new findings are appended to it. Findings are then joined back to all paths of the blob.

Only DataFrame functions run here. Texts travel once, keyed by their address, after copies within a
task have been merged; copies of one text, however many, therefore meet as one row a task. The join
back moves addresses and findings only, both sides by an exchange that AQE may split at hot blobs.
``redact`` passes rows by in which no rule matches at all, and moves the others only.

A blob that two runs over one ledger wrote twice counts once. Null or empty text: the empty blob, no
findings; ``redact`` leaves it as it is. Repeated rows: each gets its findings. An empty table: no
rows. Columns other than the path and the text are ignored, ``redact`` keeps them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, table, text_or_empty, unused
from .spans import by_start, joined, labelled, matches

#: Kinds in the order in which equal starts are listed. Java patterns; (?i) there folds ASCII only.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs under 32 characters can't pass, and a run of 32 needs no other test; this pattern never retries.
LONG_HEX = r"(?:(?<![0-9a-f])|\G)[0-9a-f]{32,}+"
RULES = "base-1"
FINDINGS = "blob string, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(blobs: DataFrame, rules: str = RULES) -> DataFrame:
    """Findings of each (blob, text) row; the text is not kept."""
    t = F.col("text")
    found = blobs.select(
        "blob",
        F.filter(matches(t, ASSIGN, 2), lambda m: F.length(m["part"]) >= 8).alias("assign"),
        F.filter(matches(t, ACCESS), lambda m: F.length(m["hit"]) >= 16).alias("access"),
        matches(t, LONG_HEX).alias("hex"),
    )
    spans = by_start(F.concat(labelled("assign", 0, F.col("assign")), labelled("access", 1, F.col("access")), labelled("hex", 2, F.col("hex"))))
    text = joined(spans)
    return found.select(
        "blob",
        F.lit(rules).alias("rules"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(text, 256).alias("base_sha256"),
        text.alias("spans"),
    )


def update_ledger(spark: SparkSession, versions: DataFrame, ledger: str, rules: str = RULES) -> DataFrame:
    """Scans what the ledger (a Parquet folder, may be missing) has not seen under these rules.

    versions: (path, blob, text). Returns the ledger's findings under these rules.
    """
    texts = versions.groupBy("blob").agg(F.first("text").alias("text"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        seen = spark.read.schema(FINDINGS).parquet(ledger).where(F.col("rules") == rules).select("blob").distinct()
        # before the texts meet: seen blobs don't travel
        texts = versions.join(seen, "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    scan(texts, rules).write.mode("append").parquet(ledger)
    # two runs at once may both have written a blob
    return spark.read.schema(FINDINGS).parquet(ledger).where(F.col("rules") == rules).dropDuplicates(["blob"])


def address(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, text) of each row; a null text is the empty blob."""
    return docs.select(F.col(path).alias("path"), text_or_empty(text).alias("text")).select("path", F.sha2("text", 256).alias("blob"), "text")


def scan_documents(spark: SparkSession, docs: DataFrame, ledger: str | None = None, rules: str = RULES) -> DataFrame:
    """One row per row of docs: doc_id, counts by kind, digest and spans."""
    versions = address(docs)
    findings = update_ledger(spark, versions, ledger or Scratch(spark, "secrets").path("ledger"), rules)
    back = versions.select(F.col("path").alias("doc_id"), "blob").join(findings.drop("rules"), "blob")
    return back.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def redact(spark: SparkSession, docs: DataFrame, mark: str = "[secret]", ledger: str | None = None) -> DataFrame:
    """Replaces every secret in the text by a mark; documents without secrets stay as they are."""
    blob, found, whole = unused([*docs.columns, "text"], "blob", "spans", "whole")
    some = F.coalesce(F.col("text").rlike(f"{ASSIGN}|(?-i:{ACCESS})|(?-i:{LONG_HEX})"), F.lit(False))
    scratch = Scratch(spark, "secrets")
    suspects = scratch.keep(docs.where(some).withColumn(blob, F.sha2("text", 256)), "suspects")
    findings = update_ledger(spark, suspects.select(F.lit(0).alias("path"), F.col(blob).alias("blob"), "text"), ledger or scratch.path("ledger"))
    marked = findings.where("spans <> ''").select(F.col("blob").alias(blob), F.col("spans").alias(found))
    span = F.transform(F.split(found, ","), lambda s: F.transform(F.slice(F.split(s, ":"), 2, 2), lambda x: x.cast("int")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        # spans of two kinds may overlap: what is already marked is passed over
        begin, end = s[0], s[1]
        kept = F.when(begin > acc["at"], F.col(whole).substr(acc["at"] + 1, begin - acc["at"])).otherwise("")
        sign = F.when(begin >= acc["at"], F.lit(mark)).otherwise("")
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["out"], F.array(F.concat(kept, sign))).alias("out"))

    done = F.aggregate(span, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.col(whole).substr(acc["at"] + 1, F.length(whole))))
    clean = F.when(F.col(found).isNull(), F.col(whole)).otherwise(done)
    rows = suspects.join(marked, blob, "left").withColumnRenamed("text", whole).withColumn("text", clean)
    return docs.where(~some).unionByName(rows.select(*(F.col(f"`{c}`") for c in docs.columns)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark, table(spark, sf_dir, "documents"))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _oracle() -> str:
    words = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
    assign = rf"""({words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

    def part(kind, order, pattern, group, least):
        return f"""
        SELECT rid, '{kind}' AS kind, {order} AS ord, s AS start, s + length(hits[i]) AS stop
        FROM (SELECT rid, i, hits, parts, list_sum([length(p) FOR p IN gaps[1:i]])::BIGINT + coalesce(list_sum([length(h) FOR h IN hits[1:i-1]]), 0)::BIGINT AS s
              FROM (SELECT rid, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i
                    FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS parts, string_split_regex(t, '{pattern}') AS gaps FROM d)))
        WHERE length(parts[i]) >= {least}"""

    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({part("assign", 0, assign, 2, 8)} UNION ALL {part("access", 1, ACCESS, 0, 16)} UNION ALL {part("hex", 2, HEX, 0, 32)}),
    g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM s GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (rid)"""


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE = {"op2_secret_scan": _oracle()}
