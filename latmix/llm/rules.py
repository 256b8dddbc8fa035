"""Quality rules whose cuts are learned from the corpus, per language and source.

Every text is measured once: words, their characters, symbols, repeated lines, words in repeated
three-word windows. Two fixed rules come first (``base_failed``). Of the texts that pass them four
shares are taken (RULES), and for each language and source a quantile sketch of each share is built: a
count for every value, where values from 64 on share a bucket with those that agree in their first six
bits (an error of 1/32 at most). Sketches are merged by adding counts, so they don't depend on how rows
are dealt and any group's sketch is the sum of its parts: a group of fewer than LEAST texts takes the
merged sketch of its language, and if that is small too that of all. The cuts are fences: the quartiles,
FENCE times their distance further out, the distance being at least the rule's WIDTH. They are joined
to the measures by language and source, and what lies beyond one is not kept.

Only DataFrame functions run here. A hot language or source is pre-aggregated: a task sends one row for
a bucket. Measures are written once and hold no text; the cuts are one row a language and source.

Windows within a text are compared as strings; texts of any length are measured whole, in time
n log n. Null and empty texts have no words and fail the base rules. A null language or source is a
group like others. Repeated rows are measured and counted each. An empty table: no rows. Columns
other than those named are ignored; ``keep_good`` keeps them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import Scratch, table, text_or_empty, unused
from .spans import let

SPACE, A_WORD, NO_SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[^#*$%&|<>]+"
LEAST_WORDS, MOST_REPEATED = 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shares in whole numbers: name, numerator, denominator, scale, least distance of the quartiles.
RULES = [
    ("word_length", "word_chars", "n_words", 100, 50),
    ("symbols", "n_symbols", "n_words", 1000, 50),
    ("dup_lines", "n_dup_lines", "n_lines", 1000, 100),
    ("repeats", "n_repeat_words", "n_words", 1000, 100),
]
LEAST, FENCE = 200, 4


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""
    n = F.size(words)
    windows = F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)))

    def places(ws):
        """Where repeated windows begin: equal ones are neighbours once they are sorted."""
        by_text = F.array_sort(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        text = lambda s, i: F.get(s, i)["w"]
        same = lambda s: F.filter(s, lambda x, i: (x["w"] == F.coalesce(F.when(i > 0, text(s, i - 1)), F.lit(""))) | (x["w"] == F.coalesce(text(s, i + 1), F.lit(""))))
        return F.array_sort(F.transform(let(by_text, same), lambda x: x["i"]))

    def covered(at):
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), 0).otherwise(let(places(ws), covered)))


def measures(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (with a word), all long."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(A_WORD))
    of_words = let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).cast("long").alias("r")))
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("d")))
    length = lambda t, pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    return [of_words.alias("of_words"), of_lines.alias("of_lines"), length(text, SPACE).alias("word_chars"), length(text, NO_SYMBOL).alias("n_symbols")]


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep``, lang, source, the counts, n_lines and base_failed."""
    rows = docs.select(*keep, F.col("lang").alias("_lang"), F.col("source").alias("_source"), *measures(text_or_empty()))
    rows = rows.select(
        *keep, "_lang", "_source", F.col("of_words.n").alias("n_words"), "word_chars", "n_symbols",
        F.col("of_lines.d").alias("n_dup_lines"), F.col("of_words.r").alias("n_repeat_words"), F.col("of_lines.n").alias("n_lines"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def shares() -> list[tuple[str, Column]]:
    return [(name, F.expr(f"{scale} * {top} div greatest({below}, 1)")) for name, top, below, scale, _ in RULES]


def bucket(value: Column) -> Column:
    """The least value of the bucket."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rows: DataFrame) -> DataFrame:
    """(_lang, _source, rule, value, n): the buckets of each group's sketches, of texts that pass the base rules."""
    entries = F.array(*(F.struct(F.lit(name).alias("rule"), bucket(x).alias("value")) for name, x in shares()))
    return rows.where(~F.col("base_failed")).select("_lang", "_source", F.inline(entries)).groupBy("_lang", "_source", "rule", "value").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Sketches of larger groups: counts are added."""
    return parts.groupBy(*by, "rule", "value").agg(F.sum("n").alias("n"))


def fences(parts: DataFrame, *by: str) -> DataFrame:
    """(by, n, low_<rule>, high_<rule>...): the group's size and the fences of its sketches."""
    w = W.partitionBy(*by, "rule")
    ranked = parts.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("all", F.sum("n").over(w))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("value")))
    quartiles = ranked.groupBy(*by, "rule").agg(F.max("all").alias("n"), at(1).alias("q1"), at(3).alias("q3"))
    cols = [F.max("n").alias("n")]
    for name, *_, width in RULES:
        spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(width))
        cols += [F.max(F.when(F.col("rule") == name, F.col("q1") - spread)).alias(f"low_{name}"), F.max(F.when(F.col("rule") == name, F.col("q3") + spread)).alias(f"high_{name}")]
    return quartiles.groupBy(*by).agg(*cols)


def cuts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a language and source that has a text: _lang, _source and the fences that hold there. A written table."""
    parts = scratch.keep(sketches(rows), "sketches")
    by_lang, whole = merged(parts, "_lang"), merged(parts)
    limits = [f"{side}_{name}" for name, *_ in RULES for side in ("low", "high")]
    renamed = lambda df, p: df.select(*(F.col(c).alias(f"{p}{c}") for c in df.columns))
    a, b, c = renamed(fences(parts, "_lang", "_source"), "a"), renamed(fences(by_lang, "_lang"), "b"), renamed(fences(whole), "c")
    groups = rows.select("_lang", "_source").distinct()
    wide = groups.join(a, F.col("_lang").eqNullSafe(F.col("a_lang")) & F.col("_source").eqNullSafe(F.col("a_source")), "left")
    wide = wide.join(b, F.col("_lang").eqNullSafe(F.col("b_lang")), "left").join(F.broadcast(c), F.lit(True), "left")  # c is one row
    pick = lambda x: F.when(F.col("an") >= LEAST, F.col(f"a{x}")).when(F.col("bn") >= LEAST, F.col(f"b{x}")).otherwise(F.col(f"c{x}"))
    return scratch.keep(wide.select(F.col("_lang").alias("_lang2"), F.col("_source").alias("_source2"), *(pick(x).alias(x) for x in limits)), "cuts")


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows and kept."""
    near = rows.join(limits, F.col("_lang").eqNullSafe(F.col("_lang2")) & F.col("_source").eqNullSafe(F.col("_source2")), "left")
    inside = F.lit(True)
    for name, x in shares():
        inside &= x.between(F.col(f"low_{name}"), F.col(f"high_{name}"))
    return near.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def verdicts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row."""
    scratch = Scratch(spark, "rules")
    rows = scratch.keep(measured(docs, "doc_id"), "measures")
    return judged(rows, cuts(rows, scratch)).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    scratch = Scratch(spark, "rules")
    whole, = unused([*docs.columns, "lang", "source", "text", *COUNTS], "whole")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), "lang", "source", "text")
    measures_only = scratch.keep(measured(docs.select("lang", "source", "text")), "measures")
    limits = cuts(measures_only, scratch)
    kept = judged(measured(packed, whole), limits).where("kept")
    scratch.drop("measures", "sketches")
    return kept.select(f"{whole}.*")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, table(spark, sf_dir, "documents"))


def _oracle() -> str:
    share = [(name, f"({scale} * {top} // greatest({below}, 1))", width) for name, top, below, scale, width in RULES]
    entries = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS rule, {x} AS x FROM m WHERE NOT base_failed" for name, x, _ in share)
    limits = ", ".join(
        f"max(CASE WHEN rule = '{name}' THEN q1 - {FENCE} * greatest(q3 - q1, {width}) END) AS low_{name}, max(CASE WHEN rule = '{name}' THEN q3 + {FENCE} * greatest(q3 - q1, {width}) END) AS high_{name}"
        for name, _, width in share
    )

    def fence(name, by):
        keys = "".join(f"{k}, " for k in by)
        group = f"GROUP BY {', '.join(by)}" if by else ""
        return f"""sums_{name} AS (SELECT {keys}rule, value, sum(n) AS n FROM s GROUP BY {keys}rule, value),
        quarters_{name} AS (SELECT {keys}rule, max(whole) AS n, min(CASE WHEN 4 * upto >= whole THEN value END) AS q1, min(CASE WHEN 4 * upto >= 3 * whole THEN value END) AS q3
               FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}rule ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {keys}rule) AS whole FROM sums_{name}) GROUP BY {keys}rule),
        {name} AS (SELECT {keys}max(n) AS n, {limits} FROM quarters_{name} {group})"""

    inside = " AND ".join(
        f"{x} BETWEEN CASE WHEN a.n >= {LEAST} THEN a.low_{name} WHEN b.n >= {LEAST} THEN b.low_{name} ELSE c.low_{name} END AND CASE WHEN a.n >= {LEAST} THEN a.high_{name} WHEN b.n >= {LEAST} THEN b.high_{name} ELSE c.high_{name} END"
        for name, x, _ in share
    )
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    v AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{A_WORD}')) AS ls FROM d),
    g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM v WHERE len(ws) >= 3)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM g) WHERE n > 1),
    r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
    m AS (SELECT rid, doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed
          FROM (SELECT rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '{NO_SYMBOL}', '', 'g'))::BIGINT AS n_symbols,
                       (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM v LEFT JOIN r USING (rid))),
    e AS ({entries}),
    s AS (SELECT lang, source, rule, value, count(*)::BIGINT AS n FROM (SELECT lang, source, rule, (x >> greatest(length(bin(x)) - 6, 0)) * (1::BIGINT << greatest(length(bin(x)) - 6, 0)) AS value FROM e) GROUP BY lang, source, rule, value),
    {fence("a", ["lang", "source"])}, {fence("b", ["lang"])}, {fence("c", [])}
    SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, false) AS kept
    FROM m LEFT JOIN a ON m.lang IS NOT DISTINCT FROM a.lang AND m.source IS NOT DISTINCT FROM a.source LEFT JOIN b ON m.lang IS NOT DISTINCT FROM b.lang LEFT JOIN c ON true"""


QUERIES = {"op13_quality_rules": op13_quality_rules}
ORACLE = {"op13_quality_rules": _oracle()}
