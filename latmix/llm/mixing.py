"""Mixing sources to target weights by a low-discrepancy schedule.

1. Documents of a source are shuffled by the MD5 of their id (of their text where there is none) and,
   within an id, by that of their text, and laid end to end; the line of words
   is cut into blocks of equal length (within one word), LEAST_BLOCK words at most, whatever the size
   of the corpus: a small source has as many blocks beside a large one as alone.
2. Targets: the sources' shares of all words by weight, none over CAP times its size; what a full
   source leaves is shared among the others by weight.
3. Slot n of the schedule is the golden-ratio point frac((n + 1) * 0.618...), which falls into one
   source's part of the cumulative demand. Slots are ranked per source; the slot of rank r takes the
   source's block r mod (number of blocks).
4. Blocks are joined with the documents that lie in them; a document's words are counted as often as
   its blocks are taken.

Running sums are two-level (by bucket of the hash, by chunk of slots), so that no window holds a hot
source whole. Reruns agree: nothing depends on partitioning. Only DataFrame functions run here.

Null text, or no words: size 0, taken 0. A null source is a source, ordered last. Repeated rows are
documents of their own. An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import WORD, Scratch, row_digest, table, text_or_empty, unused

WEIGHTS = (5, 2, 1)
CAP = 3
LEAST_BLOCK = 16
GOLDEN = 0.6180339887498949
CHUNK, CELLS = 4096, 4096


def sized(docs: DataFrame, rid: Column | None = None, tie: Column | None = None) -> DataFrame:
    """(rid, doc_id, source, size, h, digest, tie, bucket): size in words; h, digest and tie order a source's documents."""
    digest = F.md5(text_or_empty())
    return docs.select(
        (F.monotonically_increasing_id() if rid is None else rid).alias("rid"),
        "doc_id",
        "source",
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), digest)).alias("h"),
        digest.alias("digest"),
        (F.lit("") if tie is None else tie).alias("tie"),
    ).withColumn("bucket", F.substring("h", 1, 3))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(sid, source, source_size, target): one row per source. sizes: (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("sid", F.row_number().over(by_name) - 1).withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")
    )
    fill = W.orderBy((F.lit(1.0) * cap * F.col("source_size") / F.col("w")), "sid")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    full = cap * F.col("source_size")
    level = (
        ranked.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0)))
        .withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("place", F.row_number().over(fill))
        .withColumn("open", F.col("rest") * F.col("w") < full * F.col("rest_w"))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct("place", "rest", "rest_w"))).over(every))
    )
    share = (F.col("w") * F.col("first.rest")).cast("double") / F.col("first.rest_w").cast("double")
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), full.cast("double")).otherwise(share)
    return level.select("sid", "source", "source_size", target.alias("target"))


def schedule(spark: SparkSession, plan: DataFrame, slots: int) -> DataFrame:
    """(sid, block, times) of the blocks that the schedule takes. plan: (sid, blocks, low, high, total)."""
    cut = F.floor(F.col("low") / F.col("total") * CELLS), F.floor(F.col("high") / F.col("total") * CELLS)
    parts = plan.where("high > low").withColumn("cell", F.explode(F.sequence(*cut)))
    x = (F.col("id") + 1) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("n"), (x - F.floor(x)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS)).withColumn("chunk", F.expr(f"n div {CHUNK}"))
    at = F.col("x") * F.col("total")
    placed = points.join(parts, "cell").where((at >= F.col("low")) & (at < F.col("high"))).select("n", "chunk", "sid", "blocks")
    counts = placed.groupBy("sid", "chunk").agg(F.count("*").alias("c"))
    base = counts.select("sid", "chunk", (F.sum("c").over(W.partitionBy("sid").orderBy("chunk")) - F.col("c")).alias("base"))
    rank = F.row_number().over(W.partitionBy("sid", "chunk").orderBy("n")) - 1
    ranked = placed.withColumn("r", rank).join(base, ["sid", "chunk"]).withColumn("r", F.col("r") + F.col("base"))
    # one more than CAP rounds can only come from the schedule's rounding
    return ranked.where(F.col("r") < CAP * F.col("blocks")).groupBy("sid", (F.col("r") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))


def block_of(p: str) -> Column:
    """The block that word p of a source lies in. The product of words and blocks may pass a long."""
    return F.expr(f"(cast({p} AS decimal(19, 0)) * blocks + blocks - 1) div source_size")


def block_edge(k: str) -> Column:
    """The first word of block k: floor(k * source_size / blocks)."""
    return F.expr(f"(cast({k} AS decimal(19, 0)) * source_size) div blocks")


def mix(spark: SparkSession, docs: DataFrame, rid: Column | None = None, tie: Column | None = None) -> DataFrame:
    """(rid, doc_id, size, source_size, target, taken), a row for each row of docs."""
    scratch = Scratch(spark, "mix")
    rows = scratch.keep(sized(docs, rid, tie), "sized")
    goal = targets(rows.select("source", "size"))
    blocks = F.expr(f"(source_size + {LEAST_BLOCK - 1}) div {LEAST_BLOCK}")
    demand = F.col("target") * F.col("blocks") / F.col("source_size")
    run = W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)
    plan = goal.withColumn("blocks", blocks).withColumn("d", F.when(F.col("source_size") > 0, demand).otherwise(0.0))
    plan = plan.withColumn("high", F.sum("d").over(run)).withColumn("low", F.coalesce(F.lag("high").over(W.orderBy("sid")), F.lit(0.0)))
    plan = scratch.keep(plan.withColumn("total", F.sum("d").over(W.partitionBy())), "plan")
    slots = plan.agg(F.coalesce(F.floor(F.max("total") + 0.5), F.lit(0))).head()[0]
    times = schedule(spark, plan.select("sid", "blocks", "low", "high", "total"), int(slots))

    key = lambda df: [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), *(c for c in df.columns if c != "source")]
    known = plan.select("source", "sid", "source_size", "target", "blocks")
    rows = rows.select(*key(rows)).join(known.select(*key(known)), ["no_source", "source_key"])
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    starts = sums.select("sid", "bucket", (F.sum("s").over(W.partitionBy("sid").orderBy("bucket")) - F.col("s")).alias("start"))
    order = W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "digest", "tie", "rid").rowsBetween(W.unboundedPreceding, 0)
    lines = rows.withColumn("own", F.sum("size").over(order) - F.col("size")).join(starts, ["sid", "bucket"])
    lines = lines.withColumn("begin", F.col("start") + F.col("own")).withColumn("end", F.col("begin") + F.col("size"))
    pieces = lines.where("size > 0").withColumn("block", F.explode(F.sequence(block_of("begin"), block_of("end - 1"))))
    pieces = pieces.withColumn("n", F.least("end", block_edge("block + 1")) - F.greatest("begin", block_edge("block"))).where("n > 0")
    got = pieces.join(times, ["sid", "block"]).groupBy("rid").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    return lines.select("rid", "doc_id", "size", "source_size", "target").join(got, "rid", "left").fillna(0, ["taken"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents")).drop("rid")


def copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix as documents: each row as often as the mix takes its words, to the nearest whole number.

    Rows without words are no part of any block; they stay once. Rows are told apart by what they hold,
    so the choice does not follow partitions; other columns are kept whatever their names.
    """
    rid, n, i = unused(docs.columns, "rid", "n", "i")
    kept = Scratch(spark, "mixed").keep(docs.withColumn(rid, F.monotonically_increasing_id()), "input")
    tie = row_digest(kept.select(*(F.col(f"`{c}`") for c in docs.columns)))
    taken = mix(spark, kept.select(F.col(rid).alias("rid"), "doc_id", "source", "text", tie.alias("tie")), F.col("rid"), F.col("tie"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    times = taken.select(F.col("rid").alias(rid), times.alias(n)).where(F.col(n) > 0)
    repeated = kept.join(times, rid).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h, md5(coalesce(text, '')) AS digest FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM p),
f AS (SELECT *, row_number() OVER o AS place,
             (sum(source_size) OVER () - coalesce(sum({CAP} * source_size) OVER b, 0))::BIGINT AS rest,
             (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS rest_w
      FROM w WINDOW o AS (ORDER BY {CAP}::DOUBLE * source_size / w, sid),
                    b AS (ORDER BY {CAP}::DOUBLE * source_size / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min(place) AS place, arg_min(rest, place) AS rest, arg_min(rest_w, place) AS rest_w FROM f WHERE rest * w < {CAP} * source_size * rest_w),
g AS (SELECT f.sid, f.source, source_size, CASE WHEN l.place IS NULL OR f.place < l.place THEN ({CAP} * source_size)::DOUBLE
             ELSE (w * l.rest)::DOUBLE / l.rest_w::DOUBLE END AS target FROM f, l),
q AS (SELECT g.*, (source_size + {LEAST_BLOCK - 1}) // {LEAST_BLOCK} AS blocks FROM g),
q2 AS (SELECT *, CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0 END AS dem FROM q),
q3 AS (SELECT *, sum(dem) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) AS high, sum(dem) OVER () AS total FROM q2),
q4 AS (SELECT *, coalesce(lag(high) OVER (ORDER BY sid), 0) AS low FROM q3),
n AS (SELECT unnest(range(0, (SELECT coalesce(floor(max(total) + 0.5), 0)::BIGINT FROM q4))) AS n),
x AS (SELECT n, (n + 1) * {GOLDEN!r}::DOUBLE - floor((n + 1) * {GOLDEN!r}::DOUBLE) AS x FROM n),
s AS (SELECT n, sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY n) - 1 AS r FROM x JOIN q4 ON x.x * q4.total >= q4.low AND x.x * q4.total < q4.high),
t AS (SELECT sid, r % blocks AS block, count(*) AS times FROM s WHERE r < {CAP} * blocks GROUP BY 1, 2),
e AS (SELECT d.rid, d.doc_id, d.size, q4.sid, q4.source_size, q4.target, q4.blocks,
             (sum(d.size) OVER (PARTITION BY q4.sid ORDER BY h, doc_id, digest, rid ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
      FROM d JOIN q4 ON d.source IS NOT DISTINCT FROM q4.source),
k AS (SELECT rid, sid, stop - size AS begin, stop, blocks, source_size,
             unnest(range(((stop - size) * blocks + blocks - 1) // source_size, ((stop - 1) * blocks + blocks - 1) // source_size + 1)) AS block FROM e WHERE size > 0),
o AS (SELECT rid, sid, block, least(stop, (block + 1) * source_size // blocks) - greatest(begin, block * source_size // blocks) AS m FROM k),
y AS (SELECT rid, sum(m * times)::BIGINT AS taken FROM o JOIN t USING (sid, block) WHERE m > 0 GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM e LEFT JOIN y USING (rid)"""

QUERIES = {"op10_mixing": op10_mixing}
ORACLE = {"op10_mixing": ORACLE_SQL}
