"""Removal of repeated byte strings, by column-wise suffix sorting of aligned contexts.

A string of LENGTH bytes that starts at two places is removed at both. Column-wise construction over
whole documents takes one round, and one rewriting of all files, for each byte of the longest
document. So documents are first cut to what can repeat:

1. Anchors. Every LENGTH-byte string contains the least (by hash) of its GRAM-byte strings, at a place
   that its bytes alone decide: equal strings have equal anchors at equal offsets. An anchor's context
   is the bytes that strings containing it can cover. Anchors that occur once can't repeat.
2. Contexts equal as a whole repeat as a whole; one of each is kept for comparison with others. These
   are counts with partial aggregation, so a passage that very many documents share is one row a task.
3. Different contexts of one anchor are a collection of short documents of equal length, aligned at
   the anchor. It is sorted column by column from the right: a round puts one symbol before each
   suffix, sorts stably by it (the collection's Burrows-Wheeler order of that column), and updates the
   common prefixes of neighbours. Where a neighbour's common prefix reaches LENGTH, the string that
   starts there repeats. Collections are processed in blocks of bounded size, whole anchors at a time.
4. An anchor with more than BLOCK different contexts is split until no part has more. Strings that start
   in columns lo to hi all hold the bytes of columns hi to lo + LENGTH, so contexts that share one of
   them agree there: each half of the columns is a collection of its own for each value of these bytes.
   What is equal in all bytes that a half's strings cover repeats there, and one of it stands for all.
   Halves of one column hold equal strings only, so there are at most nine rounds.

Texts of which there are copies repeat entirely, and one of them stands for all.

Null or empty text: no bytes, nothing removed. Texts under LENGTH bytes: nothing removed. Repeated
rows are copies. Ids tell rows apart nowhere: a text with a null doc_id, or one of several with the same
doc_id, is a text like any other. An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, lean, table

LENGTH, GRAM = 400, 32
BACK = LENGTH - GRAM
WIDTH = BACK + LENGTH
#: Contexts sorted at once; a task holds less than twice as many. Anchors that have more are split.
BLOCK = 40_000
_B = np.uint64(0x9E3779B97F4A7C15)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of so many values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all LENGTH-byte strings in data."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    power, have = _B, 1
    with np.errstate(over="ignore"):
        while have < GRAM:
            h = h[:-have] * power + h[have:]
            power, have = power * power, 2 * have
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(32))
    low = _slide(h, BACK + 1, np.minimum)
    # a place is an anchor if its hash is the least of some string that holds it
    edge = np.zeros(BACK, np.uint64)
    high = _slide(np.concatenate([edge, low, edge]), BACK + 1, np.maximum)
    at = np.flatnonzero(high == h)
    return at, h[at]


def text_hash(data: bytes) -> int:
    """t of a text, as a signed long."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def _scan(batches):
    import pyarrow as pa
    import xxhash

    for batch in batches:
        out = {k: [] for k in ("t", "n", "sha", "pos", "anchor", "ctx")}
        for text in batch.column("text"):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            at, h = anchors(data)
            ctx = [xxhash.xxh3_64_intdigest(data[max(0, p - BACK) : p + LENGTH], min(p, BACK)) for p in at.tolist()]
            out["t"].append(text_hash(data))
            out["n"].append(len(data))
            out["sha"].append(hashlib.sha256(data).hexdigest())
            out["pos"].append(at)
            out["anchor"].append(h.view(np.int64))
            out["ctx"].append(np.array(ctx, np.uint64).view(np.int64))
        longs = pa.list_(pa.int64())
        cols = [batch.column("doc_id").cast(pa.int64()), batch.column("k"), pa.array(out["t"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["sha"]), *(pa.array(out[k], longs) for k in ("pos", "anchor", "ctx"))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k", "t", "n", "sha", "pos", "anchor", "ctx"])


def _contexts(batches):
    """The context of each wanted place: (anchor, t, pos, before, bytes)."""
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            data = (batch.column("text")[k].as_py() or "").encode("utf-8", "surrogatepass")
            t = batch.column("t")[k].as_py()
            if text_hash(data) != t:
                continue
            pos = batch.column("pos")[k].as_py()
            parts = [data[max(0, p - BACK) : p + LENGTH] for p in pos]
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor")[k].values, pa.array([t] * len(pos), pa.int64()), pa.array(pos, pa.int64()), pa.array([min(p, BACK) for p in pos], pa.int32()), pa.array(parts, pa.binary())], names=["anchor", "t", "pos", "before", "bytes"]
            )


def repeated_starts(rows: np.ndarray) -> np.ndarray:
    """Which of the first WIDTH - LENGTH + 1 columns start a LENGTH-byte string that another row has there too.

    rows: n x (WIDTH + 8) bytes. Rounds run over columns from the right; each puts one symbol before
    every suffix, sorts stably by it and updates the common prefix with the neighbour above.
    """
    n = len(rows)
    columns = np.ascontiguousarray(rows[:, :WIDTH].T)
    order = np.arange(n)
    for s in range(WIDTH - 1, BACK - 1, -1):
        order = order[np.argsort(columns[s][order], kind="stable")]
    out = np.zeros((n, BACK + 1), bool)
    prefix = np.zeros(n, np.int64)

    def common(x, y, start):
        """Bytes that suffixes x and y have in common from column start on, LENGTH at most."""
        length, live = np.zeros(len(x), np.int64), np.arange(len(x))
        for at in range(0, LENGTH, 8):
            word = np.ndarray((n,), "<u8", rows, start + at, (rows.strides[0],))
            diff = word[x[live]] ^ word[y[live]]
            low = diff & (~diff + np.uint64(1))
            same = np.where(diff == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
            length[live] += same
            live = live[same == 8]
            if not len(live):
                break
        return np.minimum(length, LENGTH)

    with np.errstate(over="ignore"):
        prefix[1:] = common(order[1:], order[:-1], BACK)
        for s in range(BACK, -1, -1):
            if s < BACK:
                symbol = columns[s][order]
                to = np.argsort(symbol, kind="stable")
                symbol, new = symbol[to], order[to]
                alike = symbol[1:] == symbol[:-1]
                still = to[1:] == to[:-1] + 1
                moved = np.zeros(n, np.int64)
                moved[1:] = np.where(alike & still, np.minimum(prefix[to[1:]] + 1, LENGTH), 0)
                fresh = np.flatnonzero(alike & ~still) + 1
                moved[fresh] = np.minimum(common(new[fresh], new[fresh - 1], s + 1) + 1, LENGTH)
                order, prefix = new, moved
            hit = prefix >= LENGTH
            out[order[hit], s] = True
            out[order[np.flatnonzero(hit) - 1], s] = True
    return out


def _runs(batches):
    """Stretches of each text that repeat, from contexts sorted by anchor."""
    import pyarrow as pa

    def block(held):
        n = len(held)
        # 0xFF stands in no UTF-8 text: what reaches over a text's end equals nothing that counts
        rows = np.full((n, WIDTH + 8), 0xFF, np.uint8)
        for i, (_, _, _, before, data) in enumerate(held):
            rows[i, BACK - before : BACK - before + len(data)] = np.frombuffer(data, np.uint8)
        hit = repeated_starts(rows)
        t, pos, before, size = (np.array(c, np.int64) for c in zip(*((h[1], h[2], h[3], len(h[4])) for h in held)))
        s = np.arange(BACK + 1)
        hit &= (s[None, :] >= (BACK - before)[:, None]) & (s[None, :] + LENGTH <= (BACK - before + size)[:, None])
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        start = pos[i] - BACK + first
        return pa.RecordBatch.from_arrays([pa.array(t[i]), pa.array(start), pa.array(start + (last - first) - 1 + LENGTH)], names=["t", "a", "b"])

    held, group, key = [], [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "t", "pos", "before", "bytes"))):
            if row[0] != key:
                if len(group) > 1:
                    held += group
                if len(held) >= BLOCK:
                    yield block(held)
                    held = []
                group, key = [], row[0]
            group.append(row)
    if len(group) > 1:
        held += group
    if held:
        yield block(held)


RUN = "t long, a long, b long"


def sorted_runs(met: DataFrame) -> DataFrame:
    """Stretches (t, a, b) of contexts (anchor, t, pos, before, bytes); an anchor's contexts meet in one task."""
    return met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(_runs), RUN)


def halves(met: DataFrame) -> DataFrame:
    """Contexts (anchor, lo, hi, t, pos, before, bytes), each as one row of each half of its columns in which a string of it starts.

    anchor becomes a digest that also tells the bytes that all strings of the half hold, bytes are those
    that its strings cover, and same is a digest of them and of where they lie.
    """
    left = F.expr(f"{BACK} - before")
    met = met.withColumn("half", F.explode(F.expr("array(struct(lo, (lo + hi) div 2 AS hi), struct((lo + hi) div 2 + 1 AS lo, hi))"))).select("anchor", "half.*", "t", "pos", "bytes", left.alias("at"))
    met = met.withColumn("first", F.greatest("lo", "at")).withColumn("last", F.least(F.col("hi"), F.expr(f"at + length(bytes) - {LENGTH}"))).where("first <= last")
    held = F.expr(f"substring(bytes, int(hi - at + 1), int(lo + {LENGTH} - hi))")
    met = met.withColumn("anchor", F.unhex(F.md5(F.concat("anchor", F.expr("encode(concat(':', lo, ':'), 'UTF-8')"), held))))
    met = met.withColumn("bytes", F.expr(f"substring(bytes, int(first - at + 1), int(last - first + {LENGTH}))"))
    return met.select("anchor", F.unhex(F.md5(F.concat(F.expr("encode(concat(first, ':'), 'UTF-8')"), "bytes"))).alias("same"), "lo", "hi", "t", "pos", F.expr(f"int({BACK} - first)").alias("before"), "bytes")


def counted(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows (anchor, ...) with k of counts (anchor, k), the number of rows that their anchor has; rows of anchors without k are left out.

    Anchors that have more than half of a task's share of the rows are fewer than two a task, so they are
    broadcast: their rows stay where they are, and no task joins all rows of one of them.
    """
    share = rows.count() // (2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    often = F.broadcast(counts.where(F.col("k") > share))
    rare = rows.join(often, "anchor", "left_anti").join(counts.where(F.col("k") <= share), "anchor")
    return rows.join(often, "anchor").unionByName(rare)


def split_runs(met: DataFrame, scratch: Scratch, most: int) -> list[DataFrame]:
    """Stretches (t, a, b) of contexts whose anchors have more than most of them, by halves of their columns."""
    out, level = [], 0
    met = scratch.keep(met.select(F.encode(F.col("anchor").cast("string"), "UTF-8").alias("anchor"), F.lit(0).cast("long").alias("lo"), F.lit(BACK).cast("long").alias("hi"), "t", "pos", "before", "bytes"), "split")
    last = "split"
    while not met.isEmpty():
        level += 1
        parts, kinds, groups, next_ = (f"{name}-{level}" for name in ("parts", "kinds", "groups", "split"))
        part = scratch.keep(halves(met), parts)
        scratch.drop(last)
        # rows of one kind are alike in their bytes and where these lie
        kind = part.groupBy("anchor", "same").agg(F.min(F.struct("t", "pos")).alias("one"), F.count("*").alias("c"))
        kind = scratch.keep(kind, kinds)
        group = scratch.keep(kind.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), groups)
        equal = part.join(kind.where("c > 1").select("anchor", "same"), ["anchor", "same"])
        out.append(scratch.keep(equal.select("t", F.expr("pos - before").alias("a"), F.expr("pos - before + length(bytes)").alias("b")), f"equal-{level}"))
        one = counted(kind, group).select("anchor", "same", "one.*", "k")
        one = part.join(one, ["anchor", "same", "t", "pos"]).select("anchor", "lo", "hi", "t", "pos", "before", "bytes", "k")
        out.append(scratch.keep(sorted_runs(one.where(F.col("k") <= most).select("anchor", "t", "pos", "before", "bytes")), f"runs-{level}"))
        met = scratch.keep(one.where(F.col("k") > most).drop("k"), next_)
        scratch.drop(parts, kinds, groups)
        last = next_
    scratch.drop(last)
    return out


def merged(a, b) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x, y in sorted(zip(a, b)):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [tuple(o) for o in out]


def cut(data: bytes, stretches) -> bytes:
    kept, at = [], 0
    for a, b in stretches:
        kept.append(data[at:a])
        at = b
    return b"".join(kept) + data[at:]


def _cut(batches):
    import pyarrow as pa

    for batch in batches:
        got = []
        for k in range(batch.num_rows):
            data = (batch.column("text")[k].as_py() or "").encode("utf-8", "surrogatepass")
            if text_hash(data) != batch.column("t")[k].as_py():
                continue
            spans = merged(batch.column("a")[k].as_py(), batch.column("b")[k].as_py())
            got.append((batch.column("t")[k].as_py(), sum(b - a for a, b in spans), len(spans), hashlib.sha256(cut(data, spans)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], names=["t", "removed", "spans", "kept"])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k, n): k is a hash of the text that is made without Python, n its bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64(text).alias("k"), F.octet_length(text).cast("long").alias("n"))


def reread(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, k, n, t, ...) with the texts that are meant; who uses them compares t."""
    by = lambda df, *cols: df.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), "k", "n", *cols)
    rest = [c for c in wanted.columns if c not in ("doc_id", "k", "n")]
    return by(keyed(docs), "text").join(by(wanted, *rest), ["no_id", "id", "k", "n"]).select("text", *rest)


def stretches(spark: SparkSession, docs: DataFrame, scratch: Scratch, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (doc_id, t, n, sha) of all rows, and spans (t, a, b) to remove of texts without copies.

    Anchors with more than most contexts are split.
    """
    kind = "doc_id long, k long, t long, n long, sha string, pos array<long>, anchor array<long>, ctx array<long>"
    rows = scratch.keep(keyed(docs).mapInArrow(lean(_scan), kind), "rows")
    # one place for each copy of a text
    places = rows.select("t", F.explode(F.arrays_zip("pos", "anchor", "ctx")).alias("x")).select("t", "x.*").distinct()
    places = scratch.keep(places, "places")
    contexts = places.groupBy("anchor", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("t", "pos")).alias("one"))
    contexts = scratch.keep(contexts, "contexts")
    shared = scratch.keep(contexts.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    whole = places.join(contexts.where("c > 1").select("anchor", "ctx"), ["anchor", "ctx"]).join(rows.groupBy("t").agg(F.first("n").alias("n")), "t")
    whole = whole.select("t", F.greatest(F.col("pos") - BACK, F.lit(0)).alias("a"), F.least(F.col("pos") + LENGTH, "n").alias("b"))
    whole = scratch.keep(whole, "whole")
    scratch.drop("places")
    reps = scratch.keep(rows.groupBy("t").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("k").alias("k")), "reps")
    # copies without an id would all be read: one stands for them
    of_id = docs.select("doc_id", "text")
    of_id = of_id.where("doc_id IS NOT NULL").union(of_id.where("doc_id IS NULL").groupBy(F.xxhash64("text"), F.octet_length("text")).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text"))

    def met(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select("anchor", "one.*")
        wanted = wanted.groupBy("t").agg(F.collect_list("pos").alias("pos"), F.collect_list("anchor").alias("anchor"))
        found = reread(of_id, wanted.join(reps, "t")).select("t", "text", "pos", "anchor")
        return found.mapInArrow(lean(_contexts), "anchor long, t long, pos long, before int, bytes binary")

    wanted = counted(contexts, shared)
    spans = whole.union(scratch.keep(sorted_runs(met(wanted.where(F.col("k") <= most))), "runs"))
    if not shared.where(F.col("k") > most).isEmpty():
        for more in split_runs(met(wanted.where(F.col("k") > most)), scratch, most):
            spans = spans.union(more)
    scratch.drop("contexts", "shared")
    return rows.select("doc_id", "t", "n", "sha"), spans


def remove_repeats(spark: SparkSession, docs: DataFrame, most: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row. Anchors with more than most contexts are split."""
    scratch = Scratch(spark, "suffix")
    rows, spans = stretches(spark, docs, scratch, most)
    reps = spark.read.parquet(scratch.path("reps"))
    per_text = spans.groupBy("t").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    single = per_text.join(reps.where("copies = 1"), "t")
    done = reread(docs, single).select("t", "text", "a", "b").mapInArrow(lean(_cut), "t long, removed long, spans long, kept string")
    done = scratch.keep(done, "done")
    nothing = hashlib.sha256(b"").hexdigest()
    copied = (F.col("copies") > 1) & (F.col("n") >= LENGTH)
    out = reps.select("t", "copies").join(done, "t", "left")
    out = scratch.keep(out, "texts-out")
    scratch.drop("whole", "runs", "reps", "done", *(f"{name}-{level}" for level in range(1, 10) for name in ("equal", "runs")))
    out = rows.join(out, "t")
    return out.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(copied, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLE: dict[str, str] = {}
