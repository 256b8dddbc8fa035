"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Inner product search is turned into cosine search by one more dimension (the root of what a vector's
squared norm lacks to the largest). On a bounded sample (SAMPLE rows, least by hash) principal axes
and TURNS rotations are learned, each so that rotated coordinates lie close to their signs; the signs
are the code. Every row is indexed.

Codes are cut into substrings, one a rotation, and a block of rows holds, for every substring, its
rows by value; the values within a radius of the query's are found by one pass over the block's
distinct values, as neighbours here differ in two fifths of their bits, far too many to enumerate.
For a Hamming radius r the substrings' radii follow from the pigeonhole principle: a code within r
differs from the query in some substring by no more than that substring's radius, so probing the
values within these radii finds every code within r. Those are reranked by the inner product of the
original vectors in double precision. The radius is learned too: within it lie TARGET of the true
neighbours of sample rows among the sample, which are farther off than among all rows. A block adds
its nearest codes where the radius holds fewer than k.

The stated query set meets all rows in blocks: blocks of queries and of rows are paired by number.

Vectors that are null, zero, or hold null or non-finite components take no part. An inner product is
of vectors of one length: each length is searched by itself. Components may be huge; a product that
no double holds is infinite. Fewer than k candidates: all of them. Ties go to the smaller vec_id.
A row is known by its place in its written block, not by its id: repeated rows are queries of their
own, each with its own ranks, and candidates for each other. An empty table: no rows. Other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import Scratch, lean, table
from .vectors import matrix, unit, usable

K, SAMPLE, TURNS, BITS, SUBSTRINGS, TARGET = 20, 20_000, 4, 64, 4, 0.94
QUERY_BLOCK, ROW_BLOCK = 8192, 8192


class Codes:
    """Learned axes, rotations and radius. scale: the largest component; top: the largest norm, in its units."""

    def __init__(self, x: np.ndarray, scale: float, top: float, k: int):
        self.scale, self.top = scale, top
        y = self.extend(x)
        self.mean = y.mean(0)
        keep = min(BITS, y.shape[1])
        values, axes = np.linalg.eigh((y - self.mean).T @ (y - self.mean))
        self.axes = axes[:, ::-1][:, :keep]
        p = (y - self.mean) @ self.axes
        rng = np.random.default_rng(11)
        self.turns = []
        for _ in range(TURNS):
            r = np.linalg.qr(rng.normal(size=(keep, keep)))[0]
            for _ in range(12):
                u, _, vt = np.linalg.svd(np.sign(p @ r).T @ p)
                r = (u @ vt).T
            self.turns.append(r)
        self.radius = self._radius(x, k)

    def extend(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale / self.top
        rest = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
        return np.hstack([x, rest[:, None]])

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """n x SUBSTRINGS substrings of 64 bits. A query's added dimension is 0 and its norm is no matter."""
        y = np.hstack([unit(x), np.zeros((len(x), 1))]) if query else self.extend(x)
        p = (y - self.mean) @ self.axes
        bits = np.zeros((len(x), TURNS, BITS), bool)
        for t, r in enumerate(self.turns):
            bits[:, t, : p.shape[1]] = p @ r > 0
        return np.packbits(bits.reshape(len(x), -1), axis=1).view(np.uint64)

    def _radius(self, x: np.ndarray, k: int) -> int:
        q = x[:: max(1, len(x) // 200)][:200]
        k = min(k + 1, len(x))
        near = np.argsort(-(unit(q) @ (x / self.scale).T), axis=1, kind="stable")[:, :k]  # the row itself among them
        a, b = self.of(q, True), self.of(x)
        far = np.sort(np.stack([np.bitwise_count(a[i] ^ b[near[i]]).sum(1) for i in range(len(q))]).ravel())
        return int(far[min(len(far) - 1, int(np.ceil(TARGET * len(far))))])

    def radii(self) -> list[int]:
        """One a substring; their sum and their number make radius + 1."""
        each, more = divmod(self.radius + 1, SUBSTRINGS)
        return [each - 1 + (s < more) for s in range(SUBSTRINGS)]


class Index:
    """A block's rows by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        self.values = [np.unique(codes[:, s], return_inverse=True) for s in range(codes.shape[1])]

    def within(self, query: np.ndarray, radius: int, radii: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows with Hamming distance <= radius, and all distances of probed rows (others: a large number)."""
        hit = np.zeros(len(self.codes), bool)
        for s, (values, place) in enumerate(self.values):
            if radii[s] >= 0:
                hit |= (np.bitwise_count(values ^ query[s]) <= radii[s])[place]
        rows = np.flatnonzero(hit)
        far = np.bitwise_count(self.words[rows] ^ np.ascontiguousarray(query).view(np.uint64)).sum(1)
        return rows[far <= radius], far


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products; where a sum overflows on the way, of vectors that are scaled to 1 first."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.einsum("ij,j->i", x, q)
        odd = np.flatnonzero(~np.isfinite(score))
        if len(odd):
            scale, own = np.abs(x[odd]).max(1), np.abs(q).max()
            score[odd] = np.einsum("ij,j->i", x[odd] / scale[:, None], q / own) * scale * own
    return score


def _search(codes: Codes, k: int):
    radii = codes.radii()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                read = lambda s: (np.frombuffer(row[f"keys_{s}"], np.int64), np.frombuffer(row[f"ids_{s}"], np.int64), np.frombuffer(row[f"x_{s}"]).reshape(-1, row["d"]))
                (q_keys, q_ids, q), (keys, ids, x) = read("q"), read("r")
                index, q_codes = Index(codes.of(x)), codes.of(q, True)
                out = []
                for n in range(len(q)):
                    rows, _ = index.within(q_codes[n], codes.radius, radii)
                    rows = rows[keys[rows] != q_keys[n]]
                    if len(rows) < k:
                        far = np.bitwise_count(index.words ^ np.ascontiguousarray(q_codes[n]).view(np.uint64)).sum(1)
                        rows = np.flatnonzero(far <= np.partition(far, min(2 * k, len(far) - 1))[min(2 * k, len(far) - 1)])  # with all as far as the last
                        rows = rows[keys[rows] != q_keys[n]]
                    score = products(x[rows], q[n])
                    best = np.lexsort((ids[rows], -score))[:k]
                    out.append((np.full(len(best), q_keys[n]), np.full(len(best), q_ids[n]), ids[rows[best]], score[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query", "query_id", "vec_id", "score"])

    return run


def blocks(rows: DataFrame, number: int, name: str) -> DataFrame:
    """(block, d, keys, ids, asks, x): rows dealt over so many blocks by hash, each block one row.

    rows: vec_id, x, asks, and key where rows have one; else block and place in it are a row's key.
    """
    keyed = "key" in rows.columns

    def pack(batches):
        import pyarrow as pa

        held, key = [], None

        def block():
            ids, asks, keys, x = (np.concatenate(c) for c in zip(*held))
            keys = keys if keyed else (key << 32) + np.arange(len(ids))
            parts = [keys.astype(np.int64).tobytes(), ids.astype(np.int64).tobytes(), asks.astype(bool).tobytes(), x.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([x.shape[1]], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["block", "d", "keys", "ids", "asks", "x"])

        for batch in batches:
            b = batch.column("block").to_numpy()
            starts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
            for s, e in zip(starts, [*starts[1:], len(b)]):
                if held and key != b[s]:
                    yield block()
                    held = []
                key = int(b[s])
                part = batch.slice(s, e - s)
                held.append((*(part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "asks", "key")), matrix(part.column("x"))))
        if held:
            yield block()

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(number))).repartition("block").sortWithinPartitions("block")
    dealt = dealt.select("block", F.col("vec_id").cast("long").alias("vec_id"), "asks", F.col("key") if keyed else F.lit(0).cast("long").alias("key"), "x")
    made = dealt.mapInArrow(pack, "block long, d int, keys binary, ids binary, asks binary, x binary")
    return made.select(F.col("block").alias(name), "d", *(F.col(c).alias(f"{c}_{name}") for c in ("keys", "ids", "asks", "x")))


def asking(made: DataFrame) -> DataFrame:
    """(vec_id, x, asks, key) of the rows of blocks that ask."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                asks = np.frombuffer(row["asks_r"], bool)
                x = np.frombuffer(row["x_r"]).reshape(-1, row["d"])[asks]
                ids, keys = (np.frombuffer(row[c], np.int64)[asks] for c in ("ids_r", "keys_r"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * row["d"], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists, pa.array(np.ones(len(x), bool)), pa.array(keys)], names=["vec_id", "x", "asks", "key"])

    return made.mapInArrow(run, "vec_id long, x array<double>, asks boolean, key long")


def search(spark: SparkSession, embeddings: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by inner product."""
    scratch = Scratch(spark, "ann")
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.withColumn("d", F.size("x"))
    largest = F.array_max(F.transform("x", F.abs))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.max(largest).alias("scale"), F.sum(F.col("asks").cast("int")).alias("queries")).where("queries > 0").orderBy("d").collect()  # a row a length
    found = [_of_length(spark, rows.where(F.col("d") == s["d"]), s, k, scratch) for s in sizes]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("d", "query").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.union, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(spark: SparkSession, rows: DataFrame, size, k: int, scratch: Scratch) -> DataFrame:
    """(query, query_id, vec_id, score, d): nearest rows of each block, among vectors of one length."""
    d = size["d"]
    top = rows.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.pow(v / F.lit(size["scale"]), 2))))).head()[0]
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").collect()])
    codes = Codes(sample, size["scale"], top, k)
    n_q, n_r = -(-size["queries"] // QUERY_BLOCK), -(-size["n"] // ROW_BLOCK)
    r = scratch.keep(blocks(rows, n_r, "r"), f"rows-{d}")
    q = scratch.keep(blocks(asking(r), n_q, "q").drop("d", "asks_q"), f"queries-{d}")
    r = r.drop("asks_r")
    pairs = spark.range(n_q * n_r).select((F.col("id") % n_q).alias("q"), F.expr(f"id div {n_q}").alias("r"))
    met = pairs.join(q, "q").join(r, "r").repartition("q", "r")
    return met.mapInArrow(lean(_search(codes, k)), "query long, query_id long, vec_id long, score double").withColumn("d", F.lit(d))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op5_ann": op5_ann}
ORACLE: dict[str, str] = {}
