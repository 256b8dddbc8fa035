"""Document quality: random-indexing word vectors, pooled, then a two-layer network.

Random indexing: every word bucket has a sparse random index vector (NONZERO entries of +1 or -1);
a bucket's context vector is the sum of its neighbours' index vectors over all occurrences in all
documents. Tasks add up partial sums of fixed size, which are added again by chunk of buckets, so
what moves depends on the number of tasks and not on any word's frequency.

A document is pooled to the mean and the spread of its tokens' vectors; a two-layer network in numpy
gives a logit, and a temperature fitted on rows apart calibrates it. The network is fitted on at most
SAMPLE labelled rows (least by hash) whose crc32(doc_id) mod 3 is not 1.

Null or empty text: pooled to zeros, scored like any other. No labels, or one class only: the base
rate. Repeated rows: each is scored. An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .learn import SAMPLE, sample_labels, sigmoid, texts, with_labels

BUCKETS, DIMS, NONZERO, NEAR, CHUNKS = 1 << 13, 32, 2, 2, 32
FLUSH = 400_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 256, 3e-3
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Buckets(dict):
    """Token to bucket, remembered up to a fixed number of tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[token] = b = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
        return b

    def of(self, text: str) -> np.ndarray:
        found = _TOKEN.findall(text)
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of each bucket's index vector; one more bucket stands between documents."""
    rng = np.random.default_rng(7)
    place = np.stack([rng.permutation(DIMS)[:NONZERO] for _ in range(BUCKETS)] + [np.zeros(NONZERO, int)])
    sign = rng.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
    sign[BUCKETS] = 0
    return place, sign


def _contexts(batches):
    import pyarrow as pa

    place, sign = index_vectors()
    total, counts = np.zeros((BUCKETS + 1) * DIMS), np.zeros(BUCKETS + 1)
    known, gap = Buckets(), np.full(NEAR, BUCKETS, np.int32)

    def add(parts):
        ids = np.concatenate(parts)
        counts[:] += np.bincount(ids, minlength=BUCKETS + 1)
        for off in range(1, NEAR + 1):
            for left, right in ((ids[:-off], ids[off:]), (ids[off:], ids[:-off])):
                for k in range(NONZERO):
                    total[:] += np.bincount(left.astype(np.int64) * DIMS + place[right, k], weights=sign[right, k], minlength=len(total))

    parts, held = [gap], 0
    for batch in batches:
        for _, text in texts(batch):
            parts += [known.of(text), gap]
            held += len(parts[-2])
            if held >= FLUSH:
                add(parts)
                parts, held = [gap], 0
    add(parts)
    each = np.hstack([total.reshape(-1, DIMS)[:BUCKETS], counts[:BUCKETS, None]]).reshape(CHUNKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([e.tobytes() for e in each], pa.binary())], names=["chunk", "sums"])


def _added(batches):
    import pyarrow as pa

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, b in zip(batch.column("chunk"), batch.column("sums")):
            sums[c.as_py()] = sums.get(c.as_py(), 0) + np.frombuffer(b.as_py())
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS unit context vectors over all documents."""
    kind = "chunk int, sums binary"
    partial = docs.select(F.lit(0).alias("doc_id"), "text").mapInArrow(_contexts, kind)
    added = partial.repartition(8, "chunk").mapInArrow(_added, kind).collect()  # CHUNKS rows of fixed size
    x = np.zeros((CHUNKS, BUCKETS // CHUNKS * (DIMS + 1)))
    for row in added:
        x[row[0]] += np.frombuffer(row[1], np.float64)
    x = x.reshape(BUCKETS, DIMS + 1)
    mean = x[:, :DIMS] / np.maximum(x[:, DIMS:], 1)
    seen = x[:, DIMS] > 0
    mean[seen] -= (x[:, :DIMS].sum(0) / max(x[:, DIMS].sum(), 1))
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Pool:
    def __init__(self, vectors: np.ndarray):
        self.vectors, self.known = vectors, None

    width = 3 * DIMS + 3

    def __getstate__(self):
        return {"vectors": self.vectors, "known": None}

    def of(self, text: str) -> np.ndarray:
        self.known = Buckets() if self.known is None else self.known
        ids = self.known.of(text)
        out = np.zeros(self.width, np.float32)
        if len(ids):
            n = np.bincount(ids, minlength=BUCKETS)
            used = np.flatnonzero(n)
            share = (n[used] / len(ids)).astype(np.float32)
            v = self.vectors[used]
            mean = share @ v
            out[:DIMS] = mean
            out[DIMS : 2 * DIMS] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
            out[2 * DIMS : 3 * DIMS] = v.mean(0)
            out[-3:] = np.log1p(len(ids)) / 8, len(used) / len(ids), np.sqrt(share @ share)
        return out


class Network:
    """One hidden layer, a logit, and a temperature."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> "Network":
        self.temperature, self.constant = 1.0, None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float((y.sum() + 0.5) / (len(y) + 1))
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        apart = np.arange(len(y)) % 5 == 4
        rng = np.random.default_rng(seed)
        p = [rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        rows = np.flatnonzero(~apart)
        for _ in range(EPOCHS):
            rng.shuffle(rows)
            for at in range(0, len(rows), BATCH):
                xb, yb = x[rows[at : at + BATCH]], y[rows[at : at + BATCH]]
                h = np.maximum(xb @ p[0] + p[1], 0)
                d = (sigmoid(h @ p[2] + p[3]) - yb) / len(yb)
                back = np.outer(d, p[2]) * (h > 0)
                grads = [xb.T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        z, y = self._logit(x[apart]), y[apart]
        if len(y):
            loss = lambda s: np.mean(np.logaddexp(0, z / s) - y * z / s)
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self._logit((x - self.mean) / self.scale) / self.temperature)


def train(docs: DataFrame, labels: DataFrame, pool: Pool, most: int = SAMPLE) -> Network:
    learnable = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    sample = sample_labels(labels, ["quality"], most, learnable)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            got = [(i, pool.of(t).tobytes()) for i, t in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), batch.column("quality").cast(pa.int32()), pa.array([g[1] for g in got], pa.binary())], names=["doc_id", "y", "x"])

    got = with_labels(docs.select("doc_id", "text"), sample).mapInArrow(rows, "doc_id long, y int, x binary").toPandas().sort_values("doc_id")  # bounded by the sample
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(float) if len(got) else np.zeros((0, pool.width))
    return Network().fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    docs = docs.select("doc_id", "text")
    pool = Pool(word_vectors(docs))
    network = train(docs, labels, pool)

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("text")
            p = np.zeros(len(column))
            for at in range(0, len(column), 512):
                p[at : at + 512] = network.predict(np.stack([pool.of(t.as_py() or "") for t in column.slice(at, 512)]).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    out = docs.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
