"""Ranked lexical search over shards of postings with blocks of varying length.

Documents are indexed where they lie: a task gathers rows until a shard is full (SHARD_BYTES of text
or SHARD_DOCS rows, one text at least) and writes the shard's posting lists, so no posting is shuffled
to build the index and the memory of a task is bounded. The index is a table: a row a (shard, term),
and one for the shard itself. Two passes read the texts, as bounds need the totals.

Each list is cut into blocks by dynamic programming: of all cuts into blocks of at most LONGEST
postings, in runs of RUN postings, the one with the least error of the bounds (every document from a
block's first to its last is taken for the block's best) plus PRICE for a block. In lists of up to
SINGLE postings each is a block.

Search is block-max WAND over these blocks, exact: between neighbouring edges of the query's blocks
the sum of the blocks' bounds holds for every document. A shard's intervals are read from the best
bound on, some at a time, only blocks that meet them are scored, and once the best bound left is below
the k-th score found the rest is skipped. Shards of a task go on from the scores found before.

Queries run in blocks of about QUERY_BYTES of text. Of a block, the driver holds the queries and how
many documents hold each of their terms, and both are broadcast: what that needs does not grow with
the documents. Partial results are k rows a query and task.

A document without terms (null and empty texts too) is not counted and never found. Texts of any
length count whole. Repeated rows are documents of their own; equal scores go by doc_id, null last.
Queries that repeat id and text are one; others of one id are searched each by itself. A query
without terms, or empty tables: no rows. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import Scratch, lean, table

K = 20
SHARD_BYTES, SHARD_DOCS, QUERY_BYTES = 16 << 20, 1 << 16, 4 << 20
LONGEST, RUN, SINGLE, PRICE = 64, 256, 8, 16_000_000
#: Of intervals that are read at once, as multiples of k documents.
STEP = 4
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8: of ASCII only letters and digits are of a term, and all others are.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
INDEX = "shard long, term string, df int, docs binary, tf binary, ends binary, tops binary, ids array<bigint>, shares array<bigint>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def _totals(batches):
    import pyarrow as pa

    docs = words = 0
    for batch in batches:
        for text in batch.column(0):
            n = len(terms(text.as_py() or b""))
            docs, words = docs + (n > 0), words + n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([words], pa.int64())], names=["docs", "words"])


def totals(docs: DataFrame) -> tuple[int, int]:
    """How many documents have terms, and how many terms these have."""
    sums = docs.select(F.col("text").cast("binary")).mapInArrow(lean(_totals), "docs long, words long").agg(F.sum("docs"), F.sum("words")).head()
    return sums[0] or 0, sums[1] or 0


def part(tf: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What a posting's term is multiplied by; under a million."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * share)


def cuts(lists: list[np.ndarray], places: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of scores, at ascending places, the ends of its blocks, exclusive: least error of bounds plus price."""
    out: list[np.ndarray | None] = [None] * len(lists)
    sizes = np.array([len(x) for x in lists])
    width = np.maximum(16, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)) if lists else sizes
    for w in np.unique(width):  # lists of like length at once, a column each
        for some in np.array_split(np.flatnonzero(width == w), max(1, (width == w).sum() * int(w) // 1_000_000)):
            score, place = np.zeros((w, len(some)), np.int64), np.zeros((w, len(some)), np.int64)
            for c, k in enumerate(some):
                score[: sizes[k], c], place[: sizes[k], c] = lists[k], places[k]
            cost, back = np.zeros((w + 1, len(some)), np.int64), np.zeros((w + 1, len(some)), np.int64)
            top = np.zeros((min(LONGEST, w), len(some)), np.int64)
            for i in range(1, w + 1):
                m = min(i, len(top))
                top[1:m] = top[: m - 1]
                top[0] = 0
                np.maximum(top[:m], score[i - 1], out=top[:m])
                ways = cost[i - m : i][::-1] + top[:m] * (place[i - 1] + 1 - place[i - m : i][::-1])
                best = ways.argmin(0)
                back[i], cost[i] = best + 1, ways[best, np.arange(len(some))] + PRICE
            at, ends = sizes[some].copy(), [[] for _ in some]
            while (open_ := np.flatnonzero(at > 0)).size:
                for c in open_:
                    ends[c].append(at[c])
                at[open_] -= back[at[open_], open_]
            for c, k in enumerate(some):
                out[k] = np.array(ends[c][::-1], np.int64)
    return out


def blocks(starts: np.ndarray, score: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all lists of a shard, which begin at ``starts`` (and the end): where blocks end, and how many each list has."""
    size = np.diff(starts)
    n_runs = -(-size // np.where(size > SINGLE, RUN, 1))
    owner = np.repeat(np.arange(len(size)), n_runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    begin = starts[owner] + size[owner] * nth // n_runs[owner]
    stop = starts[owner] + size[owner] * (nth + 1) // n_runs[owner]
    long = np.flatnonzero(size[owner] > SINGLE)
    inner = cuts([score[begin[r] : stop[r]] for r in long], [docs[begin[r] : stop[r]] for r in long])
    each = np.ones(len(owner), np.int64)
    each[long] = [len(e) for e in inner]
    ends = np.repeat(stop, each)
    first = np.cumsum(each) - each
    for r, e in zip(long, inner):
        ends[first[r] : first[r] + each[r]] = begin[r] + e
    return ends, np.bincount(owner, weights=each, minlength=len(size)).astype(np.int64)


class Shard:
    """Rows that are gathered, and the lists they make."""

    def __init__(self, number: int, n_docs: int, n_words: int):
        self.number, self.n_docs, self.n_words = number, n_docs, n_words
        self.names = defaultdict(count().__next__)
        self.ids, self.shares, self.tokens, self.bytes = [], [], [], 0

    def add(self, doc_id, text: bytes) -> None:
        words = terms(text)
        if words:
            self.ids.append(doc_id)
            self.shares.append(75 + 25 * len(words) * self.n_docs // self.n_words)
            self.tokens.append(np.fromiter(map(self.names.__getitem__, words), np.int32, len(words)))
            self.bytes += len(text)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def rows(self):
        import pyarrow as pa

        if not self.ids:
            return
        doc = np.repeat(np.arange(len(self.ids)), [len(t) for t in self.tokens])
        key = np.concatenate(self.tokens).astype(np.int64) << 17 | doc
        self.tokens = []
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf, key = np.diff(np.append(at, len(key))), key[at]
        docs, term = key & 0x1FFFF, key >> 17
        score = part(tf, np.array(self.shares, np.int64)[docs])
        starts = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term))
        ends, n_blocks = blocks(starts, score, docs)
        begins = np.append(0, ends[:-1])
        tops = np.maximum.reduceat(score, begins)
        ends -= np.repeat(starts[:-1], n_blocks)  # within the list

        def packed(values, kind, offsets):
            data = values.astype(kind)
            return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int32)), pa.py_buffer(data)])

        of_blocks = np.append(0, np.cumsum(n_blocks))
        n = len(starts) - 1
        cols = [
            pa.array(np.full(n, self.number)), pa.array(list(self.names), pa.binary()).cast(pa.string()), pa.array(np.diff(starts), pa.int32()),
            packed(docs, np.uint16, starts), packed(tf, np.uint32, starts), packed(ends, np.int32, of_blocks), packed(tops, np.int32, of_blocks),
            pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())),
        ]
        names = [f.split()[0] for f in INDEX.split(", ")]
        own = {"shard": self.number, "term": "", "df": 0, "docs": b"", "tf": b"", "ends": b"", "tops": b"", "ids": self.ids, "shares": self.shares}
        schema = pa.schema([pa.field(c, a.type) for c, a in zip(names, cols)])
        yield pa.RecordBatch.from_pylist([own], schema=schema)
        batch = pa.RecordBatch.from_arrays(cols, schema=schema)
        for k in range(0, n, 4096):
            yield batch.slice(k, 4096)


def _indexed(n_docs: int, n_words: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        shard = Shard(number, n_docs, n_words)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                shard.add(doc_id.as_py(), text.as_py() or b"")
                if shard.full():
                    yield from shard.rows()
                    shard = Shard(shard.number + 1, n_docs, n_words)
        yield from shard.rows()

    return run


def build(docs: DataFrame, scratch: Scratch, name: str = "index") -> tuple[DataFrame, int]:
    """The index, a written table, and how many documents have terms. docs: doc_id, text."""
    n_docs, n_words = totals(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return scratch.keep(rows.mapInArrow(lean(_indexed(n_docs, n_words)), INDEX), name), n_docs


class Lists:
    """A shard's lists of the terms that are asked for, one after the other, and their blocks."""

    def __init__(self, rows: list[dict]):
        own = next(r for r in rows if r["term"] == "")
        rows = [r for r in rows if r["term"] != ""]
        self.none = np.array([i is None for i in own["ids"]])
        self.ids = np.array([0 if i is None else i for i in own["ids"]], np.int64)
        read = lambda c, kind: [np.frombuffer(r[c], kind).astype(np.int64) for r in rows]
        self.of = {r["term"]: k for k, r in enumerate(rows)}
        sizes = np.array([r["df"] for r in rows], np.int64)
        self.docs = np.concatenate(read("docs", np.uint16)) if rows else np.zeros(0, np.int64)
        self.score = part(np.concatenate(read("tf", np.uint32)), np.array(own["shares"])[self.docs]) if rows else np.zeros(0, np.int64)
        ends = read("ends", np.int32)
        self.first = np.append(0, np.cumsum([len(e) for e in ends], dtype=np.int64))
        offset = np.cumsum(sizes) - sizes
        self.stop = np.concatenate([e + o for e, o in zip(ends, offset)]) if rows else np.zeros(0, np.int64)
        self.begin = np.append(0, self.stop[:-1])
        self.tops = np.concatenate(read("tops", np.int32)) if rows else np.zeros(0, np.int64)

    def best(self, query: list[tuple[str, int]], k: int, had):
        """The k best of (scores, none, ids) had and this shard's. query: term, weight."""
        asked = [(self.of[t], w) for t, w in query if t in self.of and w > 0]
        if not asked:
            return had
        block = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t, _ in asked])
        weight = np.repeat([w for _, w in asked], [self.first[t + 1] - self.first[t] for t, _ in asked])
        low, high = self.docs[self.begin[block]], self.docs[self.stop[block] - 1] + 1
        edges, place = np.unique(np.concatenate([low, high]), return_inverse=True)
        bound = np.zeros(len(edges), np.int64)
        np.add.at(bound, place, np.concatenate([weight * self.tops[block], -weight * self.tops[block]]))
        bound = np.cumsum(bound)[:-1]
        order = np.argsort(-bound, kind="stable")
        width = np.cumsum(np.diff(edges)[order])
        at, most = 0, STEP * k
        while at < len(order):
            least = had[0][k - 1] if len(had[0]) >= k else 1
            if bound[order[at]] < least:
                break
            stop = min(max(at + 1, int(np.searchsorted(width, most))), at + int(np.searchsorted(-bound[order[at:]], -least, side="right")))
            had = self._read(edges, np.sort(order[at:stop]), block, weight, low, high, k, had)
            at, most = stop, 2 * width[stop - 1]
        return had

    def _read(self, edges, intervals, block, weight, low, high, k, had):
        """Scores the documents of the intervals, by the blocks that meet them."""
        alive = np.zeros(edges[-1] + 1, np.int64)
        alive[edges[intervals]] += 1
        alive[edges[intervals + 1]] -= 1
        alive = np.cumsum(alive)[:-1]
        upto = np.append(0, np.cumsum(alive))
        meet = np.flatnonzero(upto[high] > upto[low])
        sizes = self.stop[block[meet]] - self.begin[block[meet]]
        at = np.repeat(self.begin[block[meet]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        docs = self.docs[at]
        inside = alive[docs] > 0
        docs, gain = docs[inside], (np.repeat(weight[meet], sizes) * self.score[at])[inside]
        total = np.zeros(len(alive), np.int64)
        np.add.at(total, docs, gain)
        found = np.flatnonzero(total)
        score, none, ids = np.append(had[0], total[found]), np.append(had[1], self.none[found]), np.append(had[2], self.ids[found])
        best = np.lexsort((ids, none, -score))[:k]
        return score[best], none[best], ids[best]


NOTHING = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)


def _searched(held, k: int):
    def run(batches):
        import pyarrow as pa

        queries = held.value
        best = [NOTHING] * len(queries)

        def of_shard(rows):
            lists = Lists(rows)
            for q, (_, _, query) in enumerate(queries):
                best[q] = lists.best(query, k, best[q])

        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["shard"] != row["shard"]:
                    of_shard(rows)
                    rows = []
                rows.append(row)
        if rows:
            of_shard(rows)
        for (number, item, _), (score, none, ids) in zip(queries, best):
            if n := len(score):
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array([item] * n, pa.int64()), pa.array(ids, mask=none), pa.array(score)], names=["query", "item_id", "doc_id", "score"])

    return run


def query_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def search(spark: SparkSession, index: DataFrame, n_docs: int, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0. items: item_id, text."""
    items = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n_blocks = -(-(items.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // QUERY_BYTES)
    found = []
    for b in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        asked = [(r[0], Counter(r[1])) for r in mine.select("item_id", query_terms(F.col("text"))).collect()]  # about QUERY_BYTES
        asked = [(i, c) for i, c in asked if c]
        words = sorted({t for _, c in asked for t in c})
        if not words:
            continue
        wanted = spark.createDataFrame([(t,) for t in [*words, ""]], "term string")
        lists = index.join(F.broadcast(wanted), "term", "left_semi")  # bounded by the block of queries
        df = dict(map(tuple, lists.where("term <> ''").groupBy("term").agg(F.sum("df")).collect()))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
        queries = [(b << 32 | q, i, [(t, n * weight[t]) for t, n in sorted(c.items()) if t in weight]) for q, (i, c) in enumerate(asked)]
        held = spark.sparkContext.broadcast(queries)
        by_shard = lists.repartition("shard").sortWithinPartitions("shard")
        found.append(by_shard.mapInArrow(lean(_searched(held, k)), "query long, item_id long, doc_id long, score long"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return reduce(DataFrame.union, found).withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lexical")
    index, n_docs = build(table(spark, sf_dir, "documents"), scratch)
    ranked = scratch.keep(search(spark, index, n_docs, table(spark, sf_dir, "benchmark")), "ranked")  # k rows an item
    scratch.drop("index")
    return ranked


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
e AS (SELECT rid, doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM e),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM e) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), s),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
t AS (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(ts) AS term FROM i) GROUP BY q, item_id, term),
m AS (SELECT rid, doc_id, 100 - 25 + ((25 * n * nn) // ll) AS m FROM e, s),
c AS (SELECT q, item_id, doc_id, rid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM t JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY q, item_id, doc_id, rid),
r AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}"""

QUERIES = {"op12_lexical": op12_lexical}
ORACLE = {"op12_lexical": _ORACLE}
