"""N-gram Jaccard join by prefix lists with set-relation skipping.

Sets of 5-word shingles (64-bit hashes, which stand for the shingles), links at Jaccard >= 0.8. Equal
sets are one node.

1. A counting sketch of fixed size over all documents gives every shingle a frequency class; classes
   and hashes order all shingles alike everywhere, rare ones first. Two linked sets share a shingle
   within the first n - ceil(0.8 n) + 1 of each, whatever the order; the order keeps passages that
   many documents share out of the lists.
2. Index lists: (shingle, node, size, position). Entries of a list are skipped by size, and by
   position: at the first shingle that two sets share, too few may be left for the overlap. What
   remains of a short list are pairs, at most SHORT * (SHORT - 1) / 2 of them. The set of a long list
   whose shingles are the most frequent leads it, as the original does among copies that each differ
   from it in their own way, and every other is compared with the leader: pairs are linear in the list.
3. Answers of a long list are derived from the leader's: two sets need no comparison when they already
   have one component, or when their distances to the leader differ by more than 0.2 (Jaccard
   distance is a metric). Lists that have become one component go as a whole; of the others, blocks
   of a size-sorted list are skipped by size and entries by position, in pairs of blocks of at most
   BLOCK rows. What remains is compared exactly. No list is cut.

Comparisons bring the sets to their leader, in salted groups of at most PER_SALT. Components are
drawn by contraction.

Null or wordless text: an empty set, linked with nothing, its own component. Fewer than five words:
one shingle of the whole sequence. Rows that repeat a document: each is returned. Rows of one doc_id
with different texts: each its own set and links. A null doc_id: linked with nothing, component null.
An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, lean, row_digest, table, unused
from .graph import components

WORDS, NUM, DEN = 5, 80, 100
COUNTERS, CHUNKS = 1 << 21, 32
#: Bits of the filter that tells which texts are read again: twelve or more an entry; beyond MOST_BITS texts are joined instead.
LEAST_BITS, MOST_BITS, PER_ENTRY, PROBES = 1 << 18, 1 << 28, 12, 4
#: Sets compared with one copy of a leader; rows of a list that are paired at once; rows of a list that needs no leader.
PER_SALT, BLOCK, SHORT = 64, 2048, 8
_P = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word to 64-bit hash, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, known: Words) -> np.ndarray:
    """Sorted distinct shingle hashes. Bytes are lower-cased, which folds A-Z only, and cut at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(len(w), WORDS)
    h = np.full(len(w) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * _P + w[k : len(w) - n + 1 + k]
        return np.unique(mixed(h))


def prefix_length(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1


def _sketch(batches):
    import pyarrow as pa

    known, total, held = Words(), np.zeros(COUNTERS, np.int64), []
    for batch in batches:
        for t in batch.column("text"):
            held.append(shingles(t.as_py() or "", known))
            if len(held) == 1000:
                total += np.bincount((np.concatenate(held) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
                held = []
    if held:
        total += np.bincount((np.concatenate(held) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    # a class needs no exact count: what one task has seen more than 255 times is frequent anyhow
    each = np.minimum(total, 255).astype(np.uint8).reshape(CHUNKS, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([e.tobytes() for e in each], pa.binary())], names=["chunk", "counts"])


def _sketch_sum(batches):
    import pyarrow as pa

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, b in zip(batch.column("chunk"), batch.column("counts")):
            sums[c.as_py()] = sums.get(c.as_py(), 0) + np.frombuffer(b.as_py(), np.uint8).astype(np.int64)
    classes = {c: (4 * np.log2(v + 1)).astype(np.uint8).tobytes() for c, v in sums.items()}
    yield pa.RecordBatch.from_arrays([pa.array(list(classes), pa.int32()), pa.array(list(classes.values()), pa.binary())], names=["chunk", "counts"])


def frequency_classes(docs: DataFrame) -> np.ndarray:
    """COUNTERS classes, four to a power of two. The sums are rows of fixed size, CHUNKS of them."""
    kind = "chunk int, counts binary"
    sums = docs.select("text").mapInArrow(lean(_sketch), kind).repartition(8, "chunk").mapInArrow(_sketch_sum, kind).collect()
    out = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.uint8)
    for row in sums:
        out[row[0]] = np.frombuffer(row[1], np.uint8)
    return out.reshape(-1)


def signature(h: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mixed(mixed(h ^ _P).sum(dtype=np.uint64) + np.uint64(len(h)))[()].astype(np.int64)) if len(h) else 0


def set_rows(docs: DataFrame, classes) -> DataFrame:
    """(doc_id, size, node, common, prefix) of each row; node is the set's signature, null for an empty set.

    common is the mean frequency class of its shingles, in 64ths. prefix is null where the task has
    given it for an equal set before: so copies, however many, are one row a task in every list.
    """

    def rows(batches):
        import pyarrow as pa

        known, given = Words(), set()
        for batch in batches:
            size, node, common, prefix = [], [], [], []
            for i, t in zip(batch.column("doc_id"), batch.column("text")):
                h = shingles(t.as_py() or "", known)
                size.append(len(h))
                node.append(signature(h) if len(h) else None)
                if not len(h) or not i.is_valid or node[-1] in given:
                    common.append(0)
                    prefix.append(None)
                    continue
                given.add(node[-1])
                kind = classes.value[(h % np.uint64(COUNTERS)).astype(np.int64)]
                common.append(int(64 * kind.mean()))
                order = np.lexsort((h, kind))
                prefix.append(h[order[: prefix_length(len(h))]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(common, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "size", "node", "common", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(lean(rows), "doc_id long, size long, node long, common long, prefix array<long>")


def _columns(batch):
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _bound(a, b):
    """The least overlap of sets of sizes a and b at the threshold, rounded up."""
    return (NUM * (a + b) + NUM + DEN - 1) // (NUM + DEN)


def _may_link(size_a, pos_a, size_b, pos_b):
    """Whether sets that share a shingle at these positions, and none before, may reach the threshold."""
    near = np.minimum(size_a, size_b) * DEN >= np.maximum(size_a, size_b) * NUM
    left = 1 + np.minimum(size_a - pos_a - 1, size_b - pos_b - 1)
    return near & (left >= _bound(size_a, size_b))


LIST = ["shingle", "node", "size", "pos", "leader", "leader_size", "leader_pos"]


def _lists(batches):
    """Pairs (node, leader) of short lists, without a shingle; rows of long lists with the list's leader.

    Input sorted by shingle, leaders first; a node that several tasks gave stands there several times in
    a row and counts once. At most SHORT rows and a batch are held.
    """
    import pyarrow as pa

    def pairs(h, size, pos):
        for d in range(1, SHORT):
            i = np.flatnonzero(h[:-d] == h[d:]) if len(h) > d else []
            if not len(i):
                return
            j = i + d
            ok = _may_link(size[i], pos[i], size[j], pos[j])
            yield i[ok], j[ok]

    def batch_of(cols):
        made = [pa.array(np.asarray(c, np.int64)) if c is not None else None for c in cols]
        n = len(next(c for c in made if c is not None))
        return pa.RecordBatch.from_arrays([c if c is not None else pa.nulls(n, pa.int64()) for c in made], names=LIST)

    def closed(cols):
        """Whole lists."""
        h, node, size, pos, common = cols
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        lengths = np.diff(np.append(starts, len(h)))
        short, long = np.repeat((lengths > 1) & (lengths <= SHORT), lengths), np.repeat(lengths > SHORT, lengths)
        sh, sn, ss, sp, _ = (c[short] for c in cols)
        got = list(pairs(sh, ss, sp))
        if got:
            i, j = (np.concatenate(x) for x in zip(*got))
            yield batch_of([None, sn[j], None, None, sn[i], None, None])
        if long.any():
            lead = np.repeat(starts, lengths)[long]
            yield batch_of([h[long], node[long], size[long], pos[long], node[lead], size[lead], pos[lead]])

    held, lead, before = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = _columns(batch)
        fresh = np.append(before != (cols[0][0], cols[1][0]), (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
        before = (cols[0][-1], cols[1][-1])
        cols = [c[fresh] for c in cols]
        if not len(cols[0]):
            continue
        if lead is not None:
            more = cols[0] == lead[0]
            if more.any():
                yield batch_of([c[more] for c in cols[:4]] + [np.full(more.sum(), v) for v in lead[1:4]])
                cols = [c[~more] for c in cols]
            if not len(cols[0]):
                continue
            lead = None
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        yield from closed([c[:last] for c in cols]) if last else ()
        held = [c[last:] for c in cols]
        if len(held[0]) > SHORT:
            lead = [c[0] for c in held]
            yield batch_of(held[:4] + [np.full(len(held[0]), v) for v in lead[1:4]])
            held = None
    if held is not None:
        yield from closed(held)


def _residual(batches):
    """Pairs of a list that nothing known decides. Input sorted by list, pair of blocks and size; one pair of blocks is held at a time."""
    import pyarrow as pa

    def pairs(rows):
        second, node, size, pos, comp, dist, leads = rows
        cross = second.any()
        for i in range(len(node) - 1):
            if leads[i]:
                continue
            # blocks beyond this size are skipped whole
            end = np.searchsorted(size, size[i] * DEN // NUM, side="right")
            j = slice(i + 1, end)
            far = np.abs(dist[j] - dist[i]) > 1 - NUM / DEN + 1e-9  # false where a distance isn't known
            ok = (comp[j] != comp[i]) & _may_link(size[i], pos[i], size[j], pos[j]) & ~far & ~leads[j]
            if cross:
                ok &= second[j] != second[i]
            if ok.any():
                yield np.full(ok.sum(), node[i]), node[j][ok]

    def emit(rows):
        found = list(pairs(rows))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["node", "leader"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, pair, *cols = _columns(batch)
        cols[0], cols[5], cols[6] = cols[0].astype(bool), cols[5].astype(float), cols[6].astype(bool)
        starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])))
        for s, e in zip(starts, np.append(starts[1:], len(h))):
            part = [c[s:e] for c in cols]
            if held is not None and held[0] == (h[s], pair[s]):
                held = (held[0], [np.concatenate(x) for x in zip(held[1], part)])
            else:
                if held is not None:
                    yield from emit(held[1])
                held = ((h[s], pair[s]), part)
    if held is not None:
        yield from emit(held[1])


def in_blocks(lists: DataFrame) -> DataFrame:
    """(shingle, pair, second, node, ...): rows of lists by pair of blocks; a list of at most BLOCK rows is one."""
    cols = ["node", "size", "pos", "comp", "dist", "leads"]
    few = lists.where(F.col("n") <= BLOCK).select("shingle", F.lit(0).cast("long").alias("pair"), F.lit(False).alias("second"), *cols)
    block = F.expr(f"(row_number() over (partition by shingle order by size, node) - 1) div {BLOCK}")
    many = lists.where(F.col("n") > BLOCK).withColumn("block", block).withColumn("blocks", F.expr(f"(n + {BLOCK} - 1) div {BLOCK}"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    return few.union(many.select("shingle", pair.alias("pair"), (F.col("block") > F.col("other")).alias("second"), *cols))


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places of each id in a part of the filter."""
    with np.errstate(over="ignore"):
        h = mixed(ids.astype(np.int64).view(np.uint64) + _P)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(h + np.uint64(k) * step) % np.uint64(bits) for k in range(PROBES)]).astype(np.int64)


def sets_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes in reps (doc_id, node), and of others that joins leave out.

    A Bloom filter tells which texts are read again, so that texts needn't be shuffled. It grows with
    reps up to MOST_BITS; beyond, texts are joined with reps. What it lets through costs time only.
    """
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(CHUNKS)).cast("int").alias("part")
    docs = docs.where("doc_id IS NOT NULL")
    n = reps.count()
    if n * PER_ENTRY > MOST_BITS:
        rows, held = docs.join(reps.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text", part), None
    else:
        bits = max(LEAST_BITS, 1 << (n * PER_ENTRY).bit_length()) // CHUNKS

        def fill(batches):
            import pyarrow as pa

            own: dict[int, np.ndarray] = {}
            for batch in batches:
                number, at = batch.column("part").to_numpy(), _places(batch.column("doc_id").to_numpy(), bits)
                for k in np.unique(number).tolist():
                    p = at[:, number == k].ravel()
                    np.bitwise_or.at(own.setdefault(k, np.zeros(bits // 8, np.uint8)), p >> 3, (1 << (p & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([v.tobytes() for v in own.values()], pa.binary())], names=["part", "bits"])

        filled = np.zeros((CHUNKS, bits // 8), np.uint8)
        for k, b in reps.select(F.col("doc_id").cast("long").alias("doc_id"), part).repartition("part").mapInArrow(fill, "part int, bits binary").collect():  # MOST_BITS in all
            filled[k] |= np.frombuffer(b, np.uint8)
        rows, held = docs.select("doc_id", "text", part), docs.sparkSession.sparkContext.broadcast(filled)

    def found(batches):
        import pyarrow as pa

        known = Words()
        for batch in batches:
            maybe = np.ones(batch.num_rows, bool)
            if held is not None and batch.num_rows:
                at, number = _places(batch.column("doc_id").cast(pa.int64()).to_numpy(), bits), batch.column("part").to_numpy()
                maybe = (held.value[number, at >> 3] >> (at & 7).astype(np.uint8) & 1).all(0)
            got = [shingles(batch.column("text")[int(i)].as_py() or "", known) for i in np.flatnonzero(maybe)]
            got = [(signature(h), h.tobytes()) for h in got if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], names=["node", "hashes"])

    return rows.mapInArrow(lean(found), "node long, hashes binary")


def _compare(batches):
    """Each leader's set comes first, then those to be compared with it."""
    import pyarrow as pa

    own = None
    for batch in batches:
        out = []
        for lead, node, blob in zip(batch.column("leader"), batch.column("node"), batch.column("hashes")):
            lead, node, h = lead.as_py(), node.as_py(), np.frombuffer(blob.as_py(), np.uint64)
            if node == lead:
                own = h
            else:
                both = np.concatenate([own, h])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                out.append((node, lead, common, len(own) + len(h) - common))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["node", "leader", "common", "union"])


def compare(docs: DataFrame, pairs: DataFrame, reps: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, leader, common, union) of each pair (node, leader)."""
    pairs = scratch.keep(pairs.distinct(), f"{name}-pairs")
    used = pairs.select("node").union(pairs.select("leader")).distinct()
    used = scratch.keep(reps.join(used, "node").select("doc_id", "node"), f"{name}-used")
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / PER_SALT).alias("salts"))
    legs = pairs.join(salts, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), "salts").alias("salt"))
    legs = legs.union(salts.select(F.col("leader").alias("node"), "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")))
    # rows of one doc_id with different texts: others than the node's are left out by the join; of equal sets one is enough
    # pairs grow with the corpus, so they are not broadcast, however few they are
    rows = legs.hint("merge").join(sets_of(docs, used), "node")
    met = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("node") != F.col("leader"), "node").select("leader", "node", "hashes")
    out = met.mapInArrow(lean(_compare), "node long, leader long, common long, union long").distinct()
    return scratch.keep(out, f"{name}-compared")


def similar(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    scratch = Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    classes = spark.sparkContext.broadcast(frequency_classes(docs))  # COUNTERS bytes
    rows = scratch.keep(set_rows(docs, classes), "rows")
    worded = rows.where("node IS NOT NULL AND doc_id IS NOT NULL")
    entries = rows.select("node", "size", "common", F.posexplode("prefix").alias("pos", "shingle")).select("shingle", "node", "size", F.col("pos").cast("long").alias("pos"), "common")
    sorted_lists = entries.repartition("shingle").sortWithinPartitions("shingle", F.desc("common"), "size", "node")
    lists = scratch.keep(sorted_lists.mapInArrow(lean(_lists), ", ".join(f"{c} long" for c in LIST)), "lists")
    reps = scratch.keep(worded.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "reps")

    short, long = lists.where("shingle IS NULL"), lists.where("shingle IS NOT NULL")
    need = F.expr(f"({NUM} * (size + leader_size) + {NUM + DEN - 1}) div {NUM + DEN}")
    left = 1 + F.least(F.col("size") - F.col("pos") - 1, F.col("leader_size") - F.col("leader_pos") - 1)
    in_reach = (F.least("size", "leader_size") * DEN >= F.greatest("size", "leader_size") * NUM) & (left >= need)
    first = short.select("node", "leader").union(long.where((F.col("node") != F.col("leader")) & in_reach).select("node", "leader"))
    known = compare(docs, first, reps, scratch, "first")
    is_link = F.col("common") * DEN >= F.col("union") * NUM
    links = known.where(is_link).select(F.col("node").alias("u"), F.col("leader").alias("v"))
    comp = components(links, scratch, "first")

    # lists that are one component have nothing open
    named = long.join(comp.hint("merge"), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    mixed_lists = named.groupBy("shingle").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).where("a <> b").select("shingle", "n")
    named = scratch.keep(named.join(mixed_lists.hint("merge"), "shingle"), "open")
    distance = known.select("node", "leader", (1 - F.col("common") / F.col("union")).alias("dist"))
    leads = F.col("node") == F.col("leader")
    open_lists = named.join(distance, ["node", "leader"], "left").withColumn("dist", F.when(leads, 0.0).otherwise(F.col("dist"))).withColumn("leads", leads)
    spread = in_blocks(open_lists).repartition("shingle", "pair").sortWithinPartitions("shingle", "pair", "size", "node")
    rest = spread.mapInArrow(lean(_residual), "node long, leader long")
    found = compare(docs, rest, reps, scratch, "rest")
    links = links.union(found.where(is_link).select(F.col("node").alias("u"), F.col("leader").alias("v")))
    comp = components(links, scratch, "all")

    # a component's name is its smallest doc_id, not its smallest node
    named = reps.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = scratch.keep(named.join(least, "component").select("node", "component_id"), "named")
    out = rows.select("doc_id", F.col("size").alias("n_shingles"), "node").join(of_node, "node", "left")
    scratch.drop("lists", "open", "reps", *(f"{a}-{b}" for a in ("first", "rest") for b in ("pairs", "used", "compared")))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark, table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component: that of the smallest doc_id, null being the largest.

    Components are of rows, so rows of one doc_id or of none are told apart by their texts. A row
    without words is near no other; of those that repeat doc_id and text one stays.
    """
    scratch = Scratch(spark, "keep-one")
    rid, = unused(docs.columns, "rid")
    rows = scratch.keep(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    found = similar(spark, rows.select(F.col(rid).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("rid"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
    digest = F.when(F.col("text").isNull(), "-").otherwise(F.sha2("text", 256)).alias("digest")
    tie = row_digest(rows.select(*(F.col(f"`{c}`") for c in docs.columns))).alias("tie")
    known = rows.select(F.col(rid).alias("rid"), "doc_id", digest, tie).join(found, "rid")
    worded, rest = known.where("component IS NOT NULL"), known.where("component IS NULL")
    # rows are told apart by what they hold before their number, which follows partitions
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "tie", "rid"))["rid"].alias("rid")
    kept = worded.groupBy("component").agg(first).select("rid")
    kept = kept.union(rest.where("doc_id IS NULL").select("rid")).union(rest.where("doc_id IS NOT NULL").groupBy("doc_id", "digest").agg(F.min(F.struct("tie", "rid"))["rid"].alias("rid")).select("rid"))
    kept = scratch.keep(kept.withColumnRenamed("rid", rid), "kept")
    return rows.join(kept, rid, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


QUERIES = {"op7_ngram_jaccard": op7_ngram_jaccard}
ORACLE: dict[str, str] = {}
