"""Near-duplicate embeddings by PCA-ordered tiled comparison, exact.

Vectors are compared within a label. Equal vectors are one class first. Unit vectors are rotated to
the principal axes (of the second moments of all of them), so that leading dimensions carry most of
a product. Rows are range-partitioned by label and leading coordinate and cut into tiles of at most
TILE rows; a hot label spans partitions. Tiles meet in pairs of groups of GROUP tiles, so that a tile
travels once for GROUP tiles that it is compared with; groups meet only if their boxes come near
enough, and so do tiles. Within a pair of tiles products accumulate by blocks of dimensions; what is left is bounded by the
product of the suffix norms, and a pair is dropped as soon as the bound is under the threshold.

A pair of tiles reports for every row the number of its links and one root of its linked rows there,
never the links themselves: a group of m copies makes m rows, not m * m. Components are drawn from
(row, root) by contraction.

Null, zero, non-finite vectors and null labels: no links, own component. Vectors of different length
are not compared. Repeated rows count as vectors of their own. An empty table: no rows. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, lean, table
from .graph import components
from .vectors import second_moments, unit, usable

THRESHOLD, TILE, GROUP, STEP, BOX, ROWS = 0.93, 2048, 8, 16, 8, 256


def tiles(classes: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """(label, d, tile, lo, hi, ids, counts, rows): rotated unit vectors, at most TILE of one label each."""

    def first(batches):
        import pyarrow as pa

        for batch in batches:
            c = np.array([unit(np.array([v.as_py()]))[0] @ axes[len(v)][:, 0] for v in batch.column("x")])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c, pa.float64())], names=[*batch.schema.names, "c"])

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number, held, key = TaskContext.get().partitionId(), 0, [], None

        def tile(rows):
            nonlocal number
            x = unit(np.array([r[2] for r in rows])) @ axes[key[1]]
            number += 1
            cols = [[key[0]], [key[1]], [task << 32 | number], [x[:, :BOX].min(0).tolist()], [x[:, :BOX].max(0).tolist()], [np.array([r[0] for r in rows], np.int64).tobytes()], [np.array([r[1] for r in rows], np.int64).tobytes()], [x.tobytes()]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["label", "d", "tile", "lo", "hi", "ids", "counts", "rows"])

        for batch in batches:
            for label, d, rep, n, x in zip(*(batch.column(c).to_pylist() for c in ("label", "d", "rep", "n", "x"))):
                if held and (key != (label, d) or len(held) == TILE):
                    yield tile(held)
                    held = []
                key = (label, d)
                held.append((rep, n, x))
        if held:
            yield tile(held)

    rows = classes.select(F.col("label").cast("long").alias("label"), "d", "rep", "n", "x").mapInArrow(first, "label long, d int, rep long, n long, x array<double>, c double")
    sorted_rows = rows.repartitionByRange("label", "d", "c").sortWithinPartitions("label", "d", "c")
    return sorted_rows.mapInArrow(cut, "label long, d int, tile long, lo array<double>, hi array<double>, ids binary, counts binary, rows binary")


def linked(a: np.ndarray, b: np.ndarray, same: bool, threshold: float):
    """Yields index arrays (i, j) of the pairs with product >= threshold; i < j where both are one tile."""
    d = a.shape[1]
    cuts = [*range(0, d, STEP), d]
    suffix = [[np.sqrt((m[:, c:] ** 2).sum(1)) for c in cuts] for m in (a, b)]
    slack = 1e-12
    for at in range(0, len(a), ROWS):
        part = a[at : at + ROWS]
        low = at if same else 0
        got = part[:, : cuts[1]] @ b[low:, : cuts[1]].T
        keep = got + np.outer(suffix[0][1][at : at + ROWS], suffix[1][1][low:]) >= threshold - slack
        i, j = np.nonzero(keep)
        got = got[i, j]
        i, j = i + at, j + low
        if same:
            ok = i < j
            i, j, got = i[ok], j[ok], got[ok]
        for k in range(1, len(cuts) - 1):
            if not len(i):
                break
            s = slice(cuts[k], cuts[k + 1])
            got = got + np.einsum("ij,ij->i", a[i, s], b[j, s])
            ok = got + suffix[0][k + 1][i] * suffix[1][k + 1][j] >= threshold - (slack if k + 2 < len(cuts) else 0)
            i, j, got = i[ok], j[ok], got[ok]
        if len(i):
            ok = got >= threshold
            yield i[ok], j[ok]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n by the links."""
    root = np.arange(n)
    while len(i):
        to = np.arange(n)
        np.minimum.at(to, i, j)
        np.minimum.at(to, j, i)
        while (to[to] != to).any():  # a chain of pointers is followed to its end, so rounds are few
            to = to[to]
        root = to[root]
        i, j = to[i], to[j]
        live = i != j
        pairs = np.unique(np.stack([i[live], j[live]], 1), axis=0)
        i, j = pairs[:, 0], pairs[:, 1]
    while (root[root] != root).any():
        root = root[root]
    return root


def _compare(threshold):
    """The first group's tiles are held, the second's are read past them; a group alone meets itself."""

    def links(p, q):
        import pyarrow as pa

        (tile, lo, hi, ids, counts, a), same = p, p[0] == q[0]
        b, shift = a, 0
        gap = np.maximum(np.maximum(lo - q[2], q[1] - hi), 0)
        if (gap**2).sum() > 2 - 2 * threshold + 1e-9:
            return
        if not same:
            b, shift, ids, counts = q[5], len(a), np.concatenate([ids, q[3]]), np.concatenate([counts, q[4]])
        degree, fi, fj = np.zeros(len(ids)), [], []
        for i, j in linked(a, b, same, threshold):
            j = j + shift
            degree += np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
            # a forest of each part is enough to know what hangs together
            r = roots(len(ids), i, j)
            moved = np.flatnonzero(r != np.arange(len(ids)))
            fi.append(moved)
            fj.append(r[moved])
        if not fi:
            return
        r = roots(len(ids), np.concatenate(fi), np.concatenate(fj))
        hit = np.flatnonzero(degree)
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(degree[hit].astype(np.int64)), pa.array(ids[r[hit]])], names=["rep", "links", "root"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if (row["label"], row["d"], row["g"], row["g2"]) != key:
                    held, key = [], (row["label"], row["d"], row["g"], row["g2"])
                tile = (row["tile"], np.array(row["lo"]), np.array(row["hi"]), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["rows"]).reshape(-1, row["d"]))
                if not row["second"]:
                    held.append(tile)
                if row["second"] or row["g"] == row["g2"]:
                    for other in held:
                        yield from links(other, tile)

    return run


def near_duplicates(spark: SparkSession, embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    scratch = Scratch(spark, "embed")
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = embeddings.select("vec_id", "label", "embedding").withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # equal vectors by two hashes together; to miss that two are equal would cost time only
    rows = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.hash("embedding")).withColumn("d", F.size("embedding"))
    key = ["label", "d", "k1", "k2"]
    classes = rows.where("ok").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first(x).alias("x"))
    classes = scratch.keep(classes, "classes")
    axes = {}
    for d, (_, s) in second_moments(classes).items():
        axes[d] = np.linalg.eigh(s)[1][:, ::-1].copy()
    # labels of any type: their numbers serve where they are whole numbers, hashes of them otherwise
    kind = embeddings.schema["label"].dataType.typeName()
    number = F.col("label") if kind in ("integer", "long", "short", "byte") else F.xxhash64("label")
    made = scratch.keep(tiles(classes.withColumn("label", number), axes), "tiles")
    # tiles of a label in the order of its leading coordinate; of each only its box takes part here
    number = F.expr(f"(row_number() over (partition by label, d order by tile) - 1) div {GROUP}")
    place = scratch.keep(made.select("label", "d", "tile", "lo", "hi").withColumn("g", number), "places")
    ends = lambda c, f: F.array(*(f(F.get(c, k)) for k in range(BOX))).alias(c)
    box = place.groupBy("label", "d", "g").agg(ends("lo", F.min), ends("hi", F.max))
    other = box.select("label", "d", F.col("g").alias("g2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    apart = lambda v: F.coalesce(F.greatest(v["lo"] - v["hi2"], v["lo2"] - v["hi"], F.lit(0.0)), F.lit(0.0))
    gap = F.aggregate(F.arrays_zip("lo", "hi", "lo2", "hi2"), F.lit(0.0), lambda t, v: t + F.pow(apart(v), 2))
    pairs = box.join(other, ["label", "d"]).where((F.col("g") <= F.col("g2")) & (gap <= 2 - 2 * threshold + 1e-9)).select("label", "d", "g", "g2")
    legs = pairs.withColumn("second", F.lit(False)).withColumn("own", F.col("g")).union(pairs.where("g < g2").withColumn("second", F.lit(True)).withColumn("own", F.col("g2")))
    of_tile = legs.join(place.select("label", "d", F.col("g").alias("own"), "tile"), ["label", "d", "own"]).select("g", "g2", "second", "tile")
    met = of_tile.join(made, "tile").repartition("label", "d", "g", "g2").sortWithinPartitions("label", "d", "g", "g2", "second", "tile")
    found = scratch.keep(met.mapInArrow(lean(_compare(threshold)), "rep long, links long, root long"), "found")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch, "links")
    of_class = classes.select(*key, "rep", "n").join(degree, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = scratch.keep(of_class.select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "classes-out")
    out = rows.where("ok").select("vec_id", *key).join(of_class, key).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    out = out.union(rows.where("NOT ok").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    scratch.drop("classes", "tiles", "places", "found", "links-components")  # of_class is written
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


_OK = "list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda v: NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0"
QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
ORACLE = {
    "op4_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, label IS NOT NULL AND embedding IS NOT NULL AND coalesce({_OK}, false) AS ok FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(u, w) AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS m FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id"""
}
