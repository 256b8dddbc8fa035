"""Connected components by contraction, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch

#: Rounds whose pointers are followed in one plan.
JOINED = 4


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (u long, v long).

    In a round every node points to the first of itself and its neighbours, in an order that is drawn
    anew for the round (by a hash), and the edges are drawn anew between what their ends point to. In
    any order of the nodes, along a chain as well, a fixed share of them is pointed to by no one, so
    rounds are logarithmic; a star is done after two. What is pointed to is aggregated with partial
    minima, so a node of very many links is one row a task. Names are given at the end: the smallest
    node that ended at the same place. Nothing but a count reaches the driver.
    """
    spark = edges.sparkSession
    live = scratch.keep(edges.select("u", "v").where("u <> v").distinct(), f"{name}-edges")
    steps: list[str] = []
    while not live.isEmpty():
        n = len(steps)
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        place = lambda c: F.struct(F.xxhash64(c, F.lit(n)).alias("place"), F.col(c).alias("at"))
        to = both.groupBy("u").agg(F.min(place("v")).alias("m")).select(F.col("u").alias("node"), F.least(place("u"), "m")["at"].alias("to"))
        to = scratch.keep(to, f"{name}-to{n}")
        steps.append(f"{name}-to{n}")
        at = lambda c: to.select(F.col("node").alias(c), F.col("to").alias(f"{c}2"))
        drawn = live.join(at("u"), "u").join(at("v"), "v").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
        live = scratch.keep(drawn.where("u <> v").distinct(), f"{name}-edges{n}")
        scratch.drop(f"{name}-edges{n - 1}" if n else f"{name}-edges")
    if not steps:
        scratch.drop(f"{name}-edges")
        return spark.createDataFrame([], "node long, component long")
    read = lambda step: spark.read.schema("node long, to long").parquet(scratch.path(step))
    last = read(steps[-1]).select("node", F.col("to").alias("root"))
    for k, step in enumerate(reversed(steps[:-1])):
        # where a node points may itself point on; what has no later pointer is final
        later = last.select(F.col("node").alias("to"), "root")
        last = read(step).join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        if k % JOINED == JOINED - 1:
            last = scratch.keep(last, f"{name}-roots{k}")
    last = scratch.keep(last, f"{name}-roots")
    least = last.groupBy("root").agg(F.min("node").alias("component"))
    out = scratch.keep(last.join(least, "root").select("node", "component"), f"{name}-components")
    scratch.drop(*steps, f"{name}-roots", *(f"{name}-roots{k}" for k in range(len(steps))), f"{name}-edges{len(steps) - 1}")
    return out
