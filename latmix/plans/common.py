"""What the registered queries share: inputs with injected gaps, and rounding alike in both engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For values of few decimals, which lie on the edge between two rounded ones: an edge that none lies on.
OFF = 0.4937


def r(c: Column | str, digits: int = 6, half: float = 0.5) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(10.0**digits) + half) / F.lit(10.0**digits)


def rs(text: str, digits: int = 6, half: float = 0.5) -> str:
    return f"(floor(({text}) * 1e{digits} + {half!r}::DOUBLE) / 1e{digits})"


#: lineitem with gaps in two channels, scaled to like ranges.
GAPS = """(SELECT *, l_quantity / 10e0 AS x1, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 50e0 END AS x2,
 CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_tax * 50e0 END AS x3 FROM lineitem)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity",
        (F.col("l_quantity") / 10.0).alias("x1"),
        F.when(line % 3 != 0, F.col("l_discount") * 50.0).alias("x2"),
        F.when(line % 4 != 0, F.col("l_tax") * 50.0).alias("x3"),
    )
