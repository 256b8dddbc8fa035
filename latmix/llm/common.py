"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session has none and all runs in one process (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="latmix-")
        spark.sparkContext.setCheckpointDir(given)
        given = f"file://{given}"
    return given.rstrip("/")


class Scratch:
    """Tables of one run under the shared folder: lineage is cut by writing and rereading."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/latmix-{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing lazy reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def unused(taken, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``taken`` needs; case is no difference."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def row_digest(df: DataFrame) -> Column:
    """What tells rows apart that agree in their texts, however they are dealt: a digest of all other columns."""
    return F.md5(F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in df.columns if c != "text"))))


def give_back() -> None:
    """Returns what this process has freed to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run):
    """A function for mapInArrow that gives its memory back at a task's end: idle workers stay alive beside the next stages."""

    def all_of(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return all_of
