"""Observation frames: canonical missing values, pattern codes, weights and masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def canonical(df: DataFrame, cols: list[str], finite: bool = False) -> DataFrame:
    """NaN becomes NULL, and with ``finite`` what is infinite too; values become doubles."""
    fine = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")) if finite else ~F.isnan(x)
    return df.withColumns({c: F.when(fine(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols})


def pattern_code(cols: list[str]) -> Column:
    """Bit p - 1 is set where channel p is observed."""
    return reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(cols))).cast("long")


def code_bits(code: Column, p: int) -> Column:
    return F.array(*(F.getbit(code, F.lit(i)).cast("boolean") for i in range(p)))


def bits_code(bits: Column) -> Column:
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b, F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop("any", subset=cols)


def reinsert(all_rows: DataFrame, scored: DataFrame, key: str, fill: dict) -> DataFrame:
    """Rows that were dropped come back with the given values."""
    return all_rows.select(key).join(scored, key, "left").fillna(fill)


def modality_mask(f: Column, modality: str, only_nan: bool = False) -> Column:
    """MR: finite and positive (not negative if only_nan). CT: finite, not 0 and within (-1020, 3000)."""
    finite = F.coalesce(~F.isnan(f) & (F.abs(f) < float("inf")), F.lit(False))
    if modality == "CT":
        return finite if only_nan else finite & (f != 0) & (f > -1020) & (f < 3000)
    if modality.lower() == "mri":
        return finite & ((f >= 0) if only_nan else (f > 0))
    raise ValueError(f"unknown modality {modality}")


def ranges(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest of each channel, missing values left out."""
    row = df.agg(*(f(c).alias(f"{c}_{n}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi")))).head()
    return {c: (row[f"{c}_lo"], row[f"{c}_hi"]) for c in cols}
