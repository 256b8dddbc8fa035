"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from latmix.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if v is None else float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted(repr([clean(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    number = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, [tuple(map(number, r)) for r in want.fetchall()])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
