"""Every registered query of the corpus operators against its SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from corpusloom.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "∅"
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, float):
            return f"{x:.6f}".rstrip("0").rstrip(".") if x else "0"
        return str(x)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    assert len(got)
