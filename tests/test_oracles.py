"""Every query with a SQL twin gives the twin's rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tidefold.operators import catalogue


def rows(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 5) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    want = con.execute(catalogue.ORACLE_SQL[name]).df()
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    assert set(got.columns) == set(want.columns)
    assert rows(got) == rows(want)
