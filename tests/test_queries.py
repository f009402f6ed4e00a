"""Every registered commerce query against its SQL, on the provided tables."""

import math
from pathlib import Path

import duckdb
import pytest

from millrace import catalogue

DATA = Path("/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    want = con.execute(catalogue.SQL[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = [tuple(r[k] for k in order) for r in want.fetchall()]
    df = catalogue.QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == columns
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert len(found) == len(rows) > 0
    key = lambda r: tuple((x is None, str(x)) for x in r)
    for a, b in zip(sorted(found, key=key), sorted(rows, key=key), strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)
