"""Every query against its SQL, as multisets of rows with doubles to 6 places."""

import math
from collections import Counter

import duckdb
import pytest
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF if name in catalog.SQL else "/root/testdata/sf0.1")  # folds need more rows to do anything
    cols = sorted(df.columns)
    got = Counter(tuple(map(norm, r)) for r in df.select(*cols).collect())
    if name not in catalog.SQL:
        assert got
        return
    rel = con.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    want = Counter(tuple(map(norm, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})").fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
