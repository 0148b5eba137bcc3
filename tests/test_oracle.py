"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import pytest

from gridregimes.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    rows = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        cells = []
        for v in row:
            v = None if v is None or v != v else v
            cells.append(str(v)[:10] if hasattr(v, "year") else bool(v) if type(v).__name__ in ("bool", "bool_") else float(v) if hasattr(v, "__float__") else v)
        rows.append(tuple(cells))
    return sorted(rows, key=lambda r: [(x is not None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-6) if all(isinstance(v, float) for v in x) else all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-6) for p, q in zip(x, y)), (x, y)
