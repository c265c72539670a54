"""Every registered query of the engine against its SQL on the small tables."""

import duckdb
import pytest

from littoral.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    if name not in catalog.ORACLE_SQL:
        return
    got = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=key)
