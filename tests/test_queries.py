"""Every regression query runs at the smallest scale, and those with SQL give its rows."""

import warnings

import pytest

duckdb = pytest.importorskip("duckdb")

from bayesmill import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in Q._TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        df = Q.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    if name not in Q.ORACLE_SQL:
        assert rows
        return
    cur = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a == tuple(pytest.approx(x, rel=1e-6, abs=1e-6) if isinstance(x, float) else x for x in b)
