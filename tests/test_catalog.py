"""Every query of the catalogue against an independent engine over the same files."""

import decimal
import os

import pytest

from tessaline.plans import registry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else pytest.skip("the tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con, sf_dir


def same(v):
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    con, sf_dir = duck
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(map(same, r)) for r in df.select(*columns).collect()]
    if name not in registry.oracle_sql():
        assert got
        return
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(same(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert want or name == "O3_limit_zero"


def test_flagship(spark, duck):
    assert registry.flagship(spark, duck[1]).count() == 6
