import math

import duckdb
import pytest

from commitloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "documents lineitem events labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, base, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    res = base.execute(registry.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in res.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr) == want
