"""Every query with an SQL twin against DuckDB, on the smallest tables."""

import duckdb
import pytest

from tradeloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = want.select(*columns).fetchall()
    assert rows and plain(got.select(*columns).collect()) == plain(rows)  # a twin without rows proves nothing
