"""Every query of the catalogue against its DuckDB oracle, and the driver contract."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from cambium.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    if name not in catalog.ORACLE_SQL:
        assert found.count() > 0
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    plain = lambda row: tuple(round(v, 5) if isinstance(v, float) else v for v in row)
    assert Counter(map(plain, found.select(*want.columns).collect())) == Counter(map(plain, want.fetchall()))


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert {"frac_idx", "reads", "molecules", "saturation"} <= set(found.columns) and found.count() == 4
    known = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(known) and set(__spark_entry__.oracle_sql()) <= set(known)
