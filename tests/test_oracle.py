"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import duckdb
import pytest

from chatlake.plans import catalog
from chatlake.sources.tables import TEST_TABLES
from tools.oracle_check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    scols, srows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.ORACLE:
        pytest.skip("no SQL oracle")
    res = duck.execute(catalog.ORACLE[name])
    dcols, drows = rows_of([d[0] for d in res.description], res.fetchall())
    assert scols == dcols
    assert srows == drows


def test_every_query_has_an_oracle():
    import __spark_entry__ as entry
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert len(catalog.QUERIES) >= 70
