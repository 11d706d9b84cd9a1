"""Every query of the library's own operators against its SQL."""

import math

import duckdb
import pytest

from tidemark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    names = sorted(table.column_names)
    said = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return names, sorted(tuple(said(r[c]) or "" for c in names) for r in table.to_pylist())


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, sql, name):
    import pyarrow as pa

    got = rows(catalog.queries()[name](spark, sf_dir).toArrow())
    want = rows(pa.Table.from_pandas(sql.execute(catalog.oracle_sql()[name]).df(), preserve_index=False))
    assert got == want
