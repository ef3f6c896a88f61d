"""Every query that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from syntenia import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(df, columns):
    value = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(value(v) for v in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, db, name):
    found, expect = Q.queries()[name](spark, DATA).toPandas(), db.sql(Q.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expect.columns) and rows(found, columns) == rows(expect, columns)
