"""Every query with SQL gives DuckDB's rows on the smallest tables; every other one runs."""

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def one(v):
        if hasattr(v, "year"):
            return str(v).removesuffix(" 00:00:00")
        return round(float(v), 4) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    got = catalog.queries()[name](spark, sf)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
    assert plain(rows) == plain(want)
