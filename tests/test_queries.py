"""Every query against its SQL on the smallest tables."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

from plumbline import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sql, name):
    df = queries.queries()[name](spark, SF)
    got = df.collect()
    done = sql.execute(queries.oracle_sql()[name])
    names = [c[0] for c in done.description]
    want = done.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([plain(r[n]) for n in sorted(names)]) for r in got) == sorted(repr([plain(r[names.index(n)]) for n in sorted(names)]) for r in want)
