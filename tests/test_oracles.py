"""Every query with an oracle returns what the oracle's SQL returns on the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from larkspur import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracles()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        assert rows
    else:
        r = con.execute(ORACLES[name])
        found = [d[0] for d in r.description]
        assert sorted(found) == columns
        want = sorted((tuple(plain(x[found.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
        assert sorted((tuple(plain(x[c]) for c in columns) for x in rows), key=repr) == want
