"""Each catalogue query against its SQL on the smallest tables."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

from strandline.plans import ledger_queries, record_queries
from strandline.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or not isinstance(v, (int, float, Decimal)):
        return str(v) if not isinstance(v, datetime.datetime) else v.isoformat()
    return round(float(v), 9)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.fixture(scope="module", autouse=True)
def one_ledger():
    """The stand-in ledger is built once for all queries here; a query of its own builds its own."""
    held, build = {}, ledger_queries._ledger

    def kept(spark, d):
        if d not in held:
            held[d] = build(spark, d)
        return held[d]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ledger_queries, "_ledger", kept)
        patch.setattr(record_queries, "_ledger", kept)
        yield


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=str)
    result = con.execute(SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(_value(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=str)
    assert got == want
