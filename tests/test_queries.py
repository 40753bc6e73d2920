"""Every named query against its SQL on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from quarryline.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.date() if isinstance(v, datetime.datetime) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    got, want = QUERIES[name](spark, DATA), db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
