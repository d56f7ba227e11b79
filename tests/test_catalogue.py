"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from basestream.plans import catalogue, further  # noqa: F401

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*sorted(df.columns)).collect())
    if name not in catalogue.SQL:
        assert got
        return
    cur = duck.execute(catalogue.SQL[name])
    cols = [c[0] for c in cur.description]
    at = sorted(range(len(cols)), key=cols.__getitem__)
    assert sorted(df.columns) == sorted(cols)
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_broken_functions_show(spark, monkeypatch):
    monkeypatch.setattr(catalogue.lookups, "same_headers", lambda a, b: spark.range(1).selectExpr("true as compatible"))
    assert not catalogue.QUERIES["header_compatible"](spark, DATA).first()["compatible"]
    called = []
    comments = catalogue.trace.comments
    monkeypatch.setattr(catalogue.trace, "comments", lambda info: called.append(1) or comments(info))
    assert catalogue.QUERIES["comment_fields"](spark, DATA).count() and called
