"""Every named query against its SQL on the smallest tables; those without SQL must run."""

import math

import duckdb
import pytest

from lumenframe.plans import catalogue

FIXTURE = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SLOW = {"train_leaderboard_clf", "train_leaderboard_reg", "train_zoo_clf", "train_zoo_reg", "cv_search", "learning_curve"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FIXTURE}/{t}.parquet'")
    return c


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - SLOW))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, FIXTURE)
    rows = [tuple(r) for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert norm(rows, df.columns) == norm(want.fetchall(), want.columns)
