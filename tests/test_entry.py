"""Driver contract at sf0.001: entry() runs, every query runs, and every query
with an oracle agrees with DuckDB (columns and rows)."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v == int(v) and abs(v) < 2 ** 53 else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry(spark):
    rows = dict(E.entry(spark).collect())
    assert rows == {"DMG": 9, "del": 11, "new": 12, "ok": 162, "old": 9, "upd": 8}


def test_every_query_matches_its_oracle(spark, con):
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 40
    bad = []
    for name, q in qs.items():
        got = q(spark, SF001).toPandas()
        if name not in sql:
            assert len(got.columns) > 0
            continue
        if _rows(got) != _rows(con.execute(sql[name]).fetchdf()):
            bad.append(name)
    assert bad == []
