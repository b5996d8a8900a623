"""Every query with SQL against that SQL, on the smallest tables."""

import decimal
import math
from datetime import datetime

import duckdb
import pytest

from caselens.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return None if math.isnan(v) else round(float(v), 6)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime) else v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    cursor = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    key = sorted(names)
    assert sorted((tuple(plain(r[c]) for c in key) for r in rows), key=repr) == sorted((tuple(plain(r[names.index(c)]) for c in key) for r in want), key=repr)
