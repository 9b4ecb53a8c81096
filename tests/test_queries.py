"""Every named query outside the training-data part against its SQL, over the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from loomspan.plans import catalogue, folds, inventory, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_agrees_with_its_sql(spark, views, name):
    assert catalogue and folds and inventory
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    result = views.execute(registry.ORACLE[name])
    named = [d[0] for d in result.description]
    assert sorted(named) == columns
    want = sorted(([plain(r[named.index(c)]) for c in columns] for r in result.fetchall()), key=repr)
    assert got == want
