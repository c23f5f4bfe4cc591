"""Every registered query against its SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from velarium.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got
        return
    r = duck.execute(ORACLES[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == table(columns, r.fetchall())


def test_partitioning_does_not_change_results(spark):
    for name in ("id_suffixing", "collision_types", "rule_scorer_topk", "metric_forecast"):
        a = sorted(map(repr, QUERIES[name](spark, SF).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = sorted(map(repr, QUERIES[name](spark, SF).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert a == b
