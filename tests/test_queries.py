"""Every registered query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from tallyframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = registry.load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", [n for n, v in REGISTRY.items() if v[2]])
def test_query_equals_sql(spark, duck, sf_dir, name):
    run, _, sql = REGISTRY[name]
    df = run(spark, sf_dir)
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n, v in REGISTRY.items() if not v[2]])
def test_query_reruns_alike(spark, sf_dir, name):
    run = REGISTRY[name][0]
    first = sorted(map(str, run(spark, sf_dir).collect()))
    assert first and first == sorted(map(str, run(spark, sf_dir).collect()))


def test_names_are_unique_and_entry_runs(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    assert e.entry(spark).count() > 0
