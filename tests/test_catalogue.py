"""Every query against its SQL, on the same files."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, int | float | np.number) and not isinstance(v, bool | np.bool_):
        return f"{float(v):.9g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE_SQL:
        assert len(found) > 0
        return
    wanted = duck.execute(ORACLE_SQL[name]).df()
    assert len(wanted) > 0
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry_registers_all():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_large_scans_prune_and_push(spark, sf_dir):
    plan = QUERIES["range_predicate"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,100), LessThan(o_orderkey,5000)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_latest_is_one_shuffle_without_sort(spark, sf_dir):
    plan = QUERIES["cdc_current_state"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Window" not in plan
