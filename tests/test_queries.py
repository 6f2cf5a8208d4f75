"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from larkspur.plans import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"oof_gbt", "residual_oof", "edge_crossfit", "fusion_oof", "text_residual_oof", "feature_search"}  # test_boost.py holds what they are made of


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    return sorted((tuple(map(plain, r)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL)))
def test_query_matches_sql(spark, con, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    sql = con.sql(f"SELECT {listed} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert rows(columns, df.select(*columns).collect()) == rows(columns, sql)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - SLOW))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_know_the_subpackage():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(top, "larkspur")):
        if "llm" not in folder.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    assert "llm import" not in open(os.path.join(folder, n)).read().replace("llm_", "")
