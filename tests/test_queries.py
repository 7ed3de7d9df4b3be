"""Every named query with SQL against DuckDB on the small tables, and every other one for rows."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.workload import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 9)
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["item_id", "rank", "doc_id", "score"]


def test_nothing_else_imports_the_training_data_part():
    root = os.path.dirname(entry.__file__)
    for folder, _, names in os.walk(os.path.join(root, "tessera")):
        if not folder.endswith("llm"):
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    text = file.read()
                assert not re.search(r"\bllm\b", text), f"{folder}/{name}"
