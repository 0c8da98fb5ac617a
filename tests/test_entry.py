"""The registered queries run, and those with SQL give the same rows as DuckDB."""

import ast
import collections
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from wavestrata.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_equal_the_oracle(spark, data, tables, name):
    df = catalogue.QUERIES[name](spark, data)
    found = tables.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = collections.Counter(str(r) for r in found.fetchall())
    assert collections.Counter(str(tuple(r[c] for c in names)) for r in df.collect()) == expected


def test_queries_without_oracle_give_rows(spark, data):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, data).count() > 0


def test_nothing_else_imports_the_llm_subpackage():
    root = Path(__file__).resolve().parents[1]
    for path in (root / "wavestrata").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(".llm" in n or n == "corpus_pipeline" for n in names), path
