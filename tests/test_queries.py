"""Every query against its SQL in DuckDB, over the whole tables of the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from graphloom.plans.catalogue import QUERIES, SQL

from .conftest import SMALL


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(SMALL):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    return connection


def canonical(rows: list, columns: list[str]) -> tuple:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, SMALL)
    wanted = tables.execute(SQL[name])
    assert canonical([tuple(r) for r in found.collect()], found.columns) == canonical(wanted.fetchall(), [d[0] for d in wanted.description])


def test_all_but_html_have_sql():
    assert set(QUERIES) - set(SQL) == {"html_sections"}


def test_entry_module(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_import_the_corpus_part():
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "graphloom"
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert "llm" not in file.read_text(), file
