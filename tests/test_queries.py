"""Each query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from turnlake.plans import audits, catalogue

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return tuple(value) if isinstance(value, list) else value


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


QUERIES, ORACLE_SQL = catalogue.QUERIES | audits.QUERIES, catalogue.ORACLE_SQL | audits.ORACLE_SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    found = QUERIES[name](spark, str(SF))
    rows = [tuple(r) for r in found.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    wanted = sql.execute(ORACLE_SQL[name])
    columns = [x[0] for x in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, rows) == rows_of(columns, wanted.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 20
