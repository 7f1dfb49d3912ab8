"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from assetloom import workload

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as connection:
        for path in Path(SF).glob("*.parquet"):
            connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        yield connection


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_query(spark, db, name):
    df = workload.queries()[name](spark, SF)
    rows = df.collect()
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    if name not in workload.oracle_sql():
        assert rows
        return
    found = db.sql(workload.oracle_sql()[name])
    assert sorted(found.columns) == columns
    expected = [tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted(expected, key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(workload.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
