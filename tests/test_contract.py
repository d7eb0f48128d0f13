"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from contract.registry import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
NAMES = list(ORACLES)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def canonical(rows):
    return sorted(tuple("<null>" if v is None else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    ours = contract.queries()[name](spark, SF)
    columns = sorted(ours.columns)
    expected = duck.sql(contract.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = duck.sql(f"SELECT {quoted} FROM ({contract.oracle_sql()[name]})").fetchall()
    got = canonical(ours.select(*[f"`{c}`" for c in columns]).collect())
    assert got == canonical(theirs)
    assert got


def test_registration():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() == 7 and frame.columns[0] == "source"
