import duckdb
import pytest

from __spark_entry__ import entry
from entry_oracles import ORACLES
from entry_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ["events", "lineitem", "supplier"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    columns = sorted(column[0] for column in cursor.description)
    place = {column[0]: index for index, column in enumerate(cursor.description)}
    expected = sorted(repr([row[place[c]] for c in columns]) for row in cursor.fetchall())
    assert sorted(got.columns) == columns
    assert sorted(repr([row[c] for c in columns]) for row in got.collect()) == expected
    assert expected
