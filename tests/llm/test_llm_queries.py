import duckdb
import pytest

from barlake.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    expected = sorted(cursor.fetchall(), key=repr)
    assert sorted((tuple(row[c] for c in columns) for row in got.collect()), key=repr) == expected
    assert expected


def test_the_pipeline_is_registered():
    from __spark_entry__ import queries

    assert {"pipeline", *QUERIES} <= set(queries())
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
