"""Each query against its SQL in DuckDB, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from idsets.queries import oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return connection


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    got = queries()[name](spark, SF_DIR)
    names = got.columns
    cursor = duck.execute(oracle_sql()[name])
    expected_names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert sorted(names) == sorted(expected_names)
    assert rows_of(map(tuple, got.collect()), names) == rows_of(expected, expected_names)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())
