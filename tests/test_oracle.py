"""Every core query against its SQL on the smallest data."""

import os

import duckdb
import pytest

from packlake.plans import catalogue


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def connection(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, connection, name):
    rows = catalogue.QUERIES[name](spark, data)
    columns = sorted(rows.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in rows.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert rows.schema is not None
        return
    done = connection.execute(catalogue.ORACLES[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in done.fetchall()), key=repr)
    assert found == want
