"""Every page query against its SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from sitegrain.plans import crawling, findings, proofs, slate  # noqa: F401  the others add to the slate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations clicks sales clients client_changes items".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return float(value) if type(value).__name__ == "Decimal" else value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(slate.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    found = slate.QUERIES[name](spark, SF)
    expected = duck.sql(slate.ORACLES[name])
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(expected.columns, expected.fetchall())
