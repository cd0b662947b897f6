"""Every registered query against its SQL counterpart in another engine."""

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_module.QUERIES, entry_module.ORACLES


@pytest.fixture(scope="module")
def other_engine(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, other_engine, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in frame.collect()), key=repr)
    result = other_engine.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in order] for r in result.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())
