"""Every query of the subpackage against its SQL, on the smallest tables."""

import os
import sys

import duckdb
import pytest

from apexframe.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = os.environ.get("APEXFRAME_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    answer = database.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(answer.columns)
    names = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
    wanted = sorted(str([plain(r[answer.columns.index(c)]) for c in names]) for r in answer.fetchall())
    assert got and got == wanted


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_numbered(name):
    assert name.split("_")[0] in {f"op{n}" for n in range(1, 14)}
