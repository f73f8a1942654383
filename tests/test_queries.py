"""Every registered query against its SQL on the smallest tables.

The slowest ones only run with APEXFRAME_ALL=1.
"""

import datetime
import os

import pytest

from apexframe.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")

FOLDER = os.environ.get("APEXFRAME_TABLES", "/root/testdata/sf0.001")
SLOW = {
    "mlp2_fit_and_evaluate", "mlp4_holdout", "mlp7_predict_race", "mlp7_one_race_one_leader", "mlp8_prediction_run", "mlp8_one_race_one_leader", "str1_six_streams", "positions_enriched", "prj8_samples_of_laps",
    "prediction_lap_chart", "snk5_session_table",
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def sorted_rows(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(([plain(row[i]) for i in order] for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    if name in SLOW and not os.environ.get("APEXFRAME_ALL"):
        pytest.skip("slow")
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    assert got
    if name in ORACLES:
        answer = database.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(answer.columns)
        assert sorted_rows(df.columns, got) == sorted_rows(answer.columns, answer.fetchall())


def test_every_query_is_exposed():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(QUERIES)
