"""Scalar functions on the edge rows."""

import pytest
from pyspark.sql import functions as F

from apexframe.functions import durations as D
from apexframe.functions import names as N
from apexframe.functions import records as R


def values(spark, ddl, inputs, make):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i INT, x {ddl}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("x"))).collect()]


DURATIONS = ["0 days 00:01:32.123000", "1 days 00:00:05", "-1 days +23:59:59", "01:32.123", "1:32.123", "92.1", "NaT", "", None]


def test_clean_duration(spark):
    assert values(spark, "STRING", DURATIONS, D.clean_duration) == [
        "00:01:32.123000", "00:00:05", "-1 days +23:59:59", "01:32.123", None, None, None, None, None,
    ]


def test_clean_duration_can_keep_days(spark):
    got = values(spark, "STRING", ["1 days 02:00:05", "0 days 00:01:00", "00:00:07"], lambda c: D.clean_duration(c, keep_days=True))
    assert got == ["26:00:05", "00:01:00", "00:00:07"]


def test_duration_seconds(spark):
    inputs = ["0:01:32.123", "1:32.123", "92.1", "NaT", "", None, "1:xx", "1:2:3:4", "x:10", "1.5:30", "92.1d"]
    got = values(spark, "STRING", inputs, D.duration_seconds)
    assert got[:3] == pytest.approx([92.123, 92.123, 92.1])
    assert got[3:] == [None] * 8


def test_lap_time_text_is_unpadded(spark):
    assert values(spark, "DOUBLE", [65.5, None, 300.0], D.format_lap_time) == ["1:5.500", "", "5:0.000"]


def test_gap_texts(spark):
    assert values(spark, "DOUBLE", [1.5, -61.0, 0.0, None], D.format_signed_gap) == ["+0:1.500", "-1:1.000", "0.000", "0.000"]
    assert values(spark, "DOUBLE", [0.0, 12.5, 61.5, None], D.format_leader_gap) == ["Leader", "+12.500s", "+1m 1.500s", None]


def test_clock_text(spark):
    assert values(spark, "DOUBLE", [3725.5], D.format_clock) == ["01:02:05.500"]
    assert values(spark, "DOUBLE", [3725.5], lambda c: D.format_clock(c, pad_hours=False)) == ["1:02:05.500"]


def test_team_rules_by_substring_and_by_word(spark):
    teams = ["Williams", "Haas F1 Team", "RB", "AlphaTauri", "Scuderia Ferrari", "Nobody", "", None]
    assert values(spark, "STRING", teams, N.normalize_team) == [
        "Aston Martin", "Aston Martin", "Red Bull Racing", "Alpine", "Ferrari", "Nobody", "Unknown", "Unknown",
    ]
    assert values(spark, "STRING", teams[:4], lambda c: N.normalize_team(c, mode="token")) == [
        "Williams", "Haas", "Red Bull Racing", "Racing Bulls",
    ]


def test_driver_names(spark):
    got = values(spark, "STRING", ["ver", "Norris", "Kimi", None], N.normalize_driver)
    assert got == ["Max Verstappen", "Lando Norris", "Kimi", "Unknown"]
    assert values(spark, "STRING", ["LEC", "BOT"], N.team_of_driver) == ["Ferrari", "Unknown"]


def test_colours(spark):
    assert values(spark, "STRING", ["RB", "Red Bull", "Nobody", None], N.team_colour) == ["#C8C8C8", "#3671C6", "#FFFFFF", "#FFFFFF"]
    assert values(spark, "STRING", ["Nobody", None], lambda c: N.team_colour(c, F.lit(3))) == ["#F91536", "#F91536"]


def test_position_categories(spark):
    rows = spark.createDataFrame(
        [(1, 3, "Finished", 15.0), (2, None, "DNF", 1.0), (3, None, "DNS", 0.0), (4, None, "DSQ", 0.0), (5, 11, "DNF", 0.0), (6, 12, "x", None)],
        "i INT, p INT, s STRING, pts DOUBLE",
    ).orderBy("i")
    ingest = [r[0] for r in rows.select(R.position_category(F.col("p"), F.col("s"), F.col("pts"))).collect()]
    serving = [r[0] for r in rows.select(R.position_category(F.col("p"), F.col("s"), serving=True)).collect()]
    assert ingest == ["Podium", "Points", "DNS", "Disqualified", "DNF", "No Points"]
    assert serving == ["Podium", "DNF", "No Points", "No Points", "DNF", "No Points"]


def test_distance_stays_null_while_coordinates_become_zero(spark):
    df = spark.createDataFrame([(3.0, 4.0, None), (None, 1.0, 2.0)], "X DOUBLE, Y DOUBLE, Z DOUBLE")
    assert [tuple(r) for r in R.position_distance(df).collect()] == [(3.0, 4.0, 0.0, 5.0), (0.0, 1.0, 2.0, None)]


def test_valid_lap_bounds_and_deleted_marks(spark):
    rows = [(29.999, False), (30.0, False), (300.0, None), (300.001, False), (90.0, True), (None, False)]
    df = spark.createDataFrame(rows, "LapTimeSeconds DOUBLE, Deleted BOOLEAN")
    assert sorted(r[0] for r in df.filter(R.is_valid_lap()).collect()) == [30.0, 300.0]


def test_record_id_repeats(spark):
    df = spark.createDataFrame([("44", None)], "Driver STRING, Time STRING")
    first, second = (df.select(R.record_id("Driver", "Time")).first()[0] for _ in range(2))
    assert first == second and len(first) == 64


def test_half_even(spark):
    assert values(spark, "DOUBLE", [0.25, 0.35, 2.5], lambda c: R.half_even(c, 1)) == [0.2, 0.4, 2.5]
    assert values(spark, "DOUBLE", [0.5, 1.5, 2.5], R.half_even) == [0.0, 2.0, 2.0]
