"""Interval assignment against brute force, with overlaps, touching laps and a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from apexframe.operators.intervals import assign_interval, assign_laps, lap_spans


def brute(points, spans, inside):
    return {i: min((p for k2, s, e, p in spans if k2 == k and inside(s, t, e)), default=None) for i, k, t in points}


def ticks(x):
    return round(x * 1e6)


@pytest.mark.parametrize("mode", ["closed", "half"])
def test_overlapping_spans(spark, mode):
    random.seed(11)
    spans = []
    for _ in range(150):
        start = round(random.random() * 100, 3)
        spans.append((0 if random.random() < 0.5 else random.randint(1, 4), start, round(start + random.random() * 25, 3), float(random.randint(1, 99))))
    points = [(i, random.randint(0, 5), round(random.random() * 130, 3)) for i in range(600)]
    points += [(1000 + i, s[0], s[1]) for i, s in enumerate(spans)] + [(2000 + i, s[0], s[2]) for i, s in enumerate(spans)]
    got = assign_interval(
        spark.createDataFrame(points, "id INT, k INT, t DOUBLE"), spark.createDataFrame(spans, "k INT, s DOUBLE, e DOUBLE, lap DOUBLE"),
        ["k"], "t", "s", "e", "lap", mode=mode,
    )
    if mode == "closed":
        expected = brute(points, spans, lambda s, t, e: ticks(s) <= ticks(t) <= ticks(e))
    else:
        expected = brute(points, spans, lambda s, t, e: ticks(s) <= ticks(t) < ticks(e))
    assert {r.id: r.lap for r in got.collect()} == expected


@pytest.mark.parametrize("descending", [False, True])
def test_touching_laps(spark, descending):
    """Consecutive laps share an end point; one key has laps numbered against time."""
    random.seed(2)
    spans, points = [], []
    for key in range(3):
        at = 0.0
        for lap in range(30):
            length = random.choice([0.0, 10.0, 11.5])
            number = 100.0 - lap if descending and key == 1 else float(lap)
            spans.append((key, at, at + length, number))
            points += [(len(points) + j, key, x) for j, x in enumerate([at, at + length / 2, at + length])]
            at += length + random.choice([0.0, 0.0, 3.0])
    got = assign_interval(
        spark.createDataFrame(points, "id INT, k INT, t DOUBLE"), spark.createDataFrame(spans, "k INT, s DOUBLE, e DOUBLE, lap DOUBLE"),
        ["k"], "t", "s", "e", "lap",
    )
    assert {r.id: r.lap for r in got.collect()} == brute(points, spans, lambda s, t, e: s <= t <= e)


def test_null_times_and_unknown_keys(spark):
    points = spark.createDataFrame([(1, "a", 5.0), (2, "a", None), (3, "z", 5.0), (4, None, 5.0)], "id INT, k STRING, t DOUBLE")
    spans = spark.createDataFrame([("a", 0.0, 10.0, 1.0), ("a", None, 10.0, 0.0), ("a", 0.0, None, 0.0)], "k STRING, s DOUBLE, e DOUBLE, lap DOUBLE")
    for mode in ("closed", "asof"):
        got = {r.id: r.lap for r in assign_interval(points, spans, ["k"], "t", "s", "e", "lap", mode=mode).collect()}
        assert got == {1: 1.0, 2: None, 3: None, 4: None}


def test_lap_spans(spark):
    keys = ("2024", "X", "R", "VER")
    laps = spark.createDataFrame(
        [
            (*keys, 1.0, "00:00:10.000", None, False, 90.0), (*keys, 2.0, "00:01:40.000", "00:03:00.000", True, 95.0),
            (*keys, 3.0, "00:05:00.000", "NaT", False, None), (*keys, 4.0, None, None, False, 90.0),
        ],
        "Year STRING, GrandPrix STRING, SessionType STRING, Driver STRING, LapNumber DOUBLE, LapStartTime STRING, PitInTime STRING, DidPit BOOLEAN, LapTimeSeconds DOUBLE",
    )
    got = sorted((r.LapNumber, r.StartSeconds, r.EndSeconds) for r in lap_spans(laps).collect())
    assert got == [(1.0, 10.0, 100.0), (2.0, 100.0, 180.0)]
    samples = spark.createDataFrame(
        [(*keys, "00:01:40.000", None), (*keys, "00:02:59.999", 7.0), (*keys, "00:30:00.000", 7.0)],
        "Year STRING, GrandPrix STRING, SessionType STRING, Driver STRING, Time STRING, LapNumber DOUBLE",
    )
    placed = {r.Time: r.LapNumber for r in assign_laps(samples, lap_spans(laps)).collect()}
    assert placed == {"00:01:40.000": 1.0, "00:02:59.999": 2.0, "00:30:00.000": 7.0}
    replaced = {r.Time: r.LapNumber for r in assign_laps(samples, lap_spans(laps), keep_existing=False).collect()}
    assert replaced["00:30:00.000"] is None


def test_no_spans_at_all(spark):
    points = spark.createDataFrame([(1, "a", 5.0)], "id INT, k STRING, t DOUBLE")
    spans = spark.createDataFrame([], "k STRING, s DOUBLE, e DOUBLE, lap DOUBLE")
    assert [r.lap for r in assign_interval(points, spans, ["k"], "t", "s", "e", "lap").collect()] == [None]
    assert assign_interval(points.filter(F.lit(False)), spans, ["k"], "t", "s", "e", "lap").count() == 0
