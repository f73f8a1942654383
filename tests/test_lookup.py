"""Dimension lookups and name resolution."""

import random

from pyspark.sql import functions as F

from apexframe.operators import lookup as J
from apexframe.operators import results as P
from apexframe.operators.lookup import Rule


def test_team_ids_exact_then_any_case_then_zero(spark):
    ids = spark.createDataFrame([("Alpine", 1), ("ALPINE", 2), ("Haas", 3)], "TeamName STRING, TeamID INT")
    df = spark.createDataFrame([(1, "ALPINE"), (2, "alpine"), (3, "HAAS"), (4, "Other"), (5, None), (6, "")], "i INT, Team STRING")
    assert {r.i: r.TeamID for r in J.team_id(df, ids).collect()} == {1: 2, 2: 1, 3: 3, 4: 0, 5: 0, 6: 0}


def test_dense_ids_skip_null_and_grow(spark):
    names = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "TeamName STRING")
    first = J.dense_ids(names, "TeamName", "TeamID")
    assert {r.TeamName: r.TeamID for r in first.collect()} == {"a": 1, "b": 2}
    more = spark.createDataFrame([("A",), ("z",), ("c",), ("",), (None,)], "TeamName STRING")
    assert {r.TeamName: r.TeamID for r in J.extend_ids(first, more, "TeamName", "TeamID").collect()} == {"a": 1, "b": 2, "c": 3, "z": 4}


def test_latest_team_is_of_the_newest_record(spark):
    info = spark.createDataFrame(
        [("VER", 2023, "B", "Old"), ("VER", 2024, "A", "New"), ("HAM", 2024, "A", "")], "Driver STRING, Year INT, GrandPrix STRING, TeamName STRING"
    )
    df = spark.createDataFrame([("VER",), ("HAM",), ("XXX",)], "Driver STRING")
    assert {r.Driver: r.Team for r in J.with_latest_team(df, info).collect()} == {"VER": "New", "HAM": None, "XXX": None}


def test_resolve_names_against_brute_force(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("ab ") for _ in range(random.randint(0, 5)))
    left = [(i, word()) for i in range(60)]
    right = [(i, word(), word()) for i in range(25)]
    rules = [
        Rule(1, "left_in_right", F.col("text"), F.col("name")),
        Rule(1, "right_in_left", F.col("text"), F.col("name")),
        Rule(2, "equal", F.col("text"), F.col("town"), pick="last"),
    ]
    got = J.resolve_names(
        spark.createDataFrame(left, "id INT, text STRING"), spark.createDataFrame(right, "n INT, name STRING, town STRING"),
        ["id"], "n", ["name"], rules,
    )
    expected = {}
    for i, text in left:
        first = [(1, n, name) for n, name, _ in right if text in name or name in text]
        second = [(2, n, name) for n, name, town in right if town == text]
        hit = min(first) if first else max(second) if second else (None, None, None)
        expected[i] = (hit[0], hit[2])
    assert {r.id: (r.match_tier, r.match_name) for r in got.collect()} == expected


def test_schedule_takes_first_circuit_else_last_of_the_town(spark):
    schedule = spark.createDataFrame(
        [(2024, 1, "A GP", "2024-03-01", "Monza", "Italy"), (2024, 2, "B GP", "2024-04-01", "Spa", "Belgium"), (2024, 3, "C GP", "2024-05-01", "Nowhere", "X"),
         (2023, 1, "A GP", "2023-03-01", "Monza", "Italy")],
        "Year INT, RoundNumber INT, EventName STRING, EventDate STRING, Location STRING, Country STRING",
    ).withColumn("EventDate", F.to_date("EventDate"))
    circuits = spark.createDataFrame(
        [(2024, 0, "Autodromo Monza", "m1", 1.0, 2.0, "Milan", "Italy"), (2024, 1, "Monza Junior", "m2", 3.0, 4.0, "Spa", "Belgium"),
         (2024, 2, "Francorchamps", "f", 5.0, 6.0, "spa", "Belgium")],
        "Year INT, ordinal INT, circuitName STRING, circuitId STRING, latitude DOUBLE, longitude DOUBLE, locality STRING, country STRING",
    )
    got = {(r.Year, r["round"]): (r.circuitId, r.match_tier) for r in J.schedule_with_circuits(schedule, circuits).collect()}
    assert got == {(2024, 1): ("m1", 1), (2024, 2): ("f", 2), (2024, 3): (None, None), (2023, 1): (None, None)}


def test_event_by_name_or_round(spark):
    schedule = spark.createDataFrame([(1, "Bahrain Grand Prix"), (2, "Saudi Arabian Grand Prix")], "RoundNumber INT, EventName STRING")
    asked = spark.createDataFrame([(1, "grand prix"), (2, "2"), (3, "moon")], "id INT, text STRING")
    got = {r.id: (r.match_EventName, r.match_tier) for r in J.find_event(asked, schedule, ["id"], "text").collect()}
    assert got == {1: ("Bahrain Grand Prix", 1), 2: ("Saudi Arabian Grand Prix", 2), 3: (None, None)}


def test_race_laps_falls_back_to_table_and_default(spark):
    sessions = spark.createDataFrame([(2024, g, "Race") for g in ("Monaco Grand Prix", "Unknown", "Known")], "Year INT, GrandPrix STRING, SessionType STRING")
    laps = spark.createDataFrame(
        [(2024, "Known", "Race", 12.0), (2024, "Known", "Race", 31.0), (2024, "Monaco Grand Prix", "Race", None)],
        "Year INT, GrandPrix STRING, SessionType STRING, LapNumber DOUBLE",
    )
    assert {r.GrandPrix: r.TotalLaps for r in J.race_laps(sessions, laps).collect()} == {"Monaco Grand Prix": 78.0, "Unknown": 50.0, "Known": 31.0}


def test_drivers_without_details_get_stand_ins(spark):
    keys = "Year INT, GrandPrix STRING, SessionType STRING"
    series = [spark.createDataFrame([(2024, "X", "R", n)], f"{keys}, Driver STRING") for n in ("1", "44")]
    info = spark.createDataFrame([(2024, "X", "R", "VER", "1", "Max", "RB", 3)], f"{keys}, Driver STRING, DriverNumber STRING, FullName STRING, TeamName STRING, TeamID INT")
    got = {r.DriverNumber: (r.Driver, r.FullName, r.TeamID, r.DisplayName) for r in J.drivers_present(series, info, ["Year", "GrandPrix", "SessionType"]).collect()}
    assert got == {"1": ("VER", "Max", 3, "VER - Max"), "44": ("44", "Driver 44", 0, "Driver #44")}


def test_classification_of_unplaced_drivers(spark):
    df = spark.createDataFrame(
        [(1, "VER", "1", "1", "T", None, "Finished"), (1, "HAM", None, "R", "T", None, "DNF"), (2, "NOR", "4", "4", "U", "V", "x")],
        "s INT, Driver STRING, DriverNumber STRING, Position STRING, Team STRING, TeamName STRING, Status STRING",
    )
    got = {r.Driver: (r.DisplayPosition, r.DriverDisplay, r.PositionCategory, r.TeamName) for r in P.classification(df, ["s"]).collect()}
    assert got == {
        "VER": ("1", "VER (1)", "Podium", "T"), "HAM": ("DNF", "HAM", "DNF", "T"), "NOR": ("4", "NOR (4)", "Points", "V"),
    }


def test_texts_with_much_in_common_make_no_candidates(spark):
    """Texts that share all their short pieces: rows are made for finds only, long texts and empty ones included."""
    from apexframe.operators.lookup import _offered

    names = [(i, f"aaaaaaaaaa {i:04d}") for i in range(300)] + [(400, "x" * 80 + "tail"), (401, "x" * 70)]
    asked = [(i, f"aaaaa {i:04d}") for i in range(0, 600, 2)] + [(700, "x" * 66), (701, "x" * 66 + "tail"), (702, ""), (703, "y" * 66), (704, "é")]
    left, right = spark.createDataFrame(asked, "id INT, text STRING"), spark.createDataFrame(names, "n INT, name STRING")
    pieces = _offered(right.withColumn("_text", F.col("name")), left.withColumn("_text", F.col("text")))
    assert pieces.count() < 1200
    for kind in ("left_in_right", "right_in_left"):
        inside = (lambda a, b: a in b) if kind == "left_in_right" else (lambda a, b: b in a)
        got = J.resolve_names(left, right, ["id"], "n", ["name"], [Rule(1, kind, F.col("text"), F.col("name"))])
        expected = {i: next((n for n, name in names if inside(text, name)), None) for i, text in asked}
        assert {r.id: r.match_name for r in got.collect()} == {i: dict(names).get(n) for i, n in expected.items()}
