"""End-to-end queries: record tables and views built from their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.durations import clean_time_columns, format_lap_time
from ..operators import laps as L
from ..operators.lookup import dense_ids
from ..plans import records, views
from ..schemas import LAPS, ensure_columns
from .aggregates import rounded
from .joins import _SQL_LAP_SPANS
from .registry import query
from .scalars import sql_clean, sql_lap_text, sql_seconds

_SESSION = ["Year", "GrandPrix", "SessionType"]


def _decoded_laps(t):
    """Laps with every column of the topic schema."""
    return ensure_columns(t.laps, {f.name: f.dataType.simpleString() for f in LAPS.fields})


def _team_ids(t):
    return dense_ids(t.laps.select(F.col("Team").alias("TeamName")), "TeamName", "TeamID")


_SQL_FILLED = f"""(SELECT *, CASE WHEN own IS NULL THEN known ELSE own END AS filled, own IS NULL AND known IS NOT NULL AS is_filled FROM (
SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY "Year", "GrandPrix", "SessionType", "Driver" ORDER BY "LapNumber" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known
FROM (SELECT *, {sql_clean('"LapTime"')} AS own FROM laps)))"""


@query("laps_enriched", f"""
SELECT event_id, "LapNumber", filled AS "LapTime", is_filled AS "LapTimeFilledByPrevious", round({sql_seconds('filled')}, 6) AS "LapTimeSeconds",
  round({sql_seconds('"Sector1Time"')}, 6) AS "Sector1TimeSeconds", coalesce("PitInTime" <> 'NaT', FALSE) AS "DidPit", coalesce("TrackStatus" LIKE '%2%', FALSE) AS "IsYellowFlag",
  ("SpeedI1" + "SpeedI2" + "SpeedFL" + "SpeedST") / 4 AS "AverageSpeed",
  coalesce((SELECT CAST(count(DISTINCT b."Team") AS INTEGER) FROM laps b WHERE b."Team" <= f."Team" AND f."Team" IS NOT NULL), 0) AS "TeamID" FROM {_SQL_FILLED} f""",
       uses="timed laps")
def _(t):
    laps = records.laps(_decoded_laps(t), _team_ids(t))
    return rounded(laps, "LapTimeSeconds", "Sector1TimeSeconds").select(
        "event_id", "LapNumber", "LapTime", "LapTimeFilledByPrevious", "LapTimeSeconds", "Sector1TimeSeconds", "DidPit", "IsYellowFlag",
        "AverageSpeed", "TeamID",
    )


@query("lap_statistics_after_fill", f"""
SELECT "Driver", "Year", "GrandPrix", round(avg(s), 6) AS "AvgLapTime", round(min(s), 6) AS "BestLapTime", round(stddev_samp(s), 6) AS "LapTimeConsistency",
  round(avg("SpeedST"), 6) AS "AvgSpeed", max("SpeedST") AS "MaxSpeed", count(*) FILTER (WHERE "IsPersonalBest") AS "PersonalBestCount",
  count(DISTINCT "Stint") AS "PitStopCount", count("LapNumber") AS "CompletedLaps"
FROM (SELECT *, {sql_seconds('filled')} AS s FROM {_SQL_FILLED}) WHERE NOT coalesce("Deleted", FALSE) AND s BETWEEN 30 AND 300 GROUP BY "Driver", "Year", "GrandPrix" """,
       uses="timed laps")
def _(t):
    laps = records.filled_laps(_decoded_laps(t)).filter(R.is_valid_lap())
    return rounded(L.lap_statistics(laps, ("Driver", "Year", "GrandPrix")), "AvgLapTime", "BestLapTime", "LapTimeConsistency", "AvgSpeed")


def _coded(samples):
    return samples.withColumn("Driver", F.concat(F.lit("D"), "Driver"))


_SQL_PLACED = f"""(SELECT p.event_id, min(s."LapNumber") AS "LapNumber" FROM (SELECT *, 'D' || "Driver" AS d, day_ms / 1000.0::DOUBLE AS clock FROM samples) p
LEFT JOIN {_SQL_LAP_SPANS} s ON p."Year" = s."Year" AND p."GrandPrix" = s."GrandPrix" AND p."SessionType" = s."SessionType" AND p.d = s."Driver"
  AND round(clock * 1e6) >= round("StartSeconds" * 1e6) AND round(clock * 1e6) <= round("EndSeconds" * 1e6) GROUP BY p.event_id)"""
_SQL_TEAMS = """(SELECT "Driver", arg_max("TeamName", ("Year", "GrandPrix")) AS "Team" FROM drivers GROUP BY "Driver")"""
_SQL_SAMPLE_HEAD = """SELECT s.event_id, t."Team", CASE WHEN t."Team" IS NULL THEN 0 ELSE CAST(right(t."Team", 1) AS INTEGER) + 1 END AS "TeamID", l."LapNumber","""
_SQL_SAMPLE_TAIL = f"""FROM samples s JOIN {_SQL_PLACED} l USING (event_id) LEFT JOIN {_SQL_TEAMS} t ON 'D' || s."Driver" = t."Driver" """


@query("car_samples_enriched", f"""{_SQL_SAMPLE_HEAD}
  coalesce("Brake" > 0, FALSE) AS "IsBraking", coalesce("Throttle" > 0, FALSE) AS "IsAccelerating", coalesce("DRS" > 0, FALSE) AS "IsDRSOpen" {_SQL_SAMPLE_TAIL}""",
       uses="timed laps timed_laps samples drivers")
def _(t):
    placed = records.car_samples(_coded(t.samples), t.drivers, _team_ids(t), R.lap_flags(t.timed_laps))
    return placed.select("event_id", "Team", "TeamID", "LapNumber", "IsBraking", "IsAccelerating", "IsDRSOpen")


@query("positions_enriched", f"""{_SQL_SAMPLE_HEAD}
  coalesce("X", 0) AS "X", round(sqrt("X" * "X" + "Y" * "Y"), 6) AS "DistanceFromOrigin" {_SQL_SAMPLE_TAIL}""",
       uses="timed laps timed_laps samples drivers")
def _(t):
    placed = records.positions(_coded(t.samples), t.drivers, _team_ids(t), R.lap_flags(t.timed_laps))
    return rounded(placed, "DistanceFromOrigin").select("event_id", "Team", "TeamID", "LapNumber", "X", "DistanceFromOrigin")


@query("driver_info_enriched", """
SELECT "Driver", "Year", "GrandPrix", "SessionType", "TeamName", CAST(right("TeamName", 1) AS INTEGER) + 1 AS "TeamID" FROM drivers""", uses="timed drivers")
def _(t):
    info = t.drivers.drop("TeamID")
    return records.driver_info(info, dense_ids(info, "TeamName", "TeamID")).select(
        "Driver", "Year", "GrandPrix", "SessionType", "TeamName", "TeamID"
    )


@query("results_enriched", """
SELECT o_orderkey, CAST("Position" AS INTEGER) AS "PositionNumeric", CASE WHEN "Position" <= 3 THEN 'Podium' WHEN "Position" <= 10 THEN 'Points' WHEN "Points" > 0 THEN 'Points'
  WHEN "Status" = 'DNF' THEN 'DNF' WHEN "Status" = 'DNS' THEN 'DNS' WHEN "Status" = 'DSQ' THEN 'Disqualified' ELSE 'No Points' END AS "PositionCategory",
  coalesce(CAST(right("TeamName", 1) AS INTEGER) + 1, 0) AS "TeamID" FROM results""", uses="results")
def _(t):
    ids = dense_ids(t.results, "TeamName", "TeamID")
    return records.results(t.results, ids).select("o_orderkey", "PositionNumeric", "PositionCategory", "TeamID")


@query("weather_enriched", """
SELECT "Year", "GrandPrix", coalesce("SessionType", 'R') AS "SessionType", CASE WHEN "Rainfall" THEN 'Wet' ELSE 'Dry' END AS "WeatherCondition",
  count(*) AS n, max("TrackTemp" - "AirTemp") AS top_delta FROM weather GROUP BY ALL""", uses="weather")
def _(t):
    return records.weather(t.weather).groupBy("Year", "GrandPrix", "SessionType", "WeatherCondition").agg(
        F.count(F.lit(1)).alias("n"), F.max("TempDelta").alias("top_delta")
    )


_D1, _D2 = "D7", "D42"
_SQL_ONE = """(SELECT "Year", "GrandPrix", "SessionType", row_number() OVER (PARTITION BY "Year", "GrandPrix", "SessionType" ORDER BY "LapNumber") AS lap, "LapTimeSeconds" AS s
 FROM timed_laps WHERE "Driver" = '{}' AND NOT coalesce("Deleted", FALSE) AND "LapTimeSeconds" BETWEEN 30 AND 300)"""


@query("two_driver_comparison", f"""
SELECT "Year", "GrandPrix", "SessionType", lap AS "LapNumber", a.s AS first_time, b.s AS second_time, round(a.s - b.s, 6) AS gap, {sql_lap_text('a.s')} AS first_display,
  {sql_lap_text('b.s')} AS second_display, round(a.s / 60, 6) AS first_minutes, round(b.s / 60, 6) AS second_minutes
FROM {_SQL_ONE.format(_D1)} a FULL JOIN {_SQL_ONE.format(_D2)} b USING ("Year", "GrandPrix", "SessionType", lap)""", uses="timed laps timed_laps")
def _(t):
    from ..operators.ordered import number_rows

    valid = t.timed_laps.filter(R.is_valid_lap())
    laps = number_rows(valid, [*_SESSION, "Driver"], [F.col("LapNumber")], "lap").withColumn("LapNumber", F.col("lap")).drop("lap")
    return rounded(views.compare_laps(laps, _D1, _D2).drop("gap_display"), "gap", "first_minutes", "second_minutes")


@query("two_driver_summary", f"""
SELECT "SessionType", min(s) FILTER (WHERE d = '{_D1}') AS first_min, min(s) FILTER (WHERE d = '{_D2}') AS second_min, {sql_lap_text(f"min(s) FILTER (WHERE d = '{_D1}')")} AS first_best
FROM (SELECT "SessionType", "Driver" AS d, "LapTimeSeconds" AS s FROM timed_laps WHERE "Driver" IN ('{_D1}', '{_D2}') AND NOT coalesce("Deleted", FALSE) AND "LapTimeSeconds" BETWEEN 30 AND 300)
GROUP BY "SessionType" """, uses="timed laps timed_laps")
def _(t):
    summary = views.compare_summary(t.timed_laps, _D1, _D2, ["SessionType"])
    return summary.select("SessionType", "first_min", "second_min", format_lap_time(F.col("first_min")).alias("first_best"))


def _sql_kind(kind: str) -> str:
    return f"""(SELECT s.*, d."Driver" AS code, row_number() OVER (PARTITION BY s."Year", s."GrandPrix", s."SessionType", s."Driver" ORDER BY day_ms) AS i,
 count(*) OVER (PARTITION BY s."Year", s."GrandPrix", s."SessionType", s."Driver") AS n
 FROM samples s JOIN drivers d ON s."Driver" = d."DriverNumber" AND s."Year" = d."Year" AND s."GrandPrix" = d."GrandPrix" AND s."SessionType" = d."SessionType" WHERE {kind})"""


@query("lap_speed_trace", f"""
SELECT a."Year", a."GrandPrix", a."SessionType", a."Driver" AS "DriverNumber", a.code AS "DriverCode", CAST(1 AS DOUBLE) AS "LapNumber", a."X", a."Y", a.i AS row_number,
  coalesce(last_value(nullif(b."Speed", 0) IGNORE NULLS) OVER (PARTITION BY a."Year", a."GrandPrix", a."SessionType", a."Driver" ORDER BY a.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS "Speed"
FROM {_sql_kind("event_type IN ('view', 'click', 'error')")} a LEFT JOIN {_sql_kind("event_type IN ('purchase', 'signup')")} b
ON a."Year" = b."Year" AND a."GrandPrix" = b."GrandPrix" AND a."SessionType" = b."SessionType" AND a."Driver" = b."Driver" AND a.i = b.i""", uses="timed samples drivers")
def _(t):
    samples = t.samples.withColumn("LapNumber", F.lit(1.0))
    positions = samples.filter(F.col("event_type").isin("view", "click", "error"))
    cars = samples.filter(F.col("event_type").isin("purchase", "signup"))
    return views.lap_trace(positions, cars, t.drivers)


@query("classification", """
SELECT o_orderkey, "TeamName", coalesce("Position", 999) AS "PositionNumeric", CASE WHEN "Position" IS NULL THEN 'DNF' ELSE CAST(CAST("Position" AS INTEGER) AS VARCHAR) END AS "DisplayPosition",
  CASE WHEN "DriverNumber" IS NOT NULL THEN "Driver" || ' (' || "DriverNumber" || ')' ELSE "Driver" END AS "DriverDisplay",
  CASE WHEN coalesce("Position", 999) <= 3 THEN 'Podium' WHEN coalesce("Position", 999) <= 10 THEN 'Points' WHEN "Status" = 'DNF' THEN 'DNF' ELSE 'No Points' END AS "PositionCategory"
FROM (SELECT o_orderkey, "TeamName", "Position", "DriverNumber", "Driver", "Status" FROM results WHERE "SessionType" = 'Race' AND "GrandPrix" <> 'GP 3' UNION ALL
SELECT arg_max(o_orderkey, lap), arg_max("Team", lap), arg_max(p, lap).v, arg_max(struct_pack(v := "DriverNumber"), lap).v, "Driver", 'Finished'
FROM (SELECT *, CAST(o_orderkey AS DOUBLE) AS lap, struct_pack(v := "Position") AS p FROM results WHERE "SessionType" = 'Race' AND "GrandPrix" = 'GP 3' AND o_orderkey <> 0) GROUP BY "Year", "Driver")""", uses="results")
def _(t):
    """Sessions of one grand prix have no result list and are classified from their laps."""
    key = F.col("o_orderkey")
    listed = t.results.filter("GrandPrix <> 'GP 3'")
    laps = t.results.select(
        *_SESSION, "Driver", key.cast("double").alias("LapNumber"), "DriverNumber", "Position", "Team", key.alias("TeamID"),
    )
    table = views.classification(listed, laps)
    return table.select(
        F.coalesce("o_orderkey", "TeamID").alias("o_orderkey"), "TeamName", "PositionNumeric", "DisplayPosition", "DriverDisplay", "PositionCategory"
    )


@query("position_series", """
SELECT "Driver", "LapNumber", "Compound", CASE WHEN count(p) OVER (PARTITION BY "Year", "GrandPrix", "SessionType") = 0 AND "SessionType" = 'Race' THEN r.place ELSE p END AS "Position",
  CAST(NULL AS DOUBLE) AS "AverageSpeed" FROM (SELECT *, CASE WHEN "GrandPrix" IN ('Grand Prix 2', 'Grand Prix 3') THEN NULL ELSE "Position" END AS p FROM laps) l
LEFT JOIN (SELECT "Year", "GrandPrix", "SessionType", "Driver", min("TeamID") * 1.0::DOUBLE AS place FROM drivers GROUP BY ALL) r USING ("Year", "GrandPrix", "SessionType", "Driver")""",
       uses="timed laps drivers")
def _(t):
    holes = t.laps.withColumn("Position", F.when(~F.col("GrandPrix").isin("Grand Prix 2", "Grand Prix 3"), F.col("Position")))
    results = t.drivers.select(*_SESSION, "Driver", F.col("TeamID").cast("double").alias("Position"))
    return views.position_series(holes, results).select("Driver", "LapNumber", "Compound", "Position", "AverageSpeed")


@query("driver_replay", f"""
SELECT a."Year", a."GrandPrix", a."SessionType", a."Driver" AS "DriverNumber", a.i - 1 AS frame, coalesce(a."X", 0) AS "X", coalesce(b."Speed", 0) AS "Speed", coalesce(b."RPM", 0) AS "RPM"
FROM {_sql_kind("event_type IN ('view', 'click', 'error')")} a
LEFT JOIN (SELECT DISTINCT "Year", "GrandPrix", "SessionType", "Driver", n FROM {_sql_kind("event_type IN ('purchase', 'signup')")}) m
  ON a."Year" = m."Year" AND a."GrandPrix" = m."GrandPrix" AND a."SessionType" = m."SessionType" AND a."Driver" = m."Driver"
LEFT JOIN {_sql_kind("event_type IN ('purchase', 'signup')")} b
  ON a."Year" = b."Year" AND a."GrandPrix" = b."GrandPrix" AND a."SessionType" = b."SessionType" AND a."Driver" = b."Driver"
  AND b.i = least(CAST(floor((a.i - 1) / a.n::DOUBLE * m.n) AS BIGINT), m.n - 1) + 1""", uses="timed samples drivers")
def _(t):
    positions = t.samples.filter(F.col("event_type").isin("view", "click", "error"))
    cars = t.samples.filter(F.col("event_type").isin("purchase", "signup"))
    return views.replay(positions, cars, t.drivers).select(*_SESSION, "DriverNumber", "frame", "X", "Speed", "RPM")


@query("fn1_all_time_columns", f"""
SELECT event_id, {sql_clean('"Time"')} AS "Time", {sql_clean('"LapTime"')} AS "LapTime", {sql_clean('"PitInTime"')} AS "PitInTime", {sql_clean('"Sector3Time"')} AS "Sector3Time" FROM laps""", uses="timed laps")
def _(t):
    return clean_time_columns(t.laps).select("event_id", "Time", "LapTime", "PitInTime", "Sector3Time")
