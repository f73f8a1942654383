"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import COLOUR_BY_ID, COLOUR_BY_NAME, DRIVER_NAMES, LINEUP, SESSION_NAMES, TEAM_SPELLINGS
from ..functions import durations as D
from ..functions import names as N
from ..functions import records as R
from ..schemas import ensure_columns
from ..sources.readers import decode, flatten_circuits, split_corrupt, typed
from .registry import query

_CLOCK = r"^(\d{2}:)?\d{2}:\d{2}(\.\d+)?$"
SQL_CLEAN = (
    "CASE WHEN {c} LIKE '%days%' THEN regexp_replace({c}, '^\\d+\\s+days\\s+', '') "
    "WHEN regexp_matches({c}, '" + _CLOCK + "') THEN {c} END"
)
SQL_SECONDS = (
    "CASE WHEN {c} IS NULL OR {c} IN ('', 'NaT') THEN NULL "
    "WHEN len(string_split({c}, ':')) = 3 THEN TRY_CAST(string_split({c}, ':')[1] AS INTEGER) * 3600 + "
    "TRY_CAST(string_split({c}, ':')[2] AS INTEGER) * 60 + TRY_CAST(string_split({c}, ':')[3] AS DOUBLE) "
    "WHEN len(string_split({c}, ':')) = 2 THEN TRY_CAST(string_split({c}, ':')[1] AS INTEGER) * 60 + "
    "TRY_CAST(string_split({c}, ':')[2] AS DOUBLE) "
    "WHEN len(string_split({c}, ':')) = 1 THEN TRY_CAST({c} AS DOUBLE) END"
)


def sql_clean(c: str) -> str:
    return SQL_CLEAN.replace("{c}", c)


def sql_seconds(c: str) -> str:
    return SQL_SECONDS.replace("{c}", c)


def sql_lap_text(s: str) -> str:
    return f"CASE WHEN {s} IS NULL THEN '' ELSE printf('%d:%.3f', CAST(floor({s} / 60) AS BIGINT), {s} % 60) END"


def sql_case(table: dict, key: str, default: str) -> str:
    whens = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


@query("src2_decode_json", """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(props->>'k' AS INTEGER) END AS k, event_id % 10 = 0 AS rejected FROM events""")
def _(t):
    """A tenth of the records is broken text; it is split off and not lost."""
    lines = t.events.select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "event_id")).otherwise(
            F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "props": '), "props", F.lit("}"))
        ).alias("value"),
    )
    schema = T.StructType.fromDDL("event_id BIGINT, props STRUCT<k: INT>")
    good, bad = split_corrupt(decode(lines, schema))
    rejected = bad.select(F.substring("_corrupt_record", 2, 20).cast("bigint").alias("event_id"))
    return good.select("event_id", F.col("props.k").alias("k"), F.lit(False).alias("rejected")).unionByName(
        rejected.select("event_id", F.lit(None).cast("int").alias("k"), F.lit(True).alias("rejected"))
    )


@query("src5_flatten_circuits", """
SELECT CAST(2024 AS INTEGER) AS year, 'c' || s_suppkey AS "circuitId", s_name AS "circuitName", CAST(NULL AS VARCHAR) AS url,
  CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey AS DOUBLE) / 4 END AS latitude, CAST(s_nationkey AS DOUBLE) AS longitude,
  'L' || s_nationkey AS locality, 'C' || s_nationkey AS country FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    raw = t.supplier.select(
        F.concat(F.lit("c"), k).alias("circuitId"), F.col("s_name").alias("circuitName"), F.lit(None).cast("string").alias("url"),
        F.struct(
            F.when(k % 7 == 0, "north").otherwise((k / 4).cast("string")).alias("lat"),
            F.col("s_nationkey").cast("string").alias("long"),
            F.concat(F.lit("L"), "s_nationkey").alias("locality"),
            F.concat(F.lit("C"), "s_nationkey").alias("country"),
        ).alias("Location"),
    )
    return flatten_circuits(raw, 2024)


@query("src8_typed_load", """
SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS place, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey + 0.5::DOUBLE END AS gap,
  CAST(o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AS INTEGER) AS "HadRainfall" FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    text = t.orders.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("place"),
        F.when(k % 5 == 0, "n/a").otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("gap"),
        F.when(k % 3 == 0, "True").when(k % 3 == 1, "1").otherwise("no").alias("HadRainfall"),
    )
    return typed(text, {"place": "int", "gap": "double"})


@query("prj1_literal_tags", """
SELECT event_id, CAST(2024 AS INTEGER) AS "Year", 'Test Grand Prix' AS "GrandPrix", 'Race' AS "SessionType", TRUE AS "IsPrediction" FROM events""")
def _(t):
    return R.tag(t.events.select("event_id"), Year=2024, GrandPrix="Test Grand Prix", SessionType="Race", IsPrediction=True)


@query("prj2_json_safe_values", """
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS ts FROM events""")
def _(t):
    v = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return R.json_safe(t.events.select("event_id", v.alias("value"), "ts"))


@query("prj3_record_id", """
SELECT event_id, sha256('{"DataType":"Telemetry","user_id":' || user_id || ',"event_id":' || event_id || '}') AS "RecordId" FROM events""")
def _(t):
    tagged = R.tag(t.events.select("event_id", "user_id"), DataType="Telemetry")
    return tagged.select("event_id", R.record_id("DataType", "user_id", "event_id").alias("RecordId"))


@query("prj4_driver_info", """
SELECT "Driver", "DriverNumber", CASE WHEN "FullName" <> '' THEN "FullName" ELSE "FirstName" || ' ' || "LastName" END AS "FullName",
  "Abbreviation", "TeamName", CASE WHEN "Nationality" <> '' THEN "Nationality" ELSE "CountryCode" END AS "Nationality",
  "Year", "GrandPrix", "SessionType", 'DriverInfo' AS "DataType" FROM results""", uses="results")
def _(t):
    return R.driver_info_projection(t.results)


@query("prj5_driver_info_from_laps", """
SELECT "Year", "GrandPrix", "SessionType", "Driver", CAST(NULL AS VARCHAR) AS "DriverNumber", CAST(NULL AS VARCHAR) AS "FullName",
  "Driver" AS "Abbreviation", min("Team") AS "TeamName", CAST(NULL AS VARCHAR) AS "Nationality", 'DriverInfo' AS "DataType"
FROM laps GROUP BY "Year", "GrandPrix", "SessionType", "Driver" """, uses="timed laps")
def _(t):
    return R.driver_info_from_laps(t.laps)


@query("prj6_result_projection", """
SELECT "Abbreviation" AS "Driver", "DriverNumber", "Position", "ClassifiedPosition", "GridPosition", 'q1' AS "Q1", 'q2' AS "Q2", 'q3' AS "Q3",
  't' AS "Time", "Status", "Points", "TeamName", "Year", "GrandPrix", "SessionType", 'RaceResults' AS "DataType"
FROM results WHERE "SessionType" IN ('R','Q','S','SQ','Race','Qualifying','Sprint','Sprint Qualifying')""", uses="results")
def _(t):
    return R.result_projection(R.tag(t.results, Q1="q1", Q2="q2", Q3="q3", Time="t"))


@query("prj7_sample_projection", """
SELECT "Driver", "Speed", "Time", 'Telemetry' AS "DataType", CAST(2024 AS INTEGER) AS "SourceYear",
  sha256('{"DataType":"Telemetry","Driver":"' || "Driver" || '","Time":"' || "Time" || '"}') AS "RecordId" FROM samples""",
       uses="timed samples")
def _(t):
    return R.sample_projection(t.samples.select("Driver", "Speed", "Time"), "Telemetry", ["Driver", "Time"], SourceYear=2024)


@query("prj9_default_session_keys", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 2023 ELSE "Year" END AS "Year",
  CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' ELSE "GrandPrix" END AS "GrandPrix",
  CASE WHEN o_orderkey % 6 = 0 THEN 'R' ELSE "SessionType" END AS "SessionType" FROM results""", uses="results")
def _(t):
    k = F.col("o_orderkey")
    holes = t.results.select(
        "o_orderkey", *[F.when(k % n != 0, F.col(c)).alias(c) for c, n in (("Year", 4), ("GrandPrix", 5), ("SessionType", 6))]
    )
    return R.default_session(holes)


@query("prj10_pit_and_first_lap", """
SELECT event_id, "PitInTime" IS NOT NULL AND "PitInTime" NOT IN ('', 'NaT', 'nat', 'NAT') AS "DidPit", "LapNumber" = 1 AS "IsFirstLap" FROM laps""",
       uses="timed laps")
def _(t):
    return R.lap_flags(t.laps).select("event_id", "DidPit", "IsFirstLap")


@query("prj11_track_status_flags", """
SELECT event_id, coalesce("TrackStatus" LIKE '%2%', FALSE) AS "IsYellowFlag", coalesce("TrackStatus" LIKE '%4%', FALSE) AS "IsSafetyCarDeployed",
  coalesce("TrackStatus" LIKE '%5%', FALSE) AS "IsVirtualSafetyCarDeployed" FROM laps""", uses="timed laps")
def _(t):
    return R.lap_flags(t.laps).select("event_id", "IsYellowFlag", "IsSafetyCarDeployed", "IsVirtualSafetyCarDeployed")


@query("prj12_average_speed", """
SELECT event_id, ("SpeedI1" + "SpeedI2" + "SpeedFL" + "SpeedST") / 4 AS "AverageSpeed" FROM laps""", uses="timed laps")
def _(t):
    return t.laps.select("event_id", R.average_speed().alias("AverageSpeed"))


@query("prj13_car_flags", """
SELECT event_id, coalesce("Brake" > 0, FALSE) AS "IsBraking", coalesce("Throttle" > 0, FALSE) AS "IsAccelerating",
  coalesce("DRS" > 0, FALSE) AS "IsDRSOpen" FROM samples""", uses="timed samples")
def _(t):
    return R.car_flags(t.samples).select("event_id", "IsBraking", "IsAccelerating", "IsDRSOpen")


@query("prj14_distance_from_origin", """
SELECT event_id, coalesce("X", 0) AS "X", coalesce("Y", 0) AS "Y", coalesce("Z", 0) AS "Z",
  round(sqrt("X" * "X" + "Y" * "Y"), 6) AS "DistanceFromOrigin" FROM samples""", uses="timed samples")
def _(t):
    return R.position_distance(t.samples).select(
        "event_id", "X", "Y", "Z", F.round("DistanceFromOrigin", 6).alias("DistanceFromOrigin")
    )


@query("prj14_distance_from_origin_embeddings", """
SELECT vec_id, round(sqrt(CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE) * CAST(embedding[2] AS DOUBLE)), 6)
  AS "DistanceFromOrigin" FROM embeddings""")
def _(t):
    xyz = {c: F.get("embedding", F.lit(i)).cast("double") for i, c in enumerate("XYZ")}
    return R.position_distance(t.embeddings.withColumns(xyz)).select(
        "vec_id", F.round("DistanceFromOrigin", 6).alias("DistanceFromOrigin")
    )


@query("prj15_numeric_position", """
SELECT o_orderkey, TRY_CAST("ClassifiedPosition" AS DOUBLE) AS "Position", CAST(TRY_CAST("ClassifiedPosition" AS DOUBLE) AS INTEGER) AS "PositionNumeric"
FROM results""", uses="results")
def _(t):
    return R.numeric_position(t.results.withColumn("Position", F.col("ClassifiedPosition"))).select(
        "o_orderkey", "Position", "PositionNumeric"
    )


@query("prj16_position_category", """
SELECT o_orderkey, CASE WHEN "Position" <= 3 THEN 'Podium' WHEN "Position" <= 10 THEN 'Points' WHEN "Points" > 0 THEN 'Points'
  WHEN "Status" = 'DNF' THEN 'DNF' WHEN "Status" = 'DNS' THEN 'DNS' WHEN "Status" = 'DSQ' THEN 'Disqualified' ELSE 'No Points' END AS "PositionCategory"
FROM results""", uses="results")
def _(t):
    placed = R.numeric_position(t.results)
    return placed.select(
        "o_orderkey", R.position_category(F.col("PositionNumeric"), F.col("Status"), F.col("Points")).alias("PositionCategory")
    )


@query("prj17_position_category_serving", """
SELECT o_orderkey, CASE WHEN coalesce("Position", 999) <= 3 THEN 'Podium' WHEN coalesce("Position", 999) <= 10 THEN 'Points'
  WHEN "Status" = 'DNF' THEN 'DNF' ELSE 'No Points' END AS "PositionCategory" FROM results""", uses="results")
def _(t):
    return t.results.select(
        "o_orderkey", R.position_category(F.col("Position"), F.col("Status"), serving=True).alias("PositionCategory")
    )


@query("prj18_weather_columns", """
SELECT "Year", "GrandPrix", CASE WHEN "Rainfall" THEN 'Wet' ELSE 'Dry' END AS "WeatherCondition", count(*) AS n,
  round(sum("TrackTemp" - "AirTemp"), 3) AS delta FROM weather GROUP BY ALL""", uses="weather")
def _(t):
    return R.weather_columns(t.weather).groupBy("Year", "GrandPrix", "WeatherCondition").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("TempDelta"), 3).alias("delta")
    )


@query("prj19_valid_laps", """
SELECT event_id, "LapTimeSeconds" FROM timed_laps WHERE NOT coalesce("Deleted", FALSE) AND "LapTimeSeconds" BETWEEN 30 AND 300""",
       uses="timed laps timed_laps")
def _(t):
    return t.timed_laps.filter(R.is_valid_lap()).select("event_id", "LapTimeSeconds")


@query("prj20_timed_laps", """
SELECT event_id, "LapTimeSeconds" FROM timed_laps WHERE "Deleted" IS DISTINCT FROM TRUE AND "LapTimeSeconds" IS NOT NULL""",
       uses="timed laps timed_laps")
def _(t):
    return t.timed_laps.filter(R.is_timed_lap()).select("event_id", "LapTimeSeconds")


@query("prj21_personal_bests", """SELECT event_id, "Driver", "LapTimeSeconds" FROM timed_laps WHERE "IsPersonalBest" """, uses="timed laps timed_laps")
def _(t):
    return t.timed_laps.filter("IsPersonalBest").select("event_id", "Driver", "LapTimeSeconds")


@query("prj22_without_preseason", """SELECT "Year", "EventName" FROM schedule WHERE "EventName" NOT LIKE 'Pre-Season%'""", uses="schedule")
def _(t):
    return N.without_preseason(t.schedule).select("Year", "EventName")


@query("prj23_display_forms", """
SELECT o_orderkey, CASE WHEN "Position" IS NULL THEN 'DNF' ELSE CAST(CAST("Position" AS INTEGER) AS VARCHAR) END AS "DisplayPosition",
  CASE WHEN "DriverNumber" IS NOT NULL THEN "Driver" || ' (' || "DriverNumber" || ')' ELSE "Driver" END AS "DriverDisplay" FROM results""", uses="results")
def _(t):
    place = F.coalesce("Position", F.lit(999.0))
    return t.results.select(
        "o_orderkey", R.display_position(place).alias("DisplayPosition"),
        N.driver_display(F.col("Driver"), F.col("DriverNumber")).alias("DriverDisplay"),
    )


@query("prj25_missing_columns", """
SELECT o_orderkey, CAST(NULL AS VARCHAR) AS "Compound", 'N/A' AS "Tyre", CAST(0 AS DOUBLE) AS "Laps" FROM orders""")
def _(t):
    spec = {"Compound": "string", "Tyre": ("string", "N/A"), "Laps": ("double", 0)}
    return ensure_columns(t.orders.select("o_orderkey"), spec)


_TEAMS = ["Oracle Red Bull", "RB", "Scuderia Ferrari", "Mercedes-AMG", "McLaren F1", "Alpine", "Aston Martin", "Williams", "Haas F1 Team", "Alfa Romeo", "Other"]
_SQL_TEAM = f"({_TEAMS!r})[n % 12 + 1]"


def _named_teams(t):
    """A team name per part, some missing, and an id that may be out of range."""
    n = F.col("p_partkey")
    return t.part.select(
        "p_partkey", F.get(F.array(*[F.lit(x) for x in _TEAMS]), (n % 12).cast("int")).alias("team"),
        F.when(n % 13 != 0, n % 14).alias("team_id"),
    )


_SQL_NAMED = f"(SELECT p_partkey, {_SQL_TEAM} AS team, CASE WHEN n % 13 <> 0 THEN n % 14 END AS team_id FROM (SELECT p_partkey, p_partkey AS n FROM part))"


@query("prj26_team_colour", f"""
SELECT p_partkey, CASE WHEN lower(team) LIKE '%red bull%' THEN '#3671C6'
  WHEN lower(team) = 'rb' OR lower(team) LIKE '%racing bulls%' OR lower(team) LIKE '%alpha tauri%' THEN '#C8C8C8'
  WHEN lower(team) LIKE '%ferrari%' THEN '#F91536' WHEN lower(team) LIKE '%mercedes%' THEN '#6CD3BF' WHEN lower(team) LIKE '%mclaren%' THEN '#F58020'
  WHEN lower(team) LIKE '%alpine%' THEN '#2293D1' WHEN lower(team) LIKE '%aston%' THEN '#5E8FAA' WHEN lower(team) LIKE '%williams%' THEN '#37BEDD'
  WHEN lower(team) LIKE '%haas%' THEN '#B6BABD' WHEN lower(team) LIKE '%sauber%' OR lower(team) LIKE '%alfa%' THEN '#00CF46'
  ELSE {sql_case(COLOUR_BY_ID, 'team_id', "'#FFFFFF'")} END AS colour FROM {_SQL_NAMED}""")
def _(t):
    return _named_teams(t).select("p_partkey", N.team_colour(F.col("team"), F.col("team_id")).alias("colour"))


@query("prj27_team_colour_exact", f"SELECT p_partkey, {sql_case(COLOUR_BY_NAME, 'team', repr('#FFFFFF'))} AS colour FROM {_SQL_NAMED}")
def _(t):
    return _named_teams(t).select("p_partkey", N.team_colour_exact(F.col("team")).alias("colour"))


@query("prj28_presentation_columns", """
SELECT "DisplayPosition" AS "Pos", "Driver", "TeamName" AS "Team", "Points", o_orderkey AS "Key" FROM
  (SELECT *, coalesce(CAST(CAST("Position" AS INTEGER) AS VARCHAR), 'DNF') AS "DisplayPosition" FROM results)""", uses="results")
def _(t):
    return t.results.select(
        R.display_position(F.coalesce("Position", F.lit(999.0))).alias("Pos"), "Driver", F.col("TeamName").alias("Team"), "Points",
        F.col("o_orderkey").alias("Key"),
    )


@query("prj30_sessions_held", f"""
SELECT "Year", "EventName", {sql_case(SESSION_NAMES, 'key', 'key')} AS name, key, strftime(d, '%Y-%m-%d') AS date,
  CAST(list_position({list(SESSION_NAMES)!r}, key) AS BIGINT) AS ordinal FROM (
  SELECT "Year", "EventName", 'FP1' AS key, "EventDate" - 2 AS d FROM schedule WHERE "RoundNumber" % 2 = 0 UNION ALL
  SELECT "Year", "EventName", 'Q', "EventDate" - 1 FROM schedule WHERE "RoundNumber" % 3 <> 0 UNION ALL
  SELECT "Year", "EventName", 'R', "EventDate" FROM schedule)""", uses="schedule")
def _(t):
    n = F.col("RoundNumber")
    wide = t.schedule.withColumns(
        {
            "FP1": F.when(n % 2 == 0, F.date_sub("EventDate", 2)),
            "Q": F.when(n % 3 != 0, F.date_sub("EventDate", 1)),
            "R": F.col("EventDate"),
        }
    )
    return R.session_rows(wide)


@query("prj31_prediction_tags", """
SELECT o_orderkey, 'Race' AS "SessionType", TRUE AS "IsPrediction", "Year" AS "SourceYear", "GrandPrix" AS "SourceEvent"
FROM results""", uses="results")
def _(t):
    return R.prediction_tags(t.results).select("o_orderkey", "SessionType", "IsPrediction", "SourceYear", "SourceEvent")


@query("prj32_rounded_weather", """
SELECT "FullName" AS "Driver", round_even("AvgAirTemp" / 3, 1) AS "AirTemp", round_even("AvgTrackTemp" / 7, 1) AS "TrackTemp" FROM predictions""",
       uses="predictions")
def _(t):
    p = t.predictions.select(
        F.col("FullName").alias("Driver"), (F.col("AvgAirTemp") / 3).alias("AirTemp"), (F.col("AvgTrackTemp") / 7).alias("TrackTemp")
    )
    return R.round_columns(p, ["AirTemp", "TrackTemp"], 1)


@query("fn1_clean_duration", f"""SELECT event_id, {sql_clean('"LapTime"')} AS "LapTime" FROM durations""", uses="timed durations")
def _(t):
    return D.clean_time_columns(t.durations).select("event_id", "LapTime")


@query("fn2_duration_seconds", f"""SELECT event_id, round({sql_seconds('"LapTime"')}, 6) AS seconds FROM durations""", uses="timed durations")
def _(t):
    return t.durations.select("event_id", F.round(D.duration_seconds(F.col("LapTime")), 6).alias("seconds"))


@query("fn3_lap_time_text", f"""
SELECT event_id, {sql_lap_text('s')} AS shown FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value END AS s FROM events)""")
def _(t):
    return t.events.select("event_id", D.format_lap_time(F.when(F.col("event_id") % 9 != 0, F.col("value"))).alias("shown"))


@query("fn4_clock_text", """
SELECT event_id, printf('%02d:%02d:%06.3f', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), s % 60) AS padded,
  printf('%01d:%02d:%06.3f', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), s % 60) AS short
FROM (SELECT event_id, value * 64 AS s FROM events)""")
def _(t):
    s = F.col("value") * 64
    return t.events.select("event_id", D.format_clock(s).alias("padded"), D.format_clock(s, pad_hours=False).alias("short"))


@query("fn5_signed_gap_text", f"""
SELECT event_id, CASE WHEN g > 0 THEN '+' || {sql_lap_text('abs(g)')} WHEN g < 0 THEN '-' || {sql_lap_text('abs(g)')} ELSE '0.000' END AS shown
FROM (SELECT event_id, CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 8 = 1 THEN 0 ELSE value - 50 END AS g FROM events)""")
def _(t):
    g = F.when(F.col("event_id") % 8 == 1, 0.0).when(F.col("event_id") % 8 != 0, F.col("value") - 50)
    return t.events.select("event_id", D.format_signed_gap(g).alias("shown"))


@query("fn6_leader_gap_text", """
SELECT event_id, CASE WHEN g < 0.001 THEN 'Leader' WHEN g > 60 THEN printf('+%dm %.3fs', CAST(floor(g / 60) AS BIGINT), g % 60)
  ELSE printf('+%.3fs', g) END AS shown FROM (SELECT event_id, CASE WHEN event_id % 8 = 1 THEN 0 ELSE value END AS g FROM events)""")
def _(t):
    g = F.when(F.col("event_id") % 8 == 1, 0.0).otherwise(F.col("value"))
    return t.events.select("event_id", D.format_leader_gap(g).alias("shown"))


def _sql_team_rules(c: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({c}), {v.lower()!r})" for v in vs) + f" THEN {s!r}" for s, vs in TEAM_SPELLINGS.items()
    )
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'Unknown' {whens} ELSE trim({c}) END"


@query("fn7_normalize_team", f"SELECT p_partkey, {_sql_team_rules('team')} AS team FROM {_SQL_NAMED}")
def _(t):
    return _named_teams(t).select("p_partkey", N.normalize_team(F.col("team")).alias("team"))


_CODES = ["ver", "LEC", "Norris", "hamilton", "Kimi Antonelli", "", "XXX", "Carlos Sainz", "a"]
_SQL_CODE = f"(SELECT c_custkey, ({_CODES!r})[c_custkey % 10 + 1] AS d FROM customer)"


def _sql_driver(c: str) -> str:
    codes = " ".join(f"WHEN upper(trim({c})) = {k!r} THEN {v!r}" for k, v in DRIVER_NAMES.items())
    parts = " ".join(f"WHEN contains({v.lower()!r}, lower(trim({c}))) THEN {v!r}" for v in DRIVER_NAMES.values())
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'Unknown' {codes} {parts} ELSE trim({c}) END"


def _driver_inputs(t):
    codes = F.array(*[F.lit(x) for x in _CODES])
    return t.customer.select("c_custkey", F.get(codes, (F.col("c_custkey") % 10).cast("int")).alias("d"))


@query("fn8_normalize_driver", f"SELECT c_custkey, {_sql_driver('d')} AS driver FROM {_SQL_CODE}")
def _(t):
    return _driver_inputs(t).select("c_custkey", N.normalize_driver(F.col("d")).alias("driver"))


@query("fn9_team_of_driver", "SELECT c_custkey, CASE n " + " ".join(
    f"WHEN {d!r} THEN {team!r}" for team, ds in LINEUP.items() for d in ds) + f" ELSE 'Unknown' END AS team FROM (SELECT c_custkey, {_sql_driver('d')} AS n FROM {_SQL_CODE})")
def _(t):
    return _driver_inputs(t).select("c_custkey", N.team_of_driver(F.col("d")).alias("team"))


@query("fn10_session_name", f"""
SELECT o_orderkey, {sql_case(SESSION_NAMES, 'upper(k)', 'k')} AS name FROM
  (SELECT o_orderkey, (['fp1', 'FP2', 'Q', 'sq', 'R', 'Race', 'S'])[o_orderkey % 7 + 1] AS k FROM orders)""")
def _(t):
    keys = F.array(*[F.lit(x) for x in ["fp1", "FP2", "Q", "sq", "R", "Race", "S"]])
    return t.orders.select("o_orderkey", N.session_name(F.get(keys, (F.col("o_orderkey") % 7).cast("int"))).alias("name"))


@query("fn11_truth_to_bit", """
SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS from_boolean, CASE WHEN event_id % 6 IN (0, 1, 2) THEN 1 ELSE 0 END AS from_text FROM events""")
def _(t):
    texts = F.array(*[F.lit(x) for x in ["True", "true", "1", "False", "yes"]])
    return t.events.select(
        "event_id", R.as_bit(F.col("event_type") == "error").alias("from_boolean"),
        R.as_bit(F.get(texts, (F.col("event_id") % 6).cast("int"))).alias("from_text"),
    )


@query("fn12_numeric_or_null", """SELECT event_id, TRY_CAST("LapTime" AS DOUBLE) AS number FROM durations""", uses="timed durations")
def _(t):
    return t.durations.select("event_id", D.to_double(F.col("LapTime")).alias("number"))


@query("fn13_half_even", """SELECT event_id, round_even(value / 4, 1) AS tenths, CAST(round_even(floor(value) / 2, 0) AS INTEGER) AS whole FROM events""")
def _(t):
    return t.events.select(
        "event_id", R.half_even(F.col("value") / 4, 1).alias("tenths"), R.half_even(F.floor("value") / 2).cast("int").alias("whole")
    )


@query("fn14_weather_impact", """
SELECT "FullName", round((CASE WHEN coalesce("HadRainfall", 0) <> 0 THEN 1.05 ELSE 1.0 END)::DOUBLE *
  (CASE WHEN "AvgTrackTemp" > 40 THEN 1.02 WHEN "AvgTrackTemp" < 20 THEN 1.015 ELSE 1.0 END)::DOUBLE *
  (CASE WHEN "AvgWindSpeed" > 20 THEN 1.01 ELSE 1.0 END)::DOUBLE, 9) AS impact FROM predictions""", uses="predictions")
def _(t):
    rain = F.coalesce("HadRainfall", F.lit(0)) != 0
    impact = R.weather_impact(rain, F.col("AvgTrackTemp"), F.col("AvgWindSpeed"))
    return t.predictions.select("FullName", F.round(impact, 9).alias("impact"))


@query("fn17_position_change", """
SELECT "FullName", round("GridPosition" - "PredictedPosition", 6) AS "PositionChange" FROM predictions""", uses="predictions")
def _(t):
    return t.predictions.select("FullName", F.round(F.col("GridPosition") - F.col("PredictedPosition"), 6).alias("PositionChange"))


@query("fn18_interval_seconds", """
SELECT event_id, round(epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6, 6) AS seconds, round(value / 60, 9) AS minutes FROM events""")
def _(t):
    since = F.col("ts") - F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    return t.events.select(
        "event_id", F.round(D.interval_seconds(since), 6).alias("seconds"), F.round(D.seconds_to_minutes(F.col("value")), 9).alias("minutes")
    )


@query("fn19_labels", """
SELECT event_id, "Driver" || ' - ' || coalesce("Team", 'none') AS code_name, "Driver" || ' (' || coalesce("Team", 'Unknown') || ')' AS code_team,
  'Lap ' || event_id || '.0 - ' || CAST(floor("LapTimeSeconds" / 60) AS BIGINT) || ':' || printf('%.3f', "LapTimeSeconds" % 60) ||
  CASE WHEN "IsPersonalBest" THEN ' (Personal Best)' ELSE '' END AS lap_label FROM timed_laps WHERE "LapTimeSeconds" IS NOT NULL""", uses="timed laps timed_laps")
def _(t):
    return t.timed_laps.filter("LapTimeSeconds IS NOT NULL").select(
        "event_id", N.code_and_name(F.col("Driver"), F.coalesce("Team", F.lit("none"))).alias("code_name"),
        N.code_and_team(F.col("Driver"), F.col("Team")).alias("code_team"),
        N.lap_label(
            F.concat(F.col("LapNumber").cast("bigint").cast("string"), F.lit(".0")), F.col("LapTimeSeconds"), F.col("IsPersonalBest")
        ).alias("lap_label"),
    )


@query("fn20_run_minutes", """
SELECT run_id, to_timestamp(start_time / 1000.0)::TIMESTAMP AS started, round_even((end_time - start_time) / 60000.0::DOUBLE, 2) AS minutes FROM runs""",
       uses="runs")
def _(t):
    return t.runs.select(
        "run_id", R.epoch_millis(F.col("start_time")).cast("timestamp_ntz").alias("started"),
        R.run_minutes(F.col("start_time"), F.col("end_time")).alias("minutes"),
    )


@query("fn21_artifact_class", """
SELECT page_id, CASE WHEN p LIKE '%.png' OR p LIKE '%.jpg' OR p LIKE '%.jpeg' THEN 'images' WHEN lower(p) LIKE '%model%' THEN 'models'
  WHEN p LIKE '%.csv' OR p LIKE '%.json' OR p LIKE '%.txt' THEN 'data' ELSE 'other' END AS class
FROM (SELECT page_id, url || (['.png', '/MyModel/x', '.json', '.bin'])[page_id % 4 + 1] AS p FROM pages)""")
def _(t):
    ends = F.array(*[F.lit(x) for x in [".png", "/MyModel/x", ".json", ".bin"]])
    path = F.concat("url", F.get(ends, (F.col("page_id") % 4).cast("int")))
    return t.pages.select("page_id", N.artifact_class(path).alias("class"))


@query("fn22_safe_name", """SELECT page_id, translate(url, ' -/', '___') AS name FROM pages""")
def _(t):
    return t.pages.select("page_id", N.safe_name(F.col("url")).alias("name"))


@query("fn23_year_list", """
SELECT event_id, [CAST(2000 + event_id % 20 AS INTEGER), NULL, CAST(2001 + event_id % 7 AS INTEGER)] AS years FROM events""")
def _(t):
    text = F.concat((F.col("event_id") % 20 + 2000).cast("string"), F.lit(" , x,"), (F.col("event_id") % 7 + 2001).cast("string"))
    return t.events.select("event_id", D.year_list(text).alias("years"))


@query("fn24_dates", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END AS parsed FROM events""")
def _(t):
    iso = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.events.select("event_id", D.iso_date(F.col("ts")).alias("day"), D.parse_iso(iso).cast("timestamp_ntz").alias("parsed"))


@query("fn25_title_case", """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM part""")
def _(t):
    return t.part.select("p_partkey", N.title_case(F.translate("p_name", " ", "_")).alias("title"))


@query("nul1_drop_missing_target", """SELECT o_orderkey, "Position" FROM results WHERE "Position" IS NOT NULL""", uses="results")
def _(t):
    return t.results.select("o_orderkey", "Position").dropna(subset=["Position"])


@query("nul3_fill_by_type", """
SELECT event_id, coalesce("Speed", 0) AS "Speed", coalesce("DRS", 0) AS "DRS", event_type, CAST(event_type = 'view' AS INTEGER) AS flag FROM samples""",
       uses="timed samples")
def _(t):
    return R.fill_by_type(t.samples.select("event_id", "Speed", "DRS", "event_type", (F.col("event_type") == "view").alias("flag")))


@query("nul4_fill_all_zero", """
SELECT event_id, coalesce("LapTime", '0') AS "LapTime", coalesce("Position", 0) AS "Position", coalesce("Team", '0') AS "Team" FROM laps""",
       uses="timed laps")
def _(t):
    return R.fill_all_zero(t.laps.select("event_id", "LapTime", "Position", "Team"))
