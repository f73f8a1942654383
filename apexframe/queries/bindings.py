"""Record tables derived from the given tables, in Spark and in SQL.

laps, samples and durations come from ``events``, results and predictions from ``orders``, weather from
``lineitem``, the schedule from ``customer``, circuits from ``supplier``, runs from ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86400000


# --- text of a clock, in both languages --------------------------------------------------------------


def clock3(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "HH:mm:ss.SSS")


def clock2(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "mm:ss.SSS")


def sql_clock3(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%H:%M:%S.%g')"


def sql_clock2(ms: str) -> str:
    return f"strftime(make_timestamp(({ms}) * 1000), '%M:%S.%g')"


def _text(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


# --- laps and samples -----------------------------------------------------------------------------------


def _timed_events(t) -> DataFrame:
    """Events with session keys and integer clocks: a session is a day."""
    day = F.dayofmonth("ts")
    return t.events.select(
        "event_id", "user_id", "event_type", "ts", "value", "props",
        (F.lit(2023) + F.floor((day - 1) / 10)).cast("int").alias("Year"),
        _text("Grand Prix ", day % 5).alias("GrandPrix"),
        F.when(day % 2 == 0, "Race").otherwise("Qualifying").alias("SessionType"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("epoch_ms"),
        (F.lit(30000) + F.round(F.col("value") * 1000)).cast("long").alias("lap_ms"),
    ).withColumn("day_ms", F.col("epoch_ms") % DAY_MS)


_SQL_TIMED = f"""
SELECT event_id, user_id, event_type, ts, value, props,
  CAST(2023 + (day(ts) - 1) // 10 AS INTEGER) AS "Year",
  'Grand Prix ' || CAST(day(ts) % 5 AS VARCHAR) AS "GrandPrix",
  CASE WHEN day(ts) % 2 = 0 THEN 'Race' ELSE 'Qualifying' END AS "SessionType",
  epoch_us(ts) // 1000 AS epoch_ms,
  CAST(30000 + round(value * 1000) AS BIGINT) AS lap_ms,
  (epoch_us(ts) // 1000) % {DAY_MS} AS day_ms
FROM events"""


def _laps(t) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    lap, day = F.col("lap_ms"), F.col("day_ms")
    null = lambda of: F.lit(None).cast(of)
    return t.timed.select(
        "event_id", "user_id", "event_type", "ts", "value", "Year", "GrandPrix", "SessionType", "day_ms", "lap_ms",
        _text("D", F.col("user_id")).alias("Driver"),
        F.col("user_id").cast("string").alias("DriverNumber"),
        F.when(F.col("user_id") % 29 != 0, _text("Team ", F.col("user_id") % 10)).alias("Team"),
        e.cast("double").alias("LapNumber"),
        F.when(e % 6 == 0, F.concat(F.lit("0 days "), clock3(lap), F.lit("000")))
        .when(e % 6 == 1, clock3(lap))
        .when(e % 6 == 2, clock2(lap))
        .when(e % 6 == 3, "NaT")
        .when(e % 6 == 5, "")
        .alias("LapTime"),
        clock3(day).alias("LapStartTime"),
        clock3(day + lap).alias("Time"),
        F.when(kind == "signup", clock3(day + F.least(lap, F.lit(40000)))).when(kind == "view", "NaT").alias("PitInTime"),
        null("string").alias("PitOutTime"),
        clock2(F.floor(lap / 3)).alias("Sector1Time"),
        clock2(F.floor(lap / 4)).alias("Sector2Time"),
        F.when(kind != "error", clock2(F.floor(lap / 5))).alias("Sector3Time"),
        F.col("value").alias("SpeedI1"),
        (F.col("value") + 10).alias("SpeedI2"),
        F.when(kind != "error", F.col("value") + 20).alias("SpeedFL"),
        (F.col("value") * 2).alias("SpeedST"),
        (kind == "purchase").alias("IsPersonalBest"),
        (e % 4).cast("double").alias("Stint"),
        F.when(e % 7 == 0, "1").when(e % 7 == 1, "2").when(e % 7 == 2, "4").when(e % 7 == 3, "5")
        .when(e % 7 == 4, "24").when(e % 7 == 6, "671").alias("TrackStatus"),
        F.when(kind != "error", (e % 20 + 1).cast("double")).alias("Position"),
        F.when(kind == "error", True).when(kind != "click", False).alias("Deleted"),
        (e % 2 == 0).alias("IsPrediction"),
        F.col("Year").alias("SourceYear"),
        F.when(e % 3 == 0, "SOFT").when(e % 3 == 1, "MEDIUM").otherwise("HARD").alias("Compound"),
        (e % 30).cast("double").alias("TyreLife"),
        (F.round(F.col("lap_ms") / 1000.0, 3)).alias("true_seconds"),
    )


_SQL_LAPS = f"""
SELECT event_id, user_id, event_type, ts, value, "Year", "GrandPrix", "SessionType", day_ms, lap_ms,
  'D' || user_id AS "Driver", CAST(user_id AS VARCHAR) AS "DriverNumber",
  CASE WHEN user_id % 29 <> 0 THEN 'Team ' || (user_id % 10) END AS "Team",
  CAST(event_id AS DOUBLE) AS "LapNumber",
  CASE event_id % 6 WHEN 0 THEN '0 days ' || {sql_clock3('lap_ms')} || '000' WHEN 1 THEN {sql_clock3('lap_ms')}
    WHEN 2 THEN {sql_clock2('lap_ms')} WHEN 3 THEN 'NaT' WHEN 5 THEN '' END AS "LapTime",
  {sql_clock3('day_ms')} AS "LapStartTime", {sql_clock3('day_ms + lap_ms')} AS "Time",
  CASE event_type WHEN 'signup' THEN {sql_clock3('day_ms + least(lap_ms, 40000)')} WHEN 'view' THEN 'NaT' END AS "PitInTime",
  {sql_clock2('lap_ms // 3')} AS "Sector1Time", {sql_clock2('lap_ms // 4')} AS "Sector2Time",
  CASE WHEN event_type <> 'error' THEN {sql_clock2('lap_ms // 5')} END AS "Sector3Time",
  value AS "SpeedI1", value + 10 AS "SpeedI2", CASE WHEN event_type <> 'error' THEN value + 20 END AS "SpeedFL",
  value * 2 AS "SpeedST", event_type = 'purchase' AS "IsPersonalBest", CAST(event_id % 4 AS DOUBLE) AS "Stint",
  CASE event_id % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '4' WHEN 3 THEN '5' WHEN 4 THEN '24' WHEN 6 THEN '671' END AS "TrackStatus",
  CASE WHEN event_type <> 'error' THEN CAST(event_id % 20 + 1 AS DOUBLE) END AS "Position",
  CASE WHEN event_type = 'error' THEN TRUE WHEN event_type <> 'click' THEN FALSE END AS "Deleted",
  event_id % 2 = 0 AS "IsPrediction", "Year" AS "SourceYear",
  CASE event_id % 3 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' ELSE 'HARD' END AS "Compound",
  CAST(event_id % 30 AS DOUBLE) AS "TyreLife",
  round(lap_ms / 1000.0, 3) AS true_seconds
FROM timed"""


def _timed_laps(t) -> DataFrame:
    """Laps with a time in seconds, for the lap analytics."""
    return t.laps.withColumn("LapTimeSeconds", F.when(F.col("event_id") % 17 != 0, F.col("true_seconds")))


_SQL_TIMED_LAPS = """SELECT *, CASE WHEN event_id % 17 <> 0 THEN true_seconds END AS "LapTimeSeconds" FROM laps"""


def _samples(t) -> DataFrame:
    """Car and position samples keyed by car number."""
    e, v, kind = F.col("event_id"), F.col("value"), F.col("event_type")
    return t.timed.select(
        "event_id", "ts", "Year", "GrandPrix", "SessionType", "day_ms", "event_type",
        F.col("user_id").cast("string").alias("Driver"),
        clock3(F.col("day_ms")).alias("Time"),
        F.when(e % 5 == 0, 0.0).when(e % 7 != 0, v).alias("Speed"),
        (v * 100).alias("RPM"),
        F.when(kind != "view", (e % 3).cast("double")).alias("Throttle"),
        (e % 2).cast("double").alias("Brake"),
        F.when(e % 11 != 0, (e % 4).cast("int")).alias("DRS"),
        F.when(kind != "error", v - 50).alias("X"),
        ((e % 100) * 2.0 - 80).alias("Y"),
        F.when(e % 13 != 0, v / 10).alias("Z"),
        F.lit(None).cast("double").alias("LapNumber"),
    )


_SQL_SAMPLES = f"""
SELECT event_id, ts, "Year", "GrandPrix", "SessionType", day_ms, event_type, CAST(user_id AS VARCHAR) AS "Driver",
  {sql_clock3('day_ms')} AS "Time",
  CASE WHEN event_id % 5 = 0 THEN 0.0 WHEN event_id % 7 <> 0 THEN value END AS "Speed",
  value * 100 AS "RPM", CASE WHEN event_type <> 'view' THEN CAST(event_id % 3 AS DOUBLE) END AS "Throttle",
  CAST(event_id % 2 AS DOUBLE) AS "Brake", CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 4 AS INTEGER) END AS "DRS",
  CASE WHEN event_type <> 'error' THEN value - 50 END AS "X", (event_id % 100) * 2.0::DOUBLE - 80 AS "Y",
  CASE WHEN event_id % 13 <> 0 THEN value / 10 END AS "Z", CAST(NULL AS DOUBLE) AS "LapNumber"
FROM timed"""


def _drivers(t) -> DataFrame:
    """Driver records per session, from the laps."""
    return (
        t.timed.select("Year", "GrandPrix", "SessionType", "user_id").distinct()
        .filter(F.col("user_id") % 7 != 0)
        .select(
            "Year", "GrandPrix", "SessionType",
            _text("D", F.col("user_id")).alias("Driver"),
            F.col("user_id").cast("string").alias("DriverNumber"),
            _text("Driver Name ", F.col("user_id")).alias("FullName"),
            _text("Team ", (F.col("user_id") + F.col("Year")) % 10).alias("TeamName"),
            ((F.col("user_id") + F.col("Year")) % 10).cast("int").alias("TeamID"),
        )
    )


_SQL_DRIVERS = """
SELECT DISTINCT "Year", "GrandPrix", "SessionType", 'D' || user_id AS "Driver", CAST(user_id AS VARCHAR) AS "DriverNumber",
  'Driver Name ' || user_id AS "FullName", 'Team ' || ((user_id + "Year") % 10) AS "TeamName",
  CAST((user_id + "Year") % 10 AS INTEGER) AS "TeamID"
FROM timed WHERE user_id % 7 <> 0"""


def _durations(t) -> DataFrame:
    """Duration text in every form there is, good and bad."""
    e, lap = F.col("event_id"), F.col("lap_ms")
    seconds = F.concat((F.floor(lap / 1000)).cast("string"), F.lit("."), F.lpad((lap % 1000).cast("string"), 3, "0"))
    return t.timed.select(
        "event_id", "lap_ms",
        F.when(e % 10 == 0, F.concat(F.lit("0 days "), clock3(lap), F.lit("000")))
        .when(e % 10 == 1, F.concat(F.lit("1 days "), clock3(lap)))
        .when(e % 10 == 2, F.concat(F.lit("-1 days +"), clock3(lap)))
        .when(e % 10 == 3, clock3(lap)).when(e % 10 == 4, clock2(lap))
        .when(e % 10 == 5, seconds).when(e % 10 == 6, "NaT").when(e % 10 == 7, "").when(e % 10 == 8, "1:xx")
        .alias("LapTime"),
    )


_SQL_DURATIONS = f"""
SELECT event_id, lap_ms, CASE event_id % 10 WHEN 0 THEN '0 days ' || {sql_clock3('lap_ms')} || '000'
  WHEN 1 THEN '1 days ' || {sql_clock3('lap_ms')} WHEN 2 THEN '-1 days +' || {sql_clock3('lap_ms')}
  WHEN 3 THEN {sql_clock3('lap_ms')} WHEN 4 THEN {sql_clock2('lap_ms')}
  WHEN 5 THEN (lap_ms // 1000) || '.' || lpad(CAST(lap_ms % 1000 AS VARCHAR), 3, '0')
  WHEN 6 THEN 'NaT' WHEN 7 THEN '' WHEN 8 THEN '1:xx' END AS "LapTime"
FROM timed"""


# --- results, predictions, weather ------------------------------------------------------------------------


def _results(t) -> DataFrame:
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
        F.year("o_orderdate").alias("Year"),
        _text("GP ", F.month("o_orderdate")).alias("GrandPrix"),
        F.when(k % 3 == 0, "Race").when(k % 3 == 1, "Q").otherwise("Practice 1").alias("SessionType"),
        _text("D", cust).alias("Driver"),
        _text("D", cust).alias("Abbreviation"),
        F.when(cust % 5 != 0, cust.cast("string")).alias("DriverNumber"),
        F.when(cust % 4 == 0, "").when(cust % 4 != 1, _text("Name ", cust)).alias("FullName"),
        _text("First", cust % 50).alias("FirstName"),
        _text("Last", cust).alias("LastName"),
        F.when(k % 11 != 0, (k % 22 + 1).cast("double")).alias("Position"),
        F.when(k % 11 != 0, (k % 22 + 1).cast("string")).otherwise("R").alias("ClassifiedPosition"),
        ((k * 7) % 20 + 1).cast("double").alias("GridPosition"),
        F.when(k % 13 == 0, "DSQ").when(F.col("o_orderstatus") == "F", "DNF").when(F.col("o_orderstatus") == "P", "DNS")
        .otherwise("Finished").alias("Status"),
        F.when(F.col("o_orderpriority").startswith("1"), 25.0).otherwise(0.0).alias("Points"),
        F.when(cust % 17 != 0, _text("Team ", cust % 10)).alias("TeamName"),
        _text("Works ", cust % 10).alias("Team"),
        F.when(cust % 6 == 0, "").otherwise(_text("N", cust % 9)).alias("Nationality"),
        _text("C", cust % 9).alias("CountryCode"),
    )


_SQL_RESULTS = """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS "Year",
  'GP ' || month(o_orderdate) AS "GrandPrix",
  CASE o_orderkey % 3 WHEN 0 THEN 'Race' WHEN 1 THEN 'Q' ELSE 'Practice 1' END AS "SessionType",
  'D' || o_custkey AS "Driver", 'D' || o_custkey AS "Abbreviation",
  CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS "DriverNumber",
  CASE WHEN o_custkey % 4 = 0 THEN '' WHEN o_custkey % 4 <> 1 THEN 'Name ' || o_custkey END AS "FullName",
  'First' || (o_custkey % 50) AS "FirstName", 'Last' || o_custkey AS "LastName",
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 22 + 1 AS DOUBLE) END AS "Position",
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 22 + 1 AS VARCHAR) ELSE 'R' END AS "ClassifiedPosition",
  CAST((o_orderkey * 7) % 20 + 1 AS DOUBLE) AS "GridPosition",
  CASE WHEN o_orderkey % 13 = 0 THEN 'DSQ' WHEN o_orderstatus = 'F' THEN 'DNF' WHEN o_orderstatus = 'P' THEN 'DNS' ELSE 'Finished' END AS "Status",
  CASE WHEN o_orderpriority LIKE '1%' THEN 25.0::DOUBLE ELSE 0.0 END AS "Points",
  CASE WHEN o_custkey % 17 <> 0 THEN 'Team ' || (o_custkey % 10) END AS "TeamName", 'Works ' || (o_custkey % 10) AS "Team",
  CASE WHEN o_custkey % 6 = 0 THEN '' ELSE 'N' || (o_custkey % 9) END AS "Nationality", 'C' || (o_custkey % 9) AS "CountryCode"
FROM orders"""

_RACES = ["Australian Grand Prix", "Monaco Grand Prix", "British Grand Prix", "Italian Grand Prix", "Singapore Grand Prix", "Other Grand Prix"]


def _predictions(t) -> DataFrame:
    k = F.col("o_orderkey")
    race = F.array(*[F.lit(r) for r in _RACES])
    return t.orders.select(
        _text("D", k).alias("FullName"),
        _text("Team ", F.col("o_custkey") % 10).alias("TeamName"),
        F.year("o_orderdate").alias("Year"),
        F.get(race, (F.col("o_custkey") % 6).cast("int")).alias("GrandPrix"),
        (F.sqrt("o_totalprice") / 40 + 1).alias("PredictedPosition"),
        ((k * 7) % 20 + 1).cast("double").alias("GridPosition"),
        ((k % 70) / 2.0).alias("AvgAirTemp"),
        ((k % 130) / 2.0 - 5).alias("AvgTrackTemp"),
        ((k % 997) / 10.0).alias("AvgHumidity"),
        ((k % 50) / 2.0).alias("AvgWindSpeed"),
        F.when(k % 9 == 0, 1).when(k % 9 != 1, 0).alias("HadRainfall"),
    )


_SQL_PREDICTIONS = f"""
SELECT 'D' || o_orderkey AS "FullName", 'Team ' || (o_custkey % 10) AS "TeamName", CAST(year(o_orderdate) AS INTEGER) AS "Year",
  ({_RACES!r})[o_custkey % 6 + 1] AS "GrandPrix", sqrt(o_totalprice) / 40 + 1 AS "PredictedPosition",
  CAST((o_orderkey * 7) % 20 + 1 AS DOUBLE) AS "GridPosition", (o_orderkey % 70) / 2.0::DOUBLE AS "AvgAirTemp",
  (o_orderkey % 130) / 2.0::DOUBLE - 5 AS "AvgTrackTemp", (o_orderkey % 997) / 10.0::DOUBLE AS "AvgHumidity",
  (o_orderkey % 50) / 2.0::DOUBLE AS "AvgWindSpeed",
  CASE WHEN o_orderkey % 9 = 0 THEN 1 WHEN o_orderkey % 9 <> 1 THEN 0 END AS "HadRainfall"
FROM orders"""


def _weather(t) -> DataFrame:
    return t.lineitem.select(
        F.year("l_shipdate").alias("Year"),
        _text("GP ", F.month("l_shipdate")).alias("GrandPrix"),
        F.when(F.col("l_linenumber") % 2 == 0, "Race").alias("SessionType"),
        (F.col("l_quantity") * 0.5).alias("AirTemp"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("TrackTemp"),
        (F.col("l_discount") * 1000).alias("Humidity"),
        (F.col("l_tax") * 100 + 1000).alias("Pressure"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("Rainfall"),
        (F.col("l_linenumber") * 4.0).alias("WindSpeed"),
    )


_SQL_WEATHER = """
SELECT CAST(year(l_shipdate) AS INTEGER) AS "Year", 'GP ' || month(l_shipdate) AS "GrandPrix",
  CASE WHEN l_linenumber % 2 = 0 THEN 'Race' END AS "SessionType", l_quantity * 0.5 AS "AirTemp",
  CASE WHEN l_linestatus = 'O' THEN l_quantity END AS "TrackTemp", l_discount * 1000 AS "Humidity",
  l_tax * 100 + 1000 AS "Pressure", CASE l_returnflag WHEN 'R' THEN TRUE WHEN 'A' THEN FALSE END AS "Rainfall",
  l_linenumber * 4.0::DOUBLE AS "WindSpeed"
FROM lineitem"""


# --- schedule, circuits, runs -----------------------------------------------------------------------------


def _schedule(t) -> DataFrame:
    """An event per customer: five seasons, rounds numbered by customer."""
    k, place = F.col("c_custkey"), F.col("c_nationkey")
    return t.customer.select(
        (k % 5 + 2022).cast("int").alias("Year"),
        k.cast("int").alias("RoundNumber"),
        F.when(k % 12 == 5, _text("Pre-Season Testing ", k))
        .otherwise(F.concat(F.lit("Nation_"), place.cast("string"), F.lit(" Grand Prix "), k.cast("string")))
        .alias("EventName"),
        F.date_add(F.lit("2025-01-01").cast("date"), (k % 400).cast("int")).alias("EventDate"),
        F.when(k % 3 == 1, _text("Town ", place)).when(k % 3 == 2, _text("Lost ", k)).otherwise(_text("Nation_", place)).alias("Location"),
        F.col("c_mktsegment").alias("Country"),
    )


_SQL_SCHEDULE = """
SELECT CAST(c_custkey % 5 + 2022 AS INTEGER) AS "Year", CAST(c_custkey AS INTEGER) AS "RoundNumber",
  CASE WHEN c_custkey % 12 = 5 THEN 'Pre-Season Testing ' || c_custkey ELSE 'Nation_' || c_nationkey || ' Grand Prix ' || c_custkey END AS "EventName",
  DATE '2025-01-01' + CAST(c_custkey % 400 AS INTEGER) AS "EventDate",
  CASE c_custkey % 3 WHEN 1 THEN 'Town ' || c_nationkey WHEN 2 THEN 'Lost ' || c_custkey ELSE 'Nation_' || c_nationkey END AS "Location",
  c_mktsegment AS "Country"
FROM customer"""


def _circuits(t) -> DataFrame:
    k = F.col("s_nationkey")
    return t.supplier.select(
        (k % 5 + 2022).cast("int").alias("Year"),
        F.col("s_suppkey").alias("ordinal"),
        F.concat(F.lit("Nation_"), k.cast("string"), F.lit(" Ring "), F.col("s_suppkey").cast("string")).alias("circuitName"),
        _text("circuit_", F.col("s_suppkey")).alias("circuitId"),
        F.col("s_acctbal").alias("latitude"),
        (F.col("s_acctbal") / 2).alias("longitude"),
        _text("Town ", k).alias("locality"),
        _text("Land ", k).alias("country"),
    )


_SQL_CIRCUITS = """
SELECT CAST(s_nationkey % 5 + 2022 AS INTEGER) AS "Year", s_suppkey AS ordinal,
  'Nation_' || s_nationkey || ' Ring ' || s_suppkey AS "circuitName", 'circuit_' || s_suppkey AS "circuitId",
  s_acctbal AS latitude, s_acctbal / 2 AS longitude, 'Town ' || s_nationkey AS locality, 'Land ' || s_nationkey AS country
FROM supplier"""


def _runs(t) -> DataFrame:
    """A run per user and event type; metrics are exact (minimum, maximum, count)."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return (
        t.events.groupBy("user_id", "event_type")
        .agg(
            F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"),
            F.min(ms).alias("start_time"), F.max(ms).alias("last_time"),
        )
        .select(
            F.concat(F.lit("run-"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("-"), F.col("event_type")).alias("run_id"),
            F.when(F.col("user_id") % 5 != 0, _text("run of ", F.col("user_id"))).alias("run_name"),
            F.col("event_type").alias("experiment"),
            _text("race ", F.col("user_id") % 8).alias("race_name"),
            F.when(F.col("user_id") % 6 == 0, "RUNNING").otherwise("FINISHED").alias("status"),
            "start_time",
            # a whole number of hundredths of a minute after the start
            F.when(F.col("user_id") % 6 != 0, F.col("last_time") - (F.col("last_time") - F.col("start_time")) % 600).alias("end_time"),
            F.create_map(F.lit("max_iter"), (F.col("user_id") % 50).cast("string"), F.lit("step_size"), F.lit("0.1")).alias("params"),
            F.when(
                F.col("user_id") % 9 != 0,
                F.create_map(F.lit("r2_score"), F.col("lo"), F.lit("rmse"), F.col("hi"), F.lit("samples"), F.col("n").cast("double")),
            ).otherwise(F.create_map(F.lit("rmse"), F.col("hi"))).alias("metrics"),
            F.create_map(F.lit("race_name"), _text("race ", F.col("user_id") % 8)).alias("tags"),
        )
    )


_SQL_RUNS = """
SELECT 'run-' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '-' || event_type AS run_id,
  CASE WHEN user_id % 5 <> 0 THEN 'run of ' || user_id END AS run_name, event_type AS experiment, 'race ' || (user_id % 8) AS race_name,
  CASE WHEN user_id % 6 = 0 THEN 'RUNNING' ELSE 'FINISHED' END AS status,
  min(epoch_us(ts) // 1000) AS start_time, CASE WHEN user_id % 6 <> 0 THEN max(epoch_us(ts) // 1000) - (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) % 600 END AS end_time,
  CAST(user_id % 50 AS VARCHAR) AS p_max_iter, CASE WHEN user_id % 9 <> 0 THEN min(value) END AS r2_score, max(value) AS rmse,
  CASE WHEN user_id % 9 <> 0 THEN CAST(count(*) AS DOUBLE) END AS samples
FROM events GROUP BY user_id, event_type"""

DERIVED = {
    "timed": _timed_events,
    "laps": _laps,
    "timed_laps": _timed_laps,
    "samples": _samples,
    "drivers": _drivers,
    "durations": _durations,
    "results": _results,
    "predictions": _predictions,
    "weather": _weather,
    "schedule": _schedule,
    "circuits": _circuits,
    "runs": _runs,
}
SQL = {
    "timed": _SQL_TIMED,
    "laps": _SQL_LAPS,
    "timed_laps": _SQL_TIMED_LAPS,
    "samples": _SQL_SAMPLES,
    "drivers": _SQL_DRIVERS,
    "durations": _SQL_DURATIONS,
    "results": _SQL_RESULTS,
    "predictions": _SQL_PREDICTIONS,
    "weather": _SQL_WEATHER,
    "schedule": _SQL_SCHEDULE,
    "circuits": _SQL_CIRCUITS,
    "runs": _SQL_RUNS,
}
