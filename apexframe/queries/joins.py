"""Joins: interval and as-of assignment, dimension lookups, name resolution, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import laps as L
from ..operators import lookup as J
from ..operators import results as P
from ..operators.intervals import assign_interval, assign_laps, lap_spans
from ..plans.prediction import with_lap_statistics
from ..sources.readers import new_circuits, scan_session, seasons_of_event
from ..sources.writers import dead_letters
from .aggregates import rounded
from .registry import query
from .scalars import sql_lap_text

_SESSION = ["Year", "GrandPrix", "SessionType"]

# spans: a sign-up opens a span of six hours; spans of a user may overlap
_SQL_SPANS = "(SELECT user_id AS u, event_id AS lap, ts AS s, ts + INTERVAL 6 HOUR AS e FROM events WHERE event_type = 'signup')"


def _spans(t):
    return t.events.filter("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("lap"), F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("e")
    )


@query("join1_interval_closed", f"""
SELECT event_id, min(lap) AS lap FROM events LEFT JOIN {_SQL_SPANS} ON u = user_id AND ts BETWEEN s AND e GROUP BY event_id""")
def _(t):
    points = t.events.select("event_id", "user_id", "ts")
    return assign_interval(points, _spans(t), ["user_id"], "ts", "s", "e", "lap").select("event_id", "lap")


@query("join1_interval_half_open", f"""
SELECT event_id, min(lap) AS lap FROM events LEFT JOIN {_SQL_SPANS} ON u = user_id AND ts >= s AND ts < e GROUP BY event_id""")
def _(t):
    points = t.events.select("event_id", "user_id", "ts")
    return assign_interval(points, _spans(t), ["user_id"], "ts", "s", "e", "lap", mode="half").select("event_id", "lap")


@query("join1_interval_asof", f"""
SELECT event_id, CASE WHEN ts <= e THEN lap END AS lap FROM events ASOF LEFT JOIN {_SQL_SPANS} ON u = user_id AND ts >= s""")
def _(t):
    points = t.events.select("event_id", "user_id", "ts")
    return assign_interval(points, _spans(t), ["user_id"], "ts", "s", "e", "lap", mode="asof").select("event_id", "lap")


_SQL_LAP_SPANS = """(SELECT "Year", "GrandPrix", "SessionType", "Driver", "LapNumber", s AS "StartSeconds",
  CASE WHEN "PitInTime" <> 'NaT' AND "PitInTime" IS NOT NULL THEN ((day_ms + least(lap_ms, 40000)) % 86400000) / 1000.0::DOUBLE ELSE s + "LapTimeSeconds" END AS "EndSeconds"
  FROM (SELECT *, day_ms / 1000.0::DOUBLE AS s FROM timed_laps))"""


@query("join2_lap_spans", f"""
SELECT "Year", "GrandPrix", "SessionType", "Driver", "LapNumber", round("StartSeconds", 3) AS "StartSeconds", round("EndSeconds", 3) AS "EndSeconds"
FROM {_SQL_LAP_SPANS} WHERE "EndSeconds" IS NOT NULL""", uses="timed laps timed_laps")
def _(t):
    from ..functions.records import lap_flags

    return rounded(lap_spans(lap_flags(t.timed_laps)), "StartSeconds", "EndSeconds", digits=3)


@query("prj8_samples_of_laps", f"""
SELECT p.event_id, min(s."LapNumber") AS "LapNumber" FROM (SELECT *, 'D' || "Driver" AS d, day_ms / 1000.0::DOUBLE AS clock FROM samples) p
LEFT JOIN {_SQL_LAP_SPANS} s ON p."Year" = s."Year" AND p."GrandPrix" = s."GrandPrix" AND p."SessionType" = s."SessionType" AND p.d = s."Driver"
  AND round(clock * 1e6) >= round("StartSeconds" * 1e6) AND round(clock * 1e6) <= round("EndSeconds" * 1e6) GROUP BY p.event_id""", uses="timed laps timed_laps samples")
def _(t):
    from ..functions.records import lap_flags

    samples = t.samples.withColumn("Driver", F.concat(F.lit("D"), "Driver"))
    return assign_laps(samples, lap_spans(lap_flags(t.timed_laps))).select("event_id", "LapNumber")


@query("join3_latest_team", """
SELECT event_id, "Team" FROM samples LEFT JOIN (SELECT "DriverNumber", arg_max("TeamName", ("Year", "GrandPrix")) AS "Team" FROM drivers GROUP BY "DriverNumber") d
ON samples."Driver" = d."DriverNumber" """, uses="timed samples drivers")
def _(t):
    info = t.drivers.withColumn("Driver", F.col("DriverNumber"))
    return J.with_latest_team(t.samples, info).select("event_id", "Team")


@query("join4_team_id", """
SELECT o_orderkey, CASE WHEN c IN ('HOUSEHOLD', 'household') THEN 1 WHEN c IN ('MACHINERY', 'machinery') THEN 2 ELSE 0 END AS "TeamID" FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN lower(c_mktsegment) WHEN o_orderkey % 7 <> 1 THEN c_mktsegment END AS c
  FROM orders JOIN customer ON o_custkey = c_custkey)""")
def _(t):
    ids = t.customer.filter("c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')").groupBy(F.col("c_mktsegment").alias("TeamName")).agg(
        F.max(F.when(F.col("c_mktsegment") == "HOUSEHOLD", 1).otherwise(2)).alias("TeamID")
    )
    segment = F.when(F.col("o_orderkey") % 7 == 0, F.lower("c_mktsegment")).when(F.col("o_orderkey") % 7 != 1, F.col("c_mktsegment"))
    named = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", segment.alias("Team"))
    return J.team_id(named, ids).select("o_orderkey", "TeamID")


_D1, _D2 = "D7", "D42"


@query("join5_lap_by_lap", f"""
SELECT lap AS "LapNumber", a AS first_time, b AS second_time, round(a - b, 6) AS gap, {sql_lap_text('a')} AS first_display, {sql_lap_text('b')} AS second_display
FROM (SELECT coalesce(x.lap, y.lap) AS lap, x.value AS a, y.value AS b FROM
 (SELECT value, row_number() OVER (ORDER BY ts) AS lap FROM events WHERE user_id = 7) x FULL JOIN
 (SELECT value, row_number() OVER (ORDER BY ts) AS lap FROM events WHERE user_id = 42) y ON x.lap = y.lap)""")
def _(t):
    from ..operators.ordered import number_rows

    numbered = number_rows(t.events.select("user_id", "ts", "value"), ["user_id"], [F.col("ts")], "LapNumber")
    laps = numbered.select(F.concat(F.lit("D"), "user_id").alias("Driver"), "LapNumber", F.col("value").alias("LapTimeSeconds"))
    return rounded(L.lap_by_lap(laps, _D1, _D2, []).drop("gap_display"), "gap")


@query("join6_backfill_position", """
SELECT l.event_id, CASE WHEN count(p) OVER (PARTITION BY l."Year", l."GrandPrix", l."SessionType") = 0 AND l."SessionType" = 'Race' THEN r.place ELSE p END AS "Position"
FROM (SELECT *, CASE WHEN "GrandPrix" IN ('Grand Prix 2', 'Grand Prix 3') THEN NULL ELSE "Position" END AS p FROM laps) l
LEFT JOIN (SELECT "Year", "GrandPrix", "SessionType", "Driver", min("TeamID") * 1.0::DOUBLE AS place FROM drivers GROUP BY ALL) r USING ("Year", "GrandPrix", "SessionType", "Driver")""",
       uses="timed laps drivers")
def _(t):
    holes = t.laps.withColumn("Position", F.when(~F.col("GrandPrix").isin("Grand Prix 2", "Grand Prix 3"), F.col("Position")))
    results = t.drivers.select(*_SESSION, "Driver", F.col("TeamID").cast("double").alias("Position"))
    return P.backfill_position(holes, results, _SESSION).select("event_id", "Position")


@query("join7_results_with_lap_statistics", """
SELECT o_orderkey, round(a, 6) AS "AvgLapTime", n AS "CompletedLaps" FROM orders LEFT JOIN
 (SELECT l_orderkey, avg(l_quantity) AS a, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def _(t):
    laps = t.lineitem.filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("LapTimeSeconds"), F.col("l_tax").alias("SpeedST"),
        (F.col("l_linestatus") == "O").alias("IsPersonalBest"), F.col("l_linenumber").alias("Stint"), F.col("l_linenumber").alias("LapNumber"),
    )
    return rounded(with_lap_statistics(t.orders.select("o_orderkey"), laps, ["o_orderkey"]).select("o_orderkey", "AvgLapTime", "CompletedLaps"), "AvgLapTime")


@query("join8_results_with_weather", """
SELECT o_orderkey, round(a, 6) AS "AvgAirTemp", rain AS "HadRainfall" FROM results LEFT JOIN
 (SELECT "Year", "GrandPrix", avg("AirTemp") AS a, bool_or(coalesce("Rainfall", FALSE)) AS rain FROM weather GROUP BY ALL) USING ("Year", "GrandPrix")""",
       uses="results weather")
def _(t):
    stats = L.weather_statistics(t.weather)
    return rounded(t.results.join(stats, ["Year", "GrandPrix"], "left").select("o_orderkey", "AvgAirTemp", "HadRainfall"), "AvgAirTemp")


@query("join9_schedule_with_circuits", """
SELECT "Year", "RoundNumber" AS round, "EventName" AS name, "Country" AS country, "Location" AS location, strftime("EventDate", '%Y-%m-%d') AS date,
  lat, long, loc AS locality, "circuitId", tier AS match_tier FROM schedule LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY y, r ORDER BY tier, rank) AS pick FROM (
    SELECT s."Year" AS y, s."RoundNumber" AS r, 1 AS tier, ordinal AS rank, latitude AS lat, longitude AS long, locality AS loc, "circuitId"
    FROM schedule s JOIN circuits c ON s."Year" = c."Year" AND (contains(lower("circuitName"), lower("Location")) OR contains(lower("Location"), lower("circuitName"))
      OR contains(lower("circuitId"), lower("Location")) OR contains(lower("Location"), lower("circuitId")))
    UNION ALL
    SELECT s."Year", s."RoundNumber", 2, -ordinal, latitude, longitude, locality, "circuitId" FROM schedule s JOIN circuits c ON s."Year" = c."Year" AND lower("Location") = lower(locality)))
  ON y = "Year" AND r = "RoundNumber" AND pick = 1""", uses="schedule circuits")
def _(t):
    return J.schedule_with_circuits(t.schedule, t.circuits)


_SQL_REQUESTS = """(SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'nation_' || s_nationkey WHEN 1 THEN CAST(s_suppkey AS VARCHAR) WHEN 2 THEN 'Lost ' || s_suppkey
  WHEN 3 THEN 'building' WHEN 4 THEN 'The Nation_' || s_nationkey || ' Grand Prix ' || s_suppkey || ' of old' ELSE 'nowhere' END AS text FROM supplier)"""


def _requests(t):
    k, place = F.col("s_suppkey"), F.col("s_nationkey")
    join = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    text = (
        F.when(k % 6 == 0, join("nation_", place.cast("string"))).when(k % 6 == 1, k.cast("string")).when(k % 6 == 2, join("Lost ", k.cast("string")))
        .when(k % 6 == 3, "building").when(k % 6 == 4, join("The Nation_", place.cast("string"), " Grand Prix ", k.cast("string"), " of old")).otherwise("nowhere")
    )
    return t.supplier.select(k.alias("id"), text.alias("text"))


@query("join10_source_event", f"""
SELECT q.id, text, tier AS match_tier, ev AS "match_EventName" FROM {_SQL_REQUESTS} q LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, "RoundNumber") AS pick FROM (
    SELECT id, CASE WHEN contains(lower("EventName"), lower(text)) OR contains(lower(text), lower("EventName")) THEN 1
      WHEN contains(lower("Location"), lower(text)) OR contains(lower("Country"), lower(text)) THEN 2 END AS tier, "RoundNumber", "EventName" AS ev
    FROM {_SQL_REQUESTS}, schedule) WHERE tier IS NOT NULL) m ON q.id = m.id AND pick = 1""", uses="schedule")
def _(t):
    return J.source_event(_requests(t), t.schedule, ["id"], "text")


@query("join11_find_event", f"""
SELECT q.id, text, tier AS match_tier, ev AS "match_EventName", n AS "match_RoundNumber" FROM {_SQL_REQUESTS} q LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, n) AS pick FROM (
    SELECT id, CASE WHEN contains(lower("EventName"), lower(text)) THEN 1 WHEN TRY_CAST(text AS INTEGER) = "RoundNumber" THEN 2 END AS tier,
      "RoundNumber" AS n, "EventName" AS ev FROM {_SQL_REQUESTS}, schedule) WHERE tier IS NOT NULL) m ON q.id = m.id AND pick = 1""", uses="schedule")
def _(t):
    return J.find_event(_requests(t), t.schedule, ["id"], "text")


@query("join12_driver_codes", """
SELECT event_id, s."Driver" AS "DriverNumber", d."Driver" AS "DriverCode" FROM samples s JOIN drivers d
ON s."Driver" = d."DriverNumber" AND s."Year" = d."Year" AND s."GrandPrix" = d."GrandPrix" AND s."SessionType" = d."SessionType" """, uses="timed samples drivers")
def _(t):
    return J.by_driver_number(t.samples, t.drivers, _SESSION).select("event_id", "DriverNumber", "DriverCode")


@query("join13_drivers_present", """
SELECT n."Year", n."GrandPrix", n."SessionType", coalesce(d."Driver", n."DriverNumber") AS "Driver", n."DriverNumber",
  coalesce(d."FullName", 'Driver ' || n."DriverNumber") AS "FullName", d."TeamName", coalesce(d."TeamID", 0) AS "TeamID",
  coalesce(d."Driver" || ' - ' || d."FullName", 'Driver #' || n."DriverNumber") AS "DisplayName"
FROM (SELECT DISTINCT "Year", "GrandPrix", "SessionType", "Driver" AS "DriverNumber" FROM samples WHERE event_type IN ('view', 'click')) n
LEFT JOIN drivers d USING ("Year", "GrandPrix", "SessionType", "DriverNumber")""", uses="timed samples drivers")
def _(t):
    series = [t.samples.filter(F.col("event_type") == kind) for kind in ("view", "click")]
    return J.drivers_present(series, t.drivers, _SESSION)


@query("join16_exact_or_wider", """
SELECT o_orderkey, "SessionType" FROM (SELECT *, bool_or("Driver" = 'D1' OR o_orderkey % 97 = 0) OVER (PARTITION BY "Year", "GrandPrix") AS any_exact FROM results)
WHERE o_orderkey % 97 = 0 OR "Driver" = 'D1' OR NOT any_exact""", uses="results")
def _(t):
    exact = (F.col("Driver") == "D1") | (F.col("o_orderkey") % 97 == 0)
    return J.exact_or_wider(t.results, exact, ["Year", "GrandPrix"]).select("o_orderkey", "SessionType")


@query("join17_result_source_fallback", """
SELECT "Year", "GrandPrix", "Driver", 'primary' AS source FROM results WHERE "SessionType" = 'Race' AND "GrandPrix" <> 'GP 3' UNION ALL
SELECT "Year", "GrandPrix", "Driver", 'fallback' FROM results f WHERE "SessionType" = 'Q' AND NOT EXISTS (
  SELECT 1 FROM results p WHERE p."SessionType" = 'Race' AND p."GrandPrix" <> 'GP 3' AND p."Year" = f."Year" AND p."GrandPrix" = f."GrandPrix")""", uses="results")
def _(t):
    part = lambda s, name: t.results.filter(F.col("SessionType") == s).select("Year", "GrandPrix", "Driver", F.lit(name).alias("source"))
    return J.prefer(part("Race", "primary").filter("GrandPrix <> 'GP 3'"), part("Q", "fallback"), ["Year", "GrandPrix"])


@query("join18_race_parameters", """
SELECT "FullName", CASE "GrandPrix" WHEN 'Australian Grand Prix' THEN 58 WHEN 'Monaco Grand Prix' THEN 78 WHEN 'British Grand Prix' THEN 52
  WHEN 'Italian Grand Prix' THEN 53 WHEN 'Singapore Grand Prix' THEN 62 ELSE 58 END::DOUBLE AS "TotalLaps",
 CASE "GrandPrix" WHEN 'Australian Grand Prix' THEN 85 WHEN 'Monaco Grand Prix' THEN 75 WHEN 'British Grand Prix' THEN 87
  WHEN 'Italian Grand Prix' THEN 82 WHEN 'Singapore Grand Prix' THEN 95 ELSE 90 END::DOUBLE AS "AvgLap",
 CASE "GrandPrix" WHEN 'Australian Grand Prix' THEN 0.10 WHEN 'Monaco Grand Prix' THEN 0.05 WHEN 'British Grand Prix' THEN 0.12
  WHEN 'Italian Grand Prix' THEN 0.08 WHEN 'Singapore Grand Prix' THEN 0.15 ELSE 0.10 END::DOUBLE AS "TyreFactor" FROM predictions""", uses="predictions")
def _(t):
    return J.race_parameters(t.predictions).select("FullName", "TotalLaps", "AvgLap", "TyreFactor")


@query("prj24_team_name_fallback", """
SELECT o_orderkey, CASE WHEN count(tn) OVER (PARTITION BY "Year", "GrandPrix", "SessionType") = 0 THEN "Team" ELSE tn END AS "TeamName"
FROM (SELECT *, CASE WHEN "GrandPrix" <> 'GP 3' THEN "TeamName" END AS tn FROM results)""", uses="results")
def _(t):
    holes = t.results.withColumn("TeamName", F.when(F.col("GrandPrix") != "GP 3", F.col("TeamName")))
    return P.team_name_fallback(holes, _SESSION).select("o_orderkey", "TeamName")


@query("src3_filtered_projection", """
SELECT "Driver", "DriverNumber", "Position", "Status" FROM results WHERE "Year" = 1997 AND "GrandPrix" = 'GP 4' AND "SessionType" = 'Race' """, uses="results")
def _(t):
    return scan_session(t.results, ["Driver", "DriverNumber", "Position", "Status"], 1997, "GP 4", "Race")


@query("src3_filtered_lineitem", """SELECT l_orderkey, l_quantity FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'R' """)
def _(t):
    return scan_session(t.lineitem, ["l_orderkey", "l_quantity"], l_suppkey=7, l_returnflag="R")


@query("src5_new_circuits", """SELECT "Year" AS year, "circuitId" FROM circuits WHERE "Year" IN (2023, 2025)""", uses="circuits")
def _(t):
    fetched = t.circuits.select(F.col("Year").alias("year"), "circuitId")
    return new_circuits(fetched, fetched.filter("year NOT IN (2023, 2025)"))


@query("src6_event_over_seasons", """
SELECT o_orderkey, r."Year", r."GrandPrix" FROM results r JOIN (SELECT "Year", arg_min("GrandPrix", o_orderkey) AS g FROM results
  WHERE contains(lower("GrandPrix"), 'gp 1') AND "Year" IN (1996, 1998, 2000) GROUP BY "Year") e ON r."Year" = e."Year" AND r."GrandPrix" = e.g
WHERE r."SessionType" = 'Race' """, uses="results")
def _(t):
    schedule = t.results.select("Year", F.col("GrandPrix").alias("EventName"), F.col("o_orderkey").alias("RoundNumber"))
    tables = seasons_of_event({"results": t.results}, schedule, "GP 1", [1996, 1998, 2000])
    return tables["results"].select("o_orderkey", "Year", "GrandPrix")


@query("set1_concat_seasons", """
SELECT o_orderkey, CASE WHEN "Year" < 1996 THEN "Status" END AS "Status", CASE WHEN "Year" >= 1996 THEN "Points" END AS "Points"
FROM results WHERE "Year" IS NOT NULL""", uses="results")
def _(t):
    parts = [t.results.filter("Year < 1996").select("o_orderkey", "Status"), t.results.filter("Year >= 1996").select("o_orderkey", "Points")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query("set2_distinct_union", """
SELECT o_custkey AS number FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def _(t):
    one = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("number"))
    return one.union(t.customer.filter("c_acctbal < 0").select("c_custkey")).distinct()


@query("set3_missing_keys", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def _(t):
    finished = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(finished, "c_custkey", "left_anti")


@query("set4_other_options", """SELECT DISTINCT "Driver" FROM laps WHERE "Driver" <> 'D7' """, uses="timed laps")
def _(t):
    return C.other_options(t.laps.select("Driver").distinct(), F.col("Driver") == "D7")


@query("set5_has_changed", """
SELECT count(*) FILTER (WHERE o_orderkey % 10 = 0 AND o_orderkey % 7 <> 0) AS added, count(*) FILTER (WHERE o_orderkey % 7 = 0 AND o_orderkey % 10 <> 0) AS removed, TRUE AS changed FROM orders""")
def _(t):
    base = t.orders.select("o_orderkey", "o_custkey")
    return C.has_changed(base.filter("o_orderkey % 10 <> 0"), base.filter("o_orderkey % 7 <> 0"))


@query("snk6_dead_letters", """SELECT o_orderkey, "Position" IS NOT NULL AND "Position" <= 20 AS valid FROM results""", uses="results")
def _(t):
    good, bad = dead_letters(t.results.select("o_orderkey", "Position"), F.col("Position") <= 20)
    mark = lambda df, ok: df.select("o_orderkey", F.lit(ok).alias("valid"))
    return DataFrame.unionByName(mark(good, True), mark(bad, False))
