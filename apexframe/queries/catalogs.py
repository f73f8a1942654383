"""Catalogue, status and schedule queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import runs as U
from ..operators.ordered import scratch
from ..operators.partials import merged_sessions, session_partials
from ..sources.writers import write_batch
from .registry import query

_NAMES = ["customer", "supplier", "part", "orders", "lineitem", "events"]


@query("agg5_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in _NAMES))
def _(t):
    return C.table_counts({n: getattr(t, n) for n in _NAMES})


_SESSION = ["Year", "GrandPrix", "SessionType"]


def _counts(t):
    laps = t.laps
    tables = {
        "telemetry": laps,
        "car_telemetry": t.samples.filter("GrandPrix <> 'Grand Prix 1'"),
        "driver_info": t.drivers.filter("Year <> 2024"),
    }
    return C.session_table_counts(tables, _SESSION)


_SQL_COUNTS = """(SELECT "Year", "GrandPrix", "SessionType", count(*) AS n, 'telemetry' AS table_name FROM laps GROUP BY ALL UNION ALL
SELECT "Year", "GrandPrix", "SessionType", count(*), 'car_telemetry' FROM samples WHERE "GrandPrix" <> 'Grand Prix 1' GROUP BY ALL UNION ALL
SELECT "Year", "GrandPrix", "SessionType", count(*), 'driver_info' FROM drivers WHERE "Year" <> 2024 GROUP BY ALL)"""


@query("agg5_session_table_counts", f"SELECT * FROM {_SQL_COUNTS}", uses="timed laps samples drivers")
def _(t):
    return _counts(t)


@query("agg5_kept_catalogue", """
SELECT 'telemetry' AS table_name, "Year", "GrandPrix", "SessionType", count(*) AS n, count(DISTINCT "Driver") AS drivers, count(DISTINCT "Team") AS teams FROM laps GROUP BY ALL UNION ALL
SELECT 'driver_info', "Year", "GrandPrix", "SessionType", count(*), count(DISTINCT "Driver"), count(DISTINCT "TeamName") FROM drivers GROUP BY ALL""", uses="timed laps drivers")
def _(t):
    """Counts and sketches that three batches of a table leave, one of them written twice, merged."""
    path = f"{scratch(t.spark)}/apexframe-{uuid.uuid4().hex}"
    for table, rows in (("telemetry", t.laps), ("driver_info", t.drivers)):
        for batch in (0, 1, 2, 1):
            part = rows.filter(F.pmod(F.xxhash64("Driver"), F.lit(3)) == batch)
            write_batch(session_partials(part, table), batch, path, ["table_name"])
    return merged_sessions(t.spark.read.parquet(path))


@query("agg6_availability", f"""
SELECT "Year", "GrandPrix", "SessionType", CAST(sum(n) AS BIGINT) AS total, CAST(3 - count(*) AS INTEGER) AS missing_count,
  array_to_string(list_filter(['car_telemetry', 'driver_info', 'telemetry'], lambda x: NOT list_contains(list(table_name), x)), ',') AS missing_tables,
  CASE WHEN count(*) = 3 THEN 'exists' WHEN sum(n) > 0 THEN 'processing' ELSE 'not_found' END AS status
FROM {_SQL_COUNTS} GROUP BY "Year", "GrandPrix", "SessionType" """, uses="timed laps samples drivers")
def _(t):
    return C.availability(_counts(t), ["telemetry", "car_telemetry", "driver_info"], _SESSION)


@query("agg6_prediction_status", """SELECT count(*) AS total, CASE WHEN count(*) > 0 THEN 'complete' ELSE 'not_found' END AS status FROM laps WHERE "IsPrediction" """, uses="timed laps")
def _(t):
    counts = C.table_counts({"telemetry": t.laps}, F.col("IsPrediction"))
    return C.prediction_status(counts)


@query("agg7_session_catalogue", """SELECT DISTINCT "Year", "GrandPrix", "SessionType" FROM results""", uses="results")
def _(t):
    return C.session_catalogue(t.results)


@query("agg7_nested_catalogue", """
SELECT "Year", CAST(count(DISTINCT "GrandPrix") AS INTEGER) AS events, string_agg(DISTINCT "GrandPrix", ',' ORDER BY "GrandPrix") AS names FROM results GROUP BY "Year" """, uses="results")
def _(t):
    nested = C.nested_catalogue(t.results)
    return nested.select("Year", F.size("events").alias("events"), F.array_join(F.transform("events", lambda e: e["GrandPrix"]), ",").alias("names"))


@query("agg11_distinct_sessions", """SELECT DISTINCT "Year", "GrandPrix", "SessionType", "Driver" FROM laps""", uses="timed laps")
def _(t):
    return C.distinct_sessions(t.laps, "Driver")


@query("agg15_source_years", """SELECT "GrandPrix", list_sort(list(DISTINCT "Year")) AS source_years FROM results GROUP BY "GrandPrix" """, uses="results")
def _(t):
    return C.source_years(t.results.withColumn("SourceYear", F.col("Year")), ["GrandPrix"])


@query("agg20_distinct_drivers_and_teams", """
SELECT DISTINCT 'driver' AS kind, "Driver" AS name FROM laps UNION ALL SELECT DISTINCT 'team', "Team" FROM laps WHERE "Team" IS NOT NULL""", uses="timed laps")
def _(t):
    drivers = t.laps.select(F.lit("driver").alias("kind"), F.col("Driver").alias("name")).distinct()
    return drivers.unionByName(t.laps.filter("Team IS NOT NULL").select(F.lit("team").alias("kind"), F.col("Team").alias("name")).distinct())


@query("src4_season_schedule", """
SELECT "Year" AS year, "EventName" AS name, "RoundNumber" AS round, strftime("EventDate", '%Y-%m-%d') AS date FROM schedule WHERE "Year" BETWEEN 2023 AND 2025""", uses="schedule")
def _(t):
    return C.season_schedule(t.schedule, 2023, 2025)


@query("src9_newest_schedule", """
SELECT 'newest' AS asked, "Year", "RoundNumber" FROM schedule WHERE "Year" = (SELECT max("Year") FROM schedule WHERE "Year" IN (2026, 2025)) UNION ALL
SELECT 'fallback', "Year", "RoundNumber" FROM schedule WHERE "Year" = 2025""", uses="schedule")
def _(t):
    """The newest of two seasons, and the older one where the newer has no events."""
    newest, fallback = C.newest_schedule(t.schedule, (2026, 2025)), C.newest_schedule(t.schedule, (2999, 2025))
    columns = ["asked", "Year", "RoundNumber"]
    return newest.withColumn("asked", F.lit("newest")).select(columns).unionByName(fallback.withColumn("asked", F.lit("fallback")).select(columns))


@query("prj29_season_progress", """
SELECT "Year", count(*) FILTER (WHERE "EventDate" < DATE '2025-06-01') AS completed, count(*) FILTER (WHERE "EventDate" >= DATE '2025-06-01') AS upcoming,
  CASE WHEN count(*) FILTER (WHERE "EventDate" < DATE '2025-06-01') = 0 THEN 'none' WHEN count(*) FILTER (WHERE "EventDate" < DATE '2025-06-01') < 3 THEN 'limited' ELSE 'ready' END AS verdict
FROM schedule GROUP BY "Year" """, uses="schedule")
def _(t):
    return C.season_progress(t.schedule, F.lit("2025-06-01").cast("date"))


@query("mlp10_run_table", """
SELECT left(run_id, 8) || '...' AS run_label, coalesce(run_name, 'Unnamed') AS run_name, status, to_timestamp(start_time / 1000.0)::TIMESTAMP AS start_time,
  round_even((end_time - start_time) / 60000.0::DOUBLE, 2) AS duration_min, race_name, r2_score, rmse, CAST(NULL AS DOUBLE) AS position_accuracy, run_id FROM runs""", uses="runs")
def _(t):
    return U.run_table(t.runs).withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))


@query("mlp10_wide_metrics", """SELECT run_id, experiment, r2_score, rmse, samples FROM runs""", uses="runs")
def _(t):
    return U.wide_metrics(t.runs, ["r2_score", "rmse", "samples"], "experiment")


@query("mlp12_run_details", """
SELECT run_id, kind, name, value FROM (
 SELECT run_id, 'param' AS kind, 'max_iter' AS name, p_max_iter AS value FROM runs UNION ALL SELECT run_id, 'param', 'step_size', '0.1' FROM runs UNION ALL
 SELECT run_id, 'tag', 'race_name', race_name FROM runs UNION ALL
 SELECT run_id, 'metric', 'rmse', CAST(rmse AS VARCHAR) FROM runs UNION ALL SELECT run_id, 'metric', 'r2_score', CAST(r2_score AS VARCHAR) FROM runs WHERE r2_score IS NOT NULL UNION ALL
 SELECT run_id, 'metric', 'samples', CAST(samples AS VARCHAR) FROM runs WHERE samples IS NOT NULL)""", uses="runs")
def _(t):
    return U.run_details(t.runs)


@query("metric_comparison", """
SELECT metric, run_id, value, CASE metric WHEN 'rmse' THEN 'Rmse Comparison' ELSE 'R2 Score Comparison' END AS title FROM (
 SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, run_id) AS place FROM (
  SELECT run_id, 'r2_score' AS metric, r2_score AS value FROM runs UNION ALL SELECT run_id, 'rmse', rmse FROM runs) WHERE value IS NOT NULL) WHERE place <= 5 UNION ALL
SELECT 'correlation', NULL, round(corr(r2_score, rmse), 6), NULL FROM runs""", uses="runs")
def _(t):
    """Best runs per metric, and how the two metrics correlate."""
    top, matrix = U.metric_comparison(t.runs, ["r2_score", "rmse"])
    pair = matrix.filter("metric_a = 'r2_score' AND metric_b = 'rmse'").select(
        F.lit("correlation").alias("metric"), F.lit(None).cast("string").alias("run_id"), F.round("correlation", 6).alias("value"),
        F.lit(None).cast("string").alias("title"),
    )
    return top.select("metric", "run_id", "value", "title").unionByName(pair)
