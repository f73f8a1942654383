"""Ordered operators: fills, running sums, places, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as W
from ..operators import results as P
from ..operators import runs as U
from ..operators.align import asof_align, proportional_align, zip_align
from ..operators.results import nulls_last
from ..plans import prediction as M
from .aggregates import rounded
from .registry import query

_USER = ["user_id"]
_TIME = ["ts", "event_id"]


def _order(*names):
    return [F.col(n) for n in names]


@query("win1_fill_last_known", """
SELECT event_id, user_id, CASE WHEN v IS NULL THEN known ELSE v END AS value, v IS NULL AND known IS NOT NULL AS filled FROM (
SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known
FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM events))""")
def _(t):
    holes = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    filled = W.fill_last_known(holes, "value", _USER, _order(*_TIME), "filled", missing=F.col("value").isNull())
    return filled.select("event_id", "user_id", "value", "filled")


@query("win1_fill_lap_times", """
SELECT event_id, CASE WHEN v IS NULL AND known IS NOT NULL THEN known ELSE "LapTime" END AS "LapTime", v IS NULL AND known IS NOT NULL AS "LapTimeFilledByPrevious" FROM (
SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY "Year", "GrandPrix", "SessionType", "Driver" ORDER BY "LapNumber" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known
FROM (SELECT *, CASE WHEN "LapTime" NOT IN ('', 'NaT') THEN "LapTime" END AS v FROM laps))""", uses="timed laps")
def _(t):
    keys = ["Year", "GrandPrix", "SessionType", "Driver"]
    return W.fill_last_known(t.laps, "LapTime", keys, _order("LapNumber")).select("event_id", "LapTime", "LapTimeFilledByPrevious")


@query("win2_fill_speed", """
SELECT event_id, coalesce(last_value(nullif("Speed", 0) IGNORE NULLS) OVER (PARTITION BY "Driver" ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS "Speed"
FROM samples""", uses="timed samples")
def _(t):
    return W.fill_speed(t.samples.select("event_id", "Driver", "ts", "Speed"), "Speed", ["Driver"], _order("ts")).select("event_id", "Speed")


@query("win7_gap_to_leader", """
SELECT o_orderkey, round("GapToLeader", 6) AS "GapToLeader", CASE WHEN g < 0.001 THEN 'Leader' WHEN g > 60 THEN printf('+%dm %.3fs', CAST(floor(g / 60) AS BIGINT), g % 60)
  ELSE printf('+%.3fs', g) END AS "Gap" FROM (SELECT *, "GapToLeader" AS g FROM (
SELECT o_orderkey, o_totalprice - first_value(o_totalprice) OVER (PARTITION BY "Year", "GrandPrix" ORDER BY "Position" ASC NULLS LAST, o_orderkey) AS "GapToLeader" FROM results))""", uses="results")
def _(t):
    rows = t.results.select("o_orderkey", "Year", "GrandPrix", "Position", "o_totalprice")
    return rounded(P.gap_to_leader(rows, ["Year", "GrandPrix"], "Position", "o_totalprice", "o_orderkey"), "GapToLeader").select(
        "o_orderkey", "GapToLeader", "Gap"
    )


@query("win8_sequential_places", """
SELECT o_orderkey, row_number() OVER (PARTITION BY "Year" ORDER BY "GridPosition", o_orderkey) AS place FROM results""", uses="results")
def _(t):
    rows = t.results.select("o_orderkey", "Year", "GridPosition")
    return P.sequential_places(rows, ["Year"], _order("GridPosition", "o_orderkey"), "place").select("o_orderkey", "place")


@query("win9_lap_progress", """
SELECT event_id, round(percent_rank() OVER (PARTITION BY user_id ORDER BY ts), 9) AS "LapProgress" FROM events""")
def _(t):
    placed = W.progress(t.events.select("event_id", "user_id", "ts"), _USER, _order("ts"))
    return rounded(placed, "LapProgress", digits=9).select("event_id", "LapProgress")


@query("win10_running_order", """
SELECT event_id, lap, total AS "CumulativeTime", row_number() OVER (PARTITION BY lap ORDER BY total, user_id) AS "RunningPosition" FROM (
SELECT event_id, user_id, lap, CAST(sum(CAST(round(value * 1e6) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY lap) AS BIGINT) / 1e6::DOUBLE AS total FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS lap FROM events))""")
def _(t):
    laps = W.number_rows(t.events.select("event_id", "user_id", "ts", "value"), _USER, _order("ts"), "lap")
    return W.running_order(laps, [], "user_id", "lap", "value").select("event_id", "lap", "CumulativeTime", "RunningPosition")


@query("win12_grid_places", """
SELECT o_orderkey, CASE WHEN "Position" IS NULL THEN 'DNF' ELSE CAST(row_number() OVER (PARTITION BY "Year", "SessionType" ORDER BY coalesce("Position", 999), o_orderkey) AS VARCHAR) END AS "GridPlace"
FROM results""", uses="results")
def _(t):
    rows = t.results.select("o_orderkey", "Year", "SessionType", F.coalesce("Position", F.lit(999.0)).alias("PositionNumeric"))
    return P.grid_places(rows, ["Year", "SessionType"], "o_orderkey").select("o_orderkey", "GridPlace")


_SQL_SIDE = """(SELECT user_id, value, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = '{}')"""


def _sides(t):
    one = t.events.filter("event_type = 'view'").select("user_id", "event_id", "ts")
    two = t.events.filter("event_type = 'click'").select("user_id", "ts", F.col("value").alias("Speed"))
    return one, two


@query("join14_zip_by_position", f"""
SELECT a.event_id, a.i AS row_number, coalesce(last_value(nullif(b.value, 0) IGNORE NULLS) OVER (PARTITION BY a.user_id ORDER BY a.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS "Speed"
FROM {_SQL_SIDE.format('view')} a LEFT JOIN {_SQL_SIDE.format('click')} b ON a.user_id = b.user_id AND a.i = b.i""")
def _(t):
    one, two = _sides(t)
    zipped = zip_align(one, two, _USER, _order("ts"), _order("ts"), ["Speed"], fill="Speed")
    return zipped.select("event_id", "row_number", "Speed")


@query("join14_align_by_time", """
SELECT a.event_id, b.value AS "Speed" FROM (SELECT * FROM events WHERE event_type = 'view') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def _(t):
    one, two = _sides(t)
    return asof_align(one, two, _USER, "ts", "ts", ["Speed"]).select("event_id", "Speed")


@query("join15_proportional_align", f"""
SELECT a.event_id, a.i - 1 AS frame, b.value AS "Speed" FROM {_SQL_SIDE.format('view')} a
LEFT JOIN (SELECT user_id, count(*) AS m FROM events WHERE event_type = 'click' GROUP BY user_id) c ON a.user_id = c.user_id
LEFT JOIN {_SQL_SIDE.format('click')} b ON a.user_id = b.user_id AND b.i = least(CAST(floor((a.i - 1) / a.n::DOUBLE * c.m) AS BIGINT), c.m - 1) + 1""")
def _(t):
    one, two = _sides(t)
    return proportional_align(one, two, _USER, _order("ts"), _order("ts"), ["Speed"]).select("event_id", "frame", "Speed")


@query("srt1_sorted_samples", """SELECT "Driver", "Time", event_id FROM samples ORDER BY "Driver", day_ms, event_id""", uses="timed samples")
def _(t):
    return t.samples.orderBy("Driver", "day_ms", "event_id").select("Driver", "Time", "event_id")


@query("srt2_sorted_results", """SELECT o_orderkey, "Position" FROM results ORDER BY "Position" ASC NULLS LAST, o_orderkey""", uses="results")
def _(t):
    return t.results.select("o_orderkey", "Position").orderBy(F.col("Position").asc_nulls_last(), "o_orderkey")


@query("srt3_multi_key_sort", """SELECT event_id, "LapNumber", "Driver" FROM laps ORDER BY "LapNumber", "Driver" """, uses="timed laps")
def _(t):
    return t.laps.select("event_id", "LapNumber", "Driver").orderBy("LapNumber", "Driver")


@query("srt4_top_runs_by_metric", """
SELECT run_id, r2_score FROM runs WHERE r2_score IS NOT NULL ORDER BY r2_score DESC, run_id LIMIT 5""", uses="runs")
def _(t):
    return U.top_by_metric(U.wide_metrics(t.runs, ["r2_score"]), "r2_score")


@query("srt4_top_runs_of_every_metric", """
SELECT run_id, metric, value, place FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, run_id) AS place FROM (
  SELECT run_id, 'r2_score' AS metric, r2_score AS value FROM runs UNION ALL SELECT run_id, 'rmse', rmse FROM runs UNION ALL
  SELECT run_id, 'samples', samples FROM runs) WHERE value IS NOT NULL) WHERE place <= 5""", uses="runs")
def _(t):
    return U.top_runs(t.runs).select("run_id", "metric", "value", F.col("place").cast("bigint").alias("place"))


@query("srt5_first_ten_predictions", """
SELECT "FullName", "PredictedPosition" FROM predictions ORDER BY "PredictedPosition", "FullName" LIMIT 10""", uses="predictions")
def _(t):
    return M.top_predictions(t.predictions).select("FullName", "PredictedPosition")


@query("srt6_recent_runs", """
SELECT run_id, experiment, place FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY start_time DESC, run_id) AS place FROM runs) WHERE place <= 5""", uses="runs")
def _(t):
    return U.recent_runs(t.runs).select("run_id", "experiment", F.col("place").cast("bigint").alias("place"))


@query("srt7_preview", """SELECT event_id, value FROM events ORDER BY event_id LIMIT 5""")
def _(t):
    return t.events.select("event_id", "value").orderBy("event_id").limit(5)


@query("srt2_unknown_last_order", """
SELECT o_orderkey, row_number() OVER (PARTITION BY "GrandPrix" ORDER BY "Position" ASC NULLS LAST, o_orderkey) AS place FROM results""", uses="results")
def _(t):
    rows = t.results.select("o_orderkey", "GrandPrix", "Position")
    numbered = P.sequential_places(rows, ["GrandPrix"], [nulls_last(F.col("Position")), F.col("o_orderkey")], "place")
    return numbered.select("o_orderkey", "place")
