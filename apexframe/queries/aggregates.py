"""Grouped aggregates over laps, weather, results and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import laps as L
from ..operators import runs as U
from ..operators.lookup import dense_ids, race_laps
from ..operators.ordered import group_medians, impute_by_group, value_counts
from ..operators.partials import merged_quantiles, quantile_partials, sketched_medians
from ..operators.results import group_means
from ..plans import prediction as M
from .registry import query


def rounded(df, *columns, digits=6):
    """Computed doubles to a fixed number of places, for comparison."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("agg1_lap_statistics", """
SELECT "Driver", "Year", "GrandPrix", round(avg("LapTimeSeconds"), 6) AS "AvgLapTime", min("LapTimeSeconds") AS "BestLapTime",
  round(stddev_samp("LapTimeSeconds"), 6) AS "LapTimeConsistency", round(avg("SpeedST"), 6) AS "AvgSpeed", max("SpeedST") AS "MaxSpeed",
  count(*) FILTER (WHERE "IsPersonalBest") AS "PersonalBestCount", count(DISTINCT "Stint") AS "PitStopCount", count("LapNumber") AS "CompletedLaps"
FROM timed_laps GROUP BY "Driver", "Year", "GrandPrix" """, uses="timed laps timed_laps")
def _(t):
    stats = L.lap_statistics(t.timed_laps, ("Driver", "Year", "GrandPrix"))
    return rounded(stats, "AvgLapTime", "LapTimeConsistency", "AvgSpeed")


@query("agg1_statistics_by_supplier_year", """
SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS season, round(avg(l_quantity), 6) AS "AvgLapTime", min(l_quantity) AS "BestLapTime",
  round(stddev_samp(l_quantity), 6) AS "LapTimeConsistency", round(avg(sqrt(l_extendedprice)), 6) AS "AvgSpeed", max(sqrt(l_extendedprice)) AS "MaxSpeed",
  count(*) FILTER (WHERE l_returnflag = 'R') AS "PersonalBestCount", count(DISTINCT l_linenumber) AS "PitStopCount", count(*) AS "CompletedLaps"
FROM lineitem GROUP BY ALL""")
def _(t):
    laps = t.lineitem.select(
        "l_suppkey", F.year("l_shipdate").alias("season"), F.col("l_quantity").alias("LapTimeSeconds"),
        F.sqrt("l_extendedprice").alias("SpeedST"), (F.col("l_returnflag") == "R").alias("IsPersonalBest"),
        F.col("l_linenumber").alias("Stint"), F.col("l_orderkey").alias("LapNumber"),
    )
    stats = L.lap_statistics(laps, ("l_suppkey", "season"))
    return rounded(stats, "AvgLapTime", "LapTimeConsistency", "AvgSpeed")


@query("agg2_dense_team_ids", """
SELECT "TeamName", CAST(dense_rank() OVER (ORDER BY "TeamName") AS INTEGER) AS "TeamID" FROM (SELECT DISTINCT p_name AS "TeamName" FROM part)""")
def _(t):
    return dense_ids(t.part.select(F.col("p_name").alias("TeamName")), "TeamName", "TeamID")


@query("agg3_weather_statistics", """
SELECT "Year", "GrandPrix", round(avg("AirTemp"), 6) AS "AvgAirTemp", round(avg("Humidity"), 6) AS "AvgHumidity",
  round(avg("Pressure"), 6) AS "AvgPressure", round(avg("TrackTemp"), 6) AS "AvgTrackTemp", round(avg("WindSpeed"), 6) AS "AvgWindSpeed",
  bool_or(coalesce("Rainfall", FALSE)) AS "HadRainfall" FROM weather GROUP BY "Year", "GrandPrix" """, uses="weather")
def _(t):
    return rounded(L.weather_statistics(t.weather), "AvgAirTemp", "AvgHumidity", "AvgPressure", "AvgTrackTemp", "AvgWindSpeed")


@query("agg4_race_laps", """
SELECT s."Year", s."GrandPrix", s."SessionType", coalesce(max(l."LapNumber"), 50) AS "TotalLaps"
FROM (SELECT DISTINCT "Year", "GrandPrix", "SessionType" FROM laps) s
LEFT JOIN (SELECT * REPLACE (CASE WHEN "GrandPrix" <> 'Grand Prix 3' THEN "LapNumber" END AS "LapNumber") FROM laps) l USING ("Year", "GrandPrix", "SessionType") GROUP BY ALL""", uses="timed laps")
def _(t):
    return race_laps(t.laps, t.laps.withColumn("LapNumber", F.when(F.col("GrandPrix") != "Grand Prix 3", F.col("LapNumber"))))


@query("agg8_driver_list", """
SELECT "Year", "GrandPrix", "SessionType", "Driver", first("DriverNumber") AS "DriverNumber", first("Team") AS "Team",
  CAST(first(user_id % 10) AS INTEGER) AS "TeamID", first("Driver") || ' (' || coalesce(first("Team"), 'Unknown') || ')' AS "DisplayName"
FROM laps GROUP BY "Year", "GrandPrix", "SessionType", "Driver" """, uses="timed laps")
def _(t):
    laps = t.laps.withColumn("TeamID", (F.col("user_id") % 10).cast("int"))
    return L.driver_list(laps, ("Year", "GrandPrix", "SessionType"))


_D1, _D2 = "D7", "D42"


def _sql_verdict(gap: str) -> str:
    shown = f"printf('%d:%.3f', CAST(floor(abs({gap}) / 60) AS BIGINT), abs({gap}) % 60)"
    return f"CASE WHEN {gap} < 0 THEN '{_D1} faster by ' || {shown} WHEN {gap} > 0 THEN '{_D2} faster by ' || {shown} ELSE 'No difference' END"


@query("agg9_two_driver_summary", f"""
SELECT "Year", round(a_min, 6) AS first_min, round(b_min, 6) AS second_min, round(a_max, 6) AS first_max, round(b_max, 6) AS second_max,
  round(a_avg, 6) AS first_avg, round(b_avg, 6) AS second_avg, round(a_min - b_min, 6) AS best_gap, round(a_avg - b_avg, 6) AS avg_gap,
  {_sql_verdict('(a_min - b_min)')} AS best_verdict, {_sql_verdict('(a_avg - b_avg)')} AS avg_verdict FROM (
SELECT "Year", min("LapTimeSeconds") FILTER (WHERE "Driver" = '{_D1}') AS a_min, min("LapTimeSeconds") FILTER (WHERE "Driver" = '{_D2}') AS b_min,
  max("LapTimeSeconds") FILTER (WHERE "Driver" = '{_D1}') AS a_max, max("LapTimeSeconds") FILTER (WHERE "Driver" = '{_D2}') AS b_max,
  avg("LapTimeSeconds") FILTER (WHERE "Driver" = '{_D1}') AS a_avg, avg("LapTimeSeconds") FILTER (WHERE "Driver" = '{_D2}') AS b_avg
FROM timed_laps WHERE "Driver" IN ('{_D1}', '{_D2}') GROUP BY "Year")""", uses="timed laps timed_laps")
def _(t):
    return rounded(
        L.compare_summary(t.timed_laps, _D1, _D2, ["Year"]),
        "first_min", "second_min", "first_max", "second_max", "first_avg", "second_avg", "best_gap", "avg_gap",
    )


@query("agg9_driver_summary", """
SELECT "Driver", min("LapTimeSeconds") AS min_lap, max("LapTimeSeconds") AS max_lap, round(avg("LapTimeSeconds"), 6) AS avg_lap
FROM timed_laps GROUP BY "Driver" """, uses="timed laps timed_laps")
def _(t):
    return rounded(L.driver_summary(t.timed_laps, ["Driver"]), "avg_lap")


@query("agg10_track_bounds", """
SELECT "Driver", round(min("X") - abs(min("X") * 0.1), 6) AS x_min, round(max("X") + abs(max("X") * 0.1), 6) AS x_max,
  round(min("Y") - abs(min("Y") * 0.1), 6) AS y_min, round(max("Y") + abs(max("Y") * 0.1), 6) AS y_max FROM samples GROUP BY "Driver" """,
       uses="timed samples")
def _(t):
    return rounded(L.track_bounds(t.samples, ["Driver"]), "x_min", "x_max", "y_min", "y_max")


@query("agg10_track_bounds_by_minimum", """
SELECT label, round(min(x) - abs(min(x) * 0.1), 6) AS x_min, round(max(x) + abs(min(x) * 0.1), 6) AS x_max,
  round(min(y) - abs(min(y) * 0.1), 6) AS y_min, round(max(y) + abs(min(y) * 0.1), 6) AS y_max
FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) GROUP BY label""")
def _(t):
    points = t.embeddings.select(
        "label", F.get("embedding", F.lit(0)).cast("double").alias("X"), F.get("embedding", F.lit(1)).cast("double").alias("Y")
    )
    return rounded(L.track_bounds(points, ["label"], by_minimum=True), "x_min", "x_max", "y_min", "y_max")


@query("agg12_group_medians", """
SELECT l_suppkey, metric, median(v) AS median FROM (
  SELECT l_suppkey, 'l_quantity' AS metric, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS v FROM lineitem UNION ALL
  SELECT l_suppkey, 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY l_suppkey, metric""")
def _(t):
    holes = t.lineitem.select("l_suppkey", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("l_quantity"), "l_extendedprice")
    return group_medians(holes, ["l_suppkey"], ["l_quantity", "l_extendedprice"])


@query("agg12_sketched_medians", """
SELECT l_suppkey, metric, count(*) AS n, true AS within FROM (
  SELECT l_suppkey, 'l_quantity' AS metric, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS v FROM lineitem UNION ALL
  SELECT l_suppkey, 'l_extendedprice', l_extendedprice FROM lineitem) WHERE v IS NOT NULL GROUP BY l_suppkey, metric""")
def _(t):
    """Medians from the merged sketches of three batches; ``within`` tells whether the rank of each in its exact group is at
    most 3 % off the middle."""
    rows = t.lineitem.select("l_suppkey", "l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("l_quantity"), "l_extendedprice")
    columns = ["l_quantity", "l_extendedprice"]
    batches = [quantile_partials(rows.filter(F.col("l_orderkey") % 3 == b), ["l_suppkey"], columns) for b in range(3)]
    medians = sketched_medians(merged_quantiles(reduce(DataFrame.unionByName, batches), ["l_suppkey"]))
    counted = value_counts(rows, ["l_suppkey"], columns).join(medians, ["l_suppkey", "metric"])
    below, upto = (F.sum(F.when(c, F.col("_n")).otherwise(0)) / F.sum("_n") for c in (F.col("value") < F.col("median"), F.col("value") <= F.col("median")))
    return counted.groupBy("l_suppkey", "metric").agg(F.sum("_n").alias("n"), ((below <= 0.53) & (upto >= 0.47)).alias("within"))


@query("nul2_impute_by_group", """
SELECT event_id, "Team", coalesce("Speed", median("Speed") OVER (PARTITION BY "Team"), (SELECT median("Speed") FROM s), 0) AS "Speed",
  coalesce("DRS", median("DRS") OVER (PARTITION BY "Team"), (SELECT median("DRS") FROM s), 0) AS "DRS" FROM s""".replace("FROM s", """
FROM (SELECT event_id, 'T' || (event_id % 50) AS "Team", CASE WHEN event_id % 50 <> 3 THEN "Speed" END AS "Speed", CAST("DRS" AS DOUBLE) AS "DRS" FROM samples)"""),
       uses="timed samples")
def _(t):
    rows = t.samples.select(
        "event_id", F.concat(F.lit("T"), F.col("event_id") % 50).alias("Team"),
        F.when(F.col("event_id") % 50 != 3, F.col("Speed")).alias("Speed"), F.col("DRS").cast("double").alias("DRS"),
    )
    return impute_by_group(rows, "Team", ["Speed", "DRS"])


@query("agg13_means_by_team_and_grid", """
SELECT "TeamName", "GridPosition", round(avg("Points"), 6) AS "Points", round(avg("Position"), 6) AS "Position" FROM results GROUP BY ALL""", uses="results")
def _(t):
    return rounded(group_means(t.results, ["TeamName", "GridPosition"], ["Points", "Position"]), "Points", "Position")


@query("agg14_overall_condition", """
SELECT "GrandPrix", "TeamName", CASE WHEN bool_or("AvgTrackTemp" > 59) THEN 'Hot and Dry' WHEN bool_or("HadRainfall" = 1) THEN 'Wet and Rainy'
  WHEN bool_or("AvgTrackTemp" < 20) THEN 'Cold and Potentially Slippery' ELSE 'Dry and Moderate' END AS condition
FROM (SELECT * REPLACE (CASE WHEN "AvgTrackTemp" > 40 AND "TeamName" <> 'Team 1' THEN 30 ELSE "AvgTrackTemp" + CASE WHEN "TeamName" = 'Team 1' THEN 30 ELSE 0 END END AS "AvgTrackTemp",
  CASE WHEN "TeamName" IN ('Team 2', 'Team 3') THEN 0 ELSE "HadRainfall" END AS "HadRainfall") FROM predictions) GROUP BY ALL""", uses="predictions")
def _(t):
    team, track = F.col("TeamName"), F.col("AvgTrackTemp")
    shaped = t.predictions.withColumns(
        {
            "AvgTrackTemp": F.when((track > 40) & (team != "Team 1"), 30.0).otherwise(track + F.when(team == "Team 1", 30).otherwise(0)),
            "HadRainfall": F.when(team.isin("Team 2", "Team 3"), 0).otherwise(F.col("HadRainfall")),
        }
    )
    return M.overall_condition(shaped, ["GrandPrix", "TeamName"])


@query("agg16_experiments", """
SELECT experiment, count(*) AS total_runs, to_timestamp(min(start_time) / 1000.0)::TIMESTAMP AS created,
  to_timestamp(max(coalesce(end_time, start_time)) / 1000.0)::TIMESTAMP AS last_modified FROM runs GROUP BY experiment""", uses="runs")
def _(t):
    return U.experiments(t.runs).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created", "last_modified")})


@query("agg17_latest_versions", """
SELECT p_brand AS model, CAST(max(p_size) FILTER (WHERE p_partkey % 6 <> 0) AS INTEGER) AS latest_version FROM part GROUP BY p_brand""")
def _(t):
    version = F.when(F.col("p_partkey") % 6 == 0, "draft").otherwise(F.col("p_size").cast("string"))
    return U.latest_versions(t.part.select(F.col("p_brand").alias("model"), version.alias("version")))


_METRICS = ["r2_score", "rmse", "samples"]


@query("agg18_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(corr({a}, {b}), 6) AS correlation FROM runs" for a in _METRICS for b in _METRICS), uses="runs")
def _(t):
    return rounded(U.correlation_matrix(U.wide_metrics(t.runs, _METRICS), _METRICS), "correlation")


@query("agg19_prediction_quality", """
SELECT "SessionType", round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2_score, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
  round(avg(abs(p - y)), 6) AS mae, round(avg(CAST(abs(p - y) <= 2 AS INTEGER)), 6) AS position_accuracy_within_2,
  round(avg(CAST((y <= 3) = (p <= 3) AS INTEGER)), 6) AS podium_prediction_accuracy
FROM (SELECT "SessionType", "Position" AS y, "GridPosition" / 2 + 3 AS p FROM results WHERE "Position" IS NOT NULL) GROUP BY "SessionType" """, uses="results")
def _(t):
    scored = t.results.dropna(subset=["Position"]).select("SessionType", "Position", (F.col("GridPosition") / 2 + 3).alias("prediction"))
    quality = U.prediction_quality(scored, "Position", group=["SessionType"])
    return rounded(quality, "r2_score", "rmse", "mae", "position_accuracy_within_2", "podium_prediction_accuracy")


@query("mlp11_error_histogram", """
SELECT CAST(least(floor((r - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT l_quantity - l_linenumber * 7.0::DOUBLE AS r, min(l_quantity - l_linenumber * 7.0::DOUBLE) OVER () AS lo, max(l_quantity - l_linenumber * 7.0::DOUBLE) OVER () AS hi FROM lineitem) GROUP BY bin""")
def _(t):
    scored = t.lineitem.select(F.col("l_quantity").alias("prediction"), (F.col("l_linenumber") * 7.0).alias("y"))
    return U.error_histogram(scored, "y")


@query("win3_last_lap_classification", """
SELECT "Year", "GrandPrix", "SessionType", "Driver", arg_max("DriverNumber", "LapNumber") AS "DriverNumber",
  max(struct_pack(l := "LapNumber", p := "Position")).p AS "Position", max(struct_pack(l := "LapNumber", p := "Team")).p AS "Team",
  max(struct_pack(l := "LapNumber", p := "Team")).p AS "TeamName", CAST(1 AS INTEGER) AS "TeamID", 'Finished' AS "Status"
FROM laps WHERE "LapNumber" <> 0 GROUP BY "Year", "GrandPrix", "SessionType", "Driver" """, uses="timed laps")
def _(t):
    from ..operators.results import last_lap_classification

    return last_lap_classification(t.laps.withColumn("TeamID", F.lit(1)), ("Year", "GrandPrix", "SessionType"))


@query("win4_best_row_per_driver", """
SELECT "Driver", first("Position" ORDER BY "Position" ASC NULLS LAST, o_orderkey) AS "Position", first("TeamName" ORDER BY "Position" ASC NULLS LAST, o_orderkey) AS "TeamName",
  first(o_orderkey ORDER BY "Position" ASC NULLS LAST, o_orderkey) AS o_orderkey FROM results GROUP BY "Driver" """, uses="results")
def _(t):
    from ..operators.results import best_row_per_driver, nulls_last

    order = [nulls_last(F.col("Position")), F.col("o_orderkey")]
    return best_row_per_driver(t.results, ["Driver"], order, ["Position", "TeamName", "o_orderkey"])


@query("win5_newest_row_per_driver", """
SELECT "Driver", arg_max("Status", (o_orderdate, o_orderkey)) AS "Status", arg_max("Points", (o_orderdate, o_orderkey)) AS "Points"
FROM results GROUP BY "Driver" """, uses="results")
def _(t):
    from ..operators.lookup import latest

    return latest(t.results, ["Driver"], ["o_orderdate", "o_orderkey"], ["Status", "Points"])


@query("win6_fastest_lap", """
SELECT "Driver", coalesce(arg_min("LapNumber", ("LapTimeSeconds", "LapNumber")) FILTER (WHERE "Deleted" IS DISTINCT FROM TRUE AND "LapTimeSeconds" IS NOT NULL), 1) AS "FastestLap"
FROM timed_laps GROUP BY "Driver" """, uses="timed laps timed_laps")
def _(t):
    return L.fastest_lap(t.timed_laps, ["Driver"])


@query("win11_trace_start", """
SELECT "Driver", arg_min("X", ts) FILTER (WHERE "X" IS NOT NULL AND "Y" IS NOT NULL) AS start_x,
  arg_min("Y", ts) FILTER (WHERE "X" IS NOT NULL AND "Y" IS NOT NULL) AS start_y FROM samples GROUP BY "Driver" """, uses="timed samples")
def _(t):
    return L.trace_start(t.samples, ["Driver"], ["ts"])
