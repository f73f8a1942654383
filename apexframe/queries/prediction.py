"""Prediction: features, next-season rows, model, estimates and result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.ordered import scratch, settle
from ..operators.runs import prediction_quality
from ..plans import prediction as M
from ..schemas import PREDICTION_ROW, conform
from ..sources.readers import decode, expand_predictions, read_predictions
from ..sources.writers import prediction_documents, to_envelope, write_batch, write_csv, write_session_table
from . import bindings as B
from .aggregates import rounded
from .registry import query

# results, laps and weather of 60 drivers, so that names stay a closed list whatever the scale; no lap times in July
_LAP_COLUMNS = """'D' || (l_suppkey % 60) AS "FullName", CAST(year(l_shipdate) AS INTEGER) AS "Year", 'GP ' || month(l_shipdate) AS "GrandPrix" """


def _inputs(t):
    results = t.results.select(
        F.concat(F.lit("D"), F.col("o_custkey") % 60).alias("FullName"),
        F.coalesce("TeamName", F.lit("Unknown")).alias("TeamName"),
        "Year", "GrandPrix", "Position",
        F.when(F.col("o_orderkey") % 9 != 0, F.col("GridPosition")).alias("GridPosition"),
    )
    laps = t.lineitem.select(
        F.concat(F.lit("D"), F.col("l_suppkey") % 60).alias("FullName"),
        F.year("l_shipdate").alias("Year"),
        F.concat(F.lit("GP "), F.month("l_shipdate")).alias("GrandPrix"),
        F.when(F.month("l_shipdate") != 7, F.col("l_quantity")).alias("LapTimeSeconds"),
        F.when(F.col("l_linenumber") != 3, F.sqrt("l_extendedprice")).alias("SpeedST"),
        (F.col("l_returnflag") == "R").alias("IsPersonalBest"),
        F.col("l_linenumber").alias("Stint"),
        F.col("l_orderkey").alias("LapNumber"),
    )
    return results, laps, t.weather


B.SQL["season"] = """SELECT "Driver" AS "FullName", "TeamName", "Year", "GrandPrix", "Position", "GridPosition" - "Position" AS "GridPositionDelta", "GridPosition",
  o_totalprice AS "AvgLapTime", o_totalprice / 2 AS "MaxSpeed" FROM results WHERE "Position" IS NOT NULL AND "TeamName" IS NOT NULL"""
B.SQL["newest"] = """SELECT "FullName", max(struct_pack(y := "Year", "GrandPrix" := "GrandPrix", "Position" := "Position", "GridPositionDelta" := "GridPositionDelta",
  "GridPosition" := "GridPosition", "AvgLapTime" := "AvgLapTime", "MaxSpeed" := "MaxSpeed")) AS r FROM season GROUP BY "FullName" """
_SQL_PENALTY = '(("PredictedPosition" - 1) * 0.3::DOUBLE)'
B.SQL["details"] = f"""SELECT *, lap * "TotalLaps" AS s, first_value(lap * "TotalLaps") OVER (PARTITION BY "Year", "GrandPrix" ORDER BY "PredictedPosition", "FullName") AS lead FROM (
SELECT *, "AvgLap" * (1 + {_SQL_PENALTY} / 100) * CASE WHEN "AvgAirTemp" > 30 THEN 1.02::DOUBLE WHEN "HadRainfall" = 1 THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END * (1 + "TyreFactor" * ({_SQL_PENALTY} / 10)) AS lap,
  round(1 + "TyreFactor" * ({_SQL_PENALTY} / 10), 9) AS tyre FROM (
SELECT *, CASE "GrandPrix" WHEN 'Australian Grand Prix' THEN 58 WHEN 'Monaco Grand Prix' THEN 78 WHEN 'British Grand Prix' THEN 52
  WHEN 'Italian Grand Prix' THEN 53 WHEN 'Singapore Grand Prix' THEN 62 ELSE 58 END::DOUBLE AS "TotalLaps",
 CASE "GrandPrix" WHEN 'Australian Grand Prix' THEN 85 WHEN 'Monaco Grand Prix' THEN 75 WHEN 'British Grand Prix' THEN 87
  WHEN 'Italian Grand Prix' THEN 82 WHEN 'Singapore Grand Prix' THEN 95 ELSE 90 END::DOUBLE AS "AvgLap",
 CASE "GrandPrix" WHEN 'Australian Grand Prix' THEN 0.10 WHEN 'Monaco Grand Prix' THEN 0.05 WHEN 'British Grand Prix' THEN 0.12
  WHEN 'Italian Grand Prix' THEN 0.08 WHEN 'Singapore Grand Prix' THEN 0.15 ELSE 0.10 END::DOUBLE AS "TyreFactor" FROM predictions))"""
_NUMBERS = [c for c in M.NUMERIC if c != "Year"]
B.SQL["joined"] = f"""SELECT r."FullName", r."TeamName", r."Year", r."GrandPrix", r."Position", r."GridPosition", r."GridPosition" - r."Position" AS "GridPositionDelta",
  l.* EXCLUDE ("FullName", "Year", "GrandPrix"), w.* EXCLUDE ("Year", "GrandPrix")
FROM (SELECT 'D' || (o_custkey % 60) AS "FullName", coalesce("TeamName", 'Unknown') AS "TeamName", "Year", "GrandPrix", "Position", CASE WHEN o_orderkey % 9 <> 0 THEN "GridPosition" END AS "GridPosition" FROM results WHERE "Position" IS NOT NULL) r
LEFT JOIN (SELECT {_LAP_COLUMNS}, avg(q) AS "AvgLapTime", min(q) AS "BestLapTime", stddev_samp(q) AS "LapTimeConsistency",
   avg(CASE WHEN l_linenumber <> 3 THEN sqrt(l_extendedprice) END) AS "AvgSpeed", max(CASE WHEN l_linenumber <> 3 THEN sqrt(l_extendedprice) END) AS "MaxSpeed",
   CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS "PersonalBestCount", CAST(count(DISTINCT l_linenumber) AS DOUBLE) AS "PitStopCount", CAST(count(*) AS DOUBLE) AS "CompletedLaps"
   FROM (SELECT *, CASE WHEN month(l_shipdate) <> 7 THEN l_quantity END AS q FROM lineitem) GROUP BY 1, 2, 3) l USING ("FullName", "Year", "GrandPrix")
LEFT JOIN (SELECT "Year", "GrandPrix", avg("AirTemp") AS "AvgAirTemp", avg("Humidity") AS "AvgHumidity", avg("TrackTemp") AS "AvgTrackTemp", avg("WindSpeed") AS "AvgWindSpeed",
   CAST(CAST(bool_or(coalesce("Rainfall", FALSE)) AS INTEGER) AS DOUBLE) AS "HadRainfall" FROM weather GROUP BY ALL) w USING ("Year", "GrandPrix")"""


@query("mlp1_feature_table", f"""
SELECT "FullName", "TeamName", "Year", "GrandPrix", "Position", """ + ", ".join(
    f'round(coalesce("{c}", median("{c}") OVER (PARTITION BY "TeamName"), (SELECT median("{c}") FROM joined), 0), 6) AS "{c}"' for c in _NUMBERS
) + " FROM joined", uses="results weather joined")
def _(t):
    return rounded(M.feature_table(*_inputs(t)), *_NUMBERS)


_SETTINGS = M.ModelSettings()


def _fit(t):
    features = settle(M.feature_table(*_inputs(t)))
    return features, M.fit(features, _SETTINGS, key=("FullName", "Year", "GrandPrix", "Position", "GridPosition"))


@query("mlp2_fit_and_evaluate")
def _(t):
    """Fitted on the training share and evaluated on the rest; the difference to the grid is no feature, it holds the label."""
    return _fit(t)[1][2]


@query("mlp2_category_index", """
SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) - 1 AS INTEGER) AS "index" FROM (
  SELECT 'FullName' AS "column", "FullName" AS value, count(*) AS n FROM joined GROUP BY 2 UNION ALL SELECT 'TeamName', "TeamName", count(*) FROM joined GROUP BY 2
  UNION ALL SELECT 'GrandPrix', "GrandPrix", count(*) FROM joined GROUP BY 2)""", uses="results weather joined")
def _(t):
    return M.category_index(M.feature_table(*_inputs(t)), _SETTINGS)


@query("mlp3_scaled_numbers", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', 0.0::DOUBLE, TRUE)" for c in M.MODEL_NUMERIC) + ') v("column", mean, one)')
def _(t):
    """Mean 0 and deviation 1 for every column, or 0 for one that is the same in all rows."""
    scaled = M.scaled_numbers(M.feature_table(*_inputs(t)), _SETTINGS)
    deviation = F.round("deviation", 6)
    return scaled.select("column", (F.round("mean", 6) + 0.0).alias("mean"), ((deviation == 1.0) | (deviation == 0.0)).alias("one"))


@query("mlp4_holdout", """SELECT count(*) AS rows, TRUE AS close, TRUE AS better, TRUE AS shares FROM results WHERE "Position" IS NOT NULL""", uses="results")
def _(t):
    """About a fifth of the rows is held out; on it, the error is below that of a model that always says the mean of all, and
    the shares are shares. The label of this input follows the grid, so that there is something to learn."""
    key = ("FullName", "Year", "GrandPrix", "Position", "GridPosition")
    features = M.feature_table(*_inputs(t))
    learnable = F.coalesce(F.col("GridPosition") * 0.8 + F.pmod(F.xxhash64(*key), F.lit(3)), F.col("Position"))
    features = settle(features.withColumn("Position", learnable.cast("double")))
    _, scored, quality = M.fit(features, _SETTINGS, key=key)
    held = scored.agg(F.count(F.lit(1)).alias("held"), F.stddev_pop("Position").alias("deviation"))
    counted = features.agg(F.count(F.lit(1)).alias("rows")).withColumn("held", held.select(F.struct("*")).scalar())
    measured = counted.withColumn("q", quality.select(F.struct("*")).scalar())
    share = lambda c: F.col(f"q.{c}").between(0, 1)
    return measured.select(
        "rows", F.col("held.held").between(F.col("rows") * 0.15, F.col("rows") * 0.25).alias("close"), (F.col("q.rmse") < F.col("held.deviation")).alias("better"),
        (share("position_accuracy_within_2") & share("podium_prediction_accuracy") & (F.col("q.mae") <= F.col("q.rmse"))).alias("shares"),
    )


@query("mlp5_split_sizes", """SELECT count(*) AS rows, 0 AS shared, TRUE AS near_share FROM orders""")
def _(t):
    """Train and test share no row, lose none, and are four fifths and one."""
    rows = t.orders.select("o_orderkey", "o_custkey")
    train, test = M.split(rows, M.ModelSettings(), ["o_orderkey"])
    return train.withColumn("part", F.lit(1)).unionByName(test.withColumn("part", F.lit(2))).groupBy("o_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("part").alias("part")
    ).agg(
        F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).cast("int").alias("shared"),
        F.avg((F.col("part") == 1).cast("int")).between(0.76, 0.84).alias("near_share"),
    )


_DRIVERS = {"Team 1": ["D1", "X1"], "Team 2": ["X2", "X3"], "Team 99": ["X4", "X5"], "Team 3": ["D13", "D23"]}
_RACE = "Monaco Grand Prix"


@query("mlp7_predict_race")
def _(t):
    features, (model, _, _) = _fit(t)
    return M.predict(model, M.next_season_rows(features, _DRIVERS, race=_RACE))


def _leaders():
    """Leaders that the gaps are counted from; rows as fast as the leader are shown as leaders, too."""
    return F.countDistinct(F.round(F.col("RaceTimeSeconds") - F.col("GapToLeader"), 6))


def _race_checks(predicted):
    """One race, one leader, and every shown column as it follows from the predicted place."""
    predicted = settle(predicted)
    penalty = (F.col("PredictedPosition") - 1) * 0.3
    weather = F.when(F.col("AvgAirTemp") > 30, 1.02).when(F.col("HadRainfall") == 1, 1.08).otherwise(1.0)
    lap = 75.0 * (1 + penalty / 100) * weather * (1 + 0.05 * penalty / 10)
    first = predicted.agg(F.min_by("RaceTimeSeconds", F.struct("PredictedPosition", "FullName"))).scalar()
    near = lambda a, b: F.abs(F.col(a) - b) < 1e-6
    right = near("EstimatedLapTime", lap) & near("RaceTimeSeconds", lap * 78) & near("GapToLeader", F.col("RaceTimeSeconds") - first) & near("PositionChange", F.col("GridPosition") - F.col("PredictedPosition"))
    return predicted.withColumn("right", right & (F.col("PredictedPosition") == F.bround("PredictedPosition", 1))).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("GrandPrix").alias("races"), F.min("GrandPrix").alias("race"),
        _leaders().alias("leaders"), F.bool_and("right").alias("right"),
    )


@query("mlp7_one_race_one_leader", f"""SELECT 8 AS rows, 1 AS races, '{_RACE}' AS race, 1 AS leaders, TRUE AS "right" """)
def _(t):
    features, (model, _, _) = _fit(t)
    return _race_checks(M.predict(model, M.next_season_rows(features, _DRIVERS, race=_RACE)))


def _run(t, race):
    results, laps, weather = _inputs(t)
    tables = {
        "results": results.withColumns({"Driver": F.col("FullName"), "SessionType": F.lit("Race")}).drop("FullName"),
        "laps": laps.withColumns({"Driver": F.col("FullName"), "Team": F.lit("Works"), "SessionType": F.lit("Race")}).drop("FullName"),
        "weather": weather.withColumn("SessionType", F.lit("Race")),
    }
    schedule = t.results.select("Year", F.col("GrandPrix").alias("EventName"), F.col("o_orderkey").alias("RoundNumber"))
    return M.run(tables, schedule, race, [1996, 1997, 1998, 1999], _SETTINGS, _DRIVERS)[0]


@query("mlp8_prediction_run")
def _(t):
    """From the tables of several seasons to the predicted order of one race."""
    return _run(t, "GP 1")


@query("mlp8_one_race_one_leader", """SELECT 8 AS rows, 1 AS races, 'GP 1' AS race, 1 AS leaders""")
def _(t):
    predicted = settle(_run(t, "GP 1"))
    return predicted.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("GrandPrix", "Year").alias("races"), F.min("GrandPrix").alias("race"),
        _leaders().alias("leaders"),
    )


_LINEUP = {"Team 1": ["D1", "X1"], "Team 2": ["X2", "X3"], "Haas": ["X4", "X5"], "Team 3": ["D13", "D23"]}


def _season_features(t):
    price = F.col("o_totalprice")
    return t.results.filter("Position IS NOT NULL AND TeamName IS NOT NULL").select(
        F.col("Driver").alias("FullName"), "TeamName", "Year", "GrandPrix", "Position",
        (F.col("GridPosition") - F.col("Position")).alias("GridPositionDelta"), "GridPosition",
        price.alias("AvgLapTime"), (price / 2).alias("MaxSpeed"),
    )


_FIVE = ["Position", "GridPositionDelta", "GridPosition", "AvgLapTime", "MaxSpeed"]


def _sql_signed() -> str:
    rows = [(d, team, next(m for m in ds if m != d), 9.0 if team == "Haas" else 10.0) for team, ds in _LINEUP.items() for d in ds]
    return "(SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{team}', '{m}', {b}::DOUBLE)" for d, team, m, b in rows) + ') v("FullName", "TeamName", mate, baseline))'


def _sql_tier(c: str) -> str:
    slower = {"AvgLapTime": 1.01, "MaxSpeed": 0.99}.get(c, 1.0)
    assumed = {"GridPosition": "s.baseline", "GridPositionDelta": "0"}.get(c, f'(SELECT avg("{c}") FROM season WHERE "GridPosition" = s.baseline)')
    return (
        f'round(CASE WHEN o.r IS NOT NULL THEN o.r."{c}" WHEN m.r IS NOT NULL THEN m.r."{c}" * {slower}::DOUBLE WHEN t."TeamName" IS NOT NULL THEN t."{c}" '
        f'ELSE {assumed} END, 4) AS "{c}"'
    )


@query("mlp6_next_season_rows", f"""
SELECT s."FullName", s."TeamName", CAST(2026 AS INTEGER) AS "Year", CASE WHEN o.r IS NOT NULL THEN o.r."GrandPrix" WHEN m.r IS NOT NULL THEN m.r."GrandPrix" ELSE (SELECT min("GrandPrix") FROM season) END AS "GrandPrix",
  {", ".join(_sql_tier(c) for c in _FIVE)},
  CAST(CASE WHEN o.r IS NOT NULL THEN 1 WHEN m.r IS NOT NULL THEN 2 WHEN t."TeamName" IS NOT NULL THEN 3 ELSE 4 END AS INTEGER) AS source_tier
FROM {_sql_signed()} s LEFT JOIN newest o ON o."FullName" = s."FullName" LEFT JOIN newest m ON m."FullName" = s.mate
LEFT JOIN (SELECT "TeamName", {", ".join(f'avg("{c}") AS "{c}"' for c in _FIVE)} FROM season GROUP BY "TeamName") t ON t."TeamName" = s."TeamName" """,
       uses="results season newest")
def _(t):
    rows = M.next_season_rows(_season_features(t), _LINEUP)
    return rounded(rows, *_FIVE, digits=4)


@query("mlp9_run_record", """
SELECT 'run-1' AS run_id, 'Test_Grand_Prix' AS run_name, '20' AS max_iter, round(avg(abs("GridPosition" - "Position")), 6) AS mae FROM results WHERE "Position" IS NOT NULL""", uses="results")
def _(t):
    scored = t.results.dropna(subset=["Position"]).withColumn("prediction", F.col("GridPosition"))
    run = M.run_record("run-1", "Test Grand Prix", prediction_quality(scored, "Position"), M.ModelSettings(), 0, 60000)
    return run.select(
        "run_id", "run_name", F.try_element_at("params", F.lit("max_iter")).alias("max_iter"),
        F.round(F.try_element_at("metrics", F.lit("mae")), 6).alias("mae"),
    )


def _details(t):
    return M.race_details(
        t.predictions.withColumns({"WeatherImpact": F.lit(1.0), "PositionChange": F.col("GridPosition") - F.col("PredictedPosition")})
    )


@query("fn15_race_details", """SELECT "FullName", round(lap, 6) AS "EstimatedLapTime", round(s, 4) AS "RaceTimeSeconds", tyre AS "TireDegradation", "TotalLaps", round(s - lead, 4) AS "GapToLeader" FROM details""",
       uses="predictions details")
def _(t):
    out = rounded(_details(t), "EstimatedLapTime")
    return rounded(out, "RaceTimeSeconds", "GapToLeader", digits=4).select(
        "FullName", "EstimatedLapTime", "RaceTimeSeconds", F.round("TireDegradation", 9).alias("TireDegradation"), "TotalLaps", "GapToLeader"
    )


@query("fn16_tyre_impact", """
SELECT "Year", "GrandPrix", "FullName" AS "Driver", "TeamName" AS "Team", round(tyre, 3) AS "DegFactor", round((tyre - 1) * min(lap) OVER (PARTITION BY "Year", "GrandPrix"), 3) AS "LapTimeImpact" FROM details""",
       uses="predictions details")
def _(t):
    return M.tyre_table(_details(t).withColumn("TireDegradation", F.round("TireDegradation", 9)))


@query("prediction_results_table", """
SELECT "Year", "GrandPrix", row_number() OVER (PARTITION BY "Year", "GrandPrix" ORDER BY round_even("PredictedPosition", 0), "PredictedPosition", "FullName") AS "Position",
  "FullName" AS "Driver", "TeamName" AS "Team", printf('%.3fs', s) AS "RaceTime" FROM details""", uses="predictions details")
def _(t):
    return M.results_table(_details(t))


@query("prediction_weather_table", """
SELECT "FullName" AS "Driver", 1.0::DOUBLE AS "ImpactFactor", round_even("AvgAirTemp", 1) AS "AirTemp", round_even("AvgTrackTemp", 1) AS "TrackTemp", round_even("AvgHumidity", 1) AS "Humidity" FROM predictions""",
       uses="predictions")
def _(t):
    return M.weather_table(t.predictions.withColumn("WeatherImpact", F.lit(1.0)))


@query("prediction_lap_chart", """
SELECT "Driver", "LapNumber", total AS "CumulativeTime", row_number() OVER (PARTITION BY "Year", "GrandPrix", "LapNumber" ORDER BY total, "Driver") AS "RunningPosition" FROM (
SELECT "Year", "GrandPrix", "Driver", "LapNumber", CAST(sum(CAST(round(t * 1e6) AS BIGINT)) OVER (PARTITION BY "Year", "GrandPrix", "Driver" ORDER BY "LapNumber") AS BIGINT) / 1e6::DOUBLE AS total FROM (
SELECT "Year", "GrandPrix", "FullName" AS "Driver", CAST(n AS INTEGER) AS "LapNumber", round("PredictedPosition" + 80, 3) * (1 + 0.01::DOUBLE * least(1, n / (5.0::DOUBLE * 0.7::DOUBLE))) AS t FROM predictions, range(1, 6) r(n)))""", uses="predictions")
def _(t):
    """Five laps; the degradation factor is the same for all."""
    p = t.predictions.withColumns({"EstimatedLapTime": F.round(F.col("PredictedPosition") + 80, 3), "TireDegradation": F.lit(1.01)})
    return M.lap_chart(p, 5).select("Driver", "LapNumber", "CumulativeTime", "RunningPosition")


# --- files written and read back ------------------------------------------------------------------------


def _folder(t) -> str:
    return f"{scratch(t.spark)}/apexframe-{uuid.uuid4().hex}"


@query("snk1_json_envelope", """SELECT event_id, user_id, event_type, value FROM events""")
def _(t):
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    return decode(to_envelope(rows), rows.schema).drop("_corrupt_record")


@query("snk2_idempotent_batches", """SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders""")
def _(t):
    """Three batches, one of them written twice."""
    path = _folder(t)
    for batch in (0, 1, 2, 1):
        write_batch(t.orders.filter(F.col("o_orderkey") % 3 == batch), batch, path)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total"))


@query("snk3_csv", """SELECT "FullName", "TeamName", "PredictedPosition" FROM predictions""", uses="predictions")
def _(t):
    path = _folder(t)
    rows = t.predictions.select("FullName", "TeamName", "PredictedPosition")
    write_csv(rows, path)
    return t.spark.read.schema(rows.schema).option("header", True).csv(path)


@query("snk4_prediction_documents", """SELECT "GrandPrix" AS race, "FullName", "PredictedPosition", "Year" FROM predictions""", uses="predictions")
def _(t):
    """Documents of a few rows each, opened up again; a place that many rows share has several parts."""
    documents = prediction_documents(t.predictions, "20260101_000000", per_document=5)
    return documents.select("race", F.inline("predictions")).select("race", "FullName", "PredictedPosition", "Year")


@query("src7_saved_predictions", """SELECT "GrandPrix" AS race, '20260101_000000' AS timestamp, "FullName", "PredictedPosition", "HadRainfall" FROM predictions""", uses="predictions")
def _(t):
    path = _folder(t)
    prediction_documents(conform(t.predictions, PREDICTION_ROW), "20260101_000000").write.json(path)
    opened = expand_predictions(read_predictions(t.spark, path))
    return opened.select("race", "timestamp", "FullName", "PredictedPosition", "HadRainfall")


@query("snk5_session_table", """SELECT o_orderkey, "Driver" FROM results WHERE "Year" = 1998 AND "GrandPrix" = 'GP 2' """, uses="results")
def _(t):
    """Laid out by session; the filter reads the folders of one session only."""
    path = _folder(t)
    write_session_table(t.results, path, sort=("Driver", "o_orderkey"))
    return t.spark.read.parquet(path).filter("Year = 1998 AND GrandPrix = 'GP 2'").select("o_orderkey", "Driver")


@query("snk5_lookup_by_driver", """SELECT event_id, "LapNumber" FROM laps WHERE "Driver" = 'D7' """, uses="timed laps")
def _(t):
    """Sessions clustered by driver, lap and time with Bloom filters; a driver is looked up over all sessions."""
    path = _folder(t)
    write_session_table(t.laps, path, cluster=("Driver", "LapNumber", "Time"), bloom={"Driver": 1000}, row_group_bytes=1 << 20)
    return t.spark.read.parquet(path).filter("Driver = 'D7'").select("event_id", "LapNumber")
