"""Features, next-season rows, model and estimates on small tables."""

import pytest
from pyspark.sql import functions as F

from apexframe.operators.runs import error_histogram, prediction_quality
from apexframe.plans import prediction as M
from apexframe.schemas import FEATURES


@pytest.fixture(scope="module")
def features(spark):
    rows = []
    for year in (2023, 2024, 2025):
        for i in range(20):
            driver, team = f"Driver {i}", f"Team {i // 2}"
            rows.append((driver, team, year, "Monaco Grand Prix", float(i + 1), float(i + 1 + (i + year) % 3), 0.0, 75.0 + i, 74.0 + i, 0.5, 200.0 - i, 300.0 - i, 3, 2, 78, 22.0, 50.0, 35.0, 5.0, 0))
    return spark.createDataFrame(rows, FEATURES)


def test_model_finds_the_order(features):
    model, scored, quality = M.fit(features, M.ModelSettings())
    row = quality.first()
    assert row.r2_score > 0.7 and 0 <= row.position_accuracy_within_2 <= 1
    again = M.fit(features.repartition(7), M.ModelSettings())[1]
    assert {(r.FullName, r.Year) for r in again.collect()} == {(r.FullName, r.Year) for r in scored.collect()}
    lineup = {"Team 0": ["Driver 0", "Rookie"], "Team 5": ["New A", "New B"]}
    predicted = M.predict(model, M.next_season_rows(features, lineup)).collect()
    assert len(predicted) == 4 and predicted[0].FullName == "Driver 0" and predicted[0].Gap == "Leader"
    assert predicted[0].TotalLaps == 78.0


def test_one_race_has_one_leader(spark, features):
    """Drivers whose last events differ are all predicted for the race that is asked for."""
    other = features.filter("FullName = 'Driver 3'").withColumns({"GrandPrix": F.lit("Other Grand Prix"), "Year": F.lit(2026)})
    history = features.unionByName(other.limit(1))
    model = M.fit(history, M.ModelSettings())[0]
    lineup = {"Team 0": ["Driver 0", "Rookie"], "Team 1": ["Driver 3", "New"], "Haas": ["New C", "New D"]}
    rows = M.next_season_rows(history, lineup, race="British Grand Prix")
    assert {r.GrandPrix for r in M.next_season_rows(history, lineup).collect()} > {"Other Grand Prix"}
    predicted = M.predict(model, rows).collect()
    assert len(predicted) == 6 and {r.GrandPrix for r in predicted} == {"British Grand Prix"}
    assert [r.Gap for r in predicted].count("Leader") == 1 and predicted[0].Gap == "Leader" and predicted[0].TotalLaps == 52.0


def test_r2_of_a_constant_label_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "y DOUBLE, prediction DOUBLE")
    assert prediction_quality(df, "y").first().r2_score is None


def test_next_season_tiers(features):
    lineup = {"Team 0": ["Driver 0", "Rookie"], "Team 5": ["New A", "New B"], "Haas": ["New C", "New D"]}
    got = {r.FullName: r for r in M.next_season_rows(features, lineup).collect()}
    assert {n: r.source_tier for n, r in got.items()} == {"Driver 0": 1, "Rookie": 2, "New A": 3, "New B": 3, "New C": 4, "New D": 4}
    assert got["Driver 0"].Year == 2026 and got["Driver 0"].AvgLapTime == 75.0
    assert got["Rookie"].AvgLapTime == pytest.approx(75.75) and got["Rookie"].MaxSpeed == pytest.approx(297.0)
    assert got["New A"].AvgLapTime == pytest.approx(85.5)
    assert (got["New C"].GridPosition, got["New C"].GridPositionDelta) == (9.0, 0.0)


def test_race_estimate(spark):
    df = spark.createDataFrame(
        [("A", "Monaco Grand Prix", 1.0, 35.0, 0), ("B", "Monaco Grand Prix", 3.0, 20.0, 1)],
        "FullName STRING, GrandPrix STRING, PredictedPosition DOUBLE, AvgAirTemp DOUBLE, HadRainfall INT",
    )
    got = {r.FullName: r for r in M.race_details(df).collect()}
    assert got["A"].EstimatedLapTime == pytest.approx(75.0 * 1.02)
    assert got["B"].EstimatedLapTime == pytest.approx(75.0 * 1.006 * 1.08 * (1 + 0.05 * 0.06))
    assert got["A"].EstimatedRaceTime == "1:39:27.000" and got["A"].Gap == "Leader"
    assert got["B"].GapToLeader == pytest.approx((got["B"].EstimatedLapTime - 76.5) * 78)


def test_quality_and_histogram(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (5.0, 9.0)], "y DOUBLE, prediction DOUBLE")
    row = prediction_quality(df, "y").first()
    assert row.mae == pytest.approx(5 / 3) and row.position_accuracy_within_2 == pytest.approx(2 / 3) and row.podium_prediction_accuracy == 1.0
    bins = {r.bin: r.n for r in error_histogram(df, "y", bins=4).collect()}
    assert bins == {0: 1, 1: 1, 3: 1}
    flat = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "y DOUBLE, prediction DOUBLE")
    assert {r.bin: r.n for r in error_histogram(flat, "y", bins=20).collect()} == {10: 2}


def test_prediction_documents_have_one_shape(spark):
    from apexframe.sources.writers import prediction_documents

    for n in (3, 2500):
        df = spark.range(n).select(F.lit("X").alias("GrandPrix"), F.floor(F.col("id") / 2).cast("double").alias("PredictedPosition"), "id")
        documents = prediction_documents(df, "t").orderBy("place").collect()
        assert documents[0].asDict().keys() == {"race", "timestamp", "place", "predictions"}
        assert [p.id for d in documents for p in d.predictions] == list(range(n))


def test_training_rows_are_dealt_out_however_few_files_hold_them(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_TASK", 20)
    kept = []

    class Kept(M.Pipeline):
        def fit(self, rows):
            kept.append(rows.rdd.glom().map(len).collect())
            raise StopIteration

    monkeypatch.setattr(M, "Pipeline", Kept)
    with pytest.raises(StopIteration):
        M.fit(spark.range(1000).coalesce(1).withColumn("Position", F.lit(1.0)), key=["id"])
    assert len(kept[0]) >= 35 and max(kept[0]) <= 30


def test_documents_of_one_time_are_sorted_by_many_tasks(spark, tmp_path):
    from apexframe.schemas import PREDICTION_ROW, conform
    from apexframe.sources.readers import read_predictions
    from apexframe.sources.writers import prediction_documents

    rows = spark.range(2000).select(F.concat(F.lit("D"), "id").alias("FullName"), F.lit("Race").alias("GrandPrix"), (F.col("id") / 7).alias("PredictedPosition"))
    prediction_documents(conform(rows, PREDICTION_ROW), "20260101_000000").write.json(str(tmp_path / "json"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = read_predictions(spark, str(tmp_path / "json")).rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == 2000 and max(sizes) < 1200
