"""Finishing-order prediction: features, next-season rows, model, scoring, display (MLP1-MLP9, PIPE12, PIPE13)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import records as R
from ..functions.durations import duration_seconds, format_clock, to_double
from ..functions.names import normalize_driver, normalize_team, safe_name
from ..operators.laps import lap_statistics, weather_statistics
from ..operators.lookup import race_parameters
from ..operators.ordered import impute_by_group, running_order, settle, tyre_ramp
from ..operators.results import gap_to_leader, group_means, sequential_places
from ..operators.runs import prediction_quality
from ..sources.readers import seasons_of_event

CATEGORICAL = ("FullName", "TeamName", "GrandPrix")
LAP_FEATURES = (
    "AvgLapTime", "BestLapTime", "LapTimeConsistency", "AvgSpeed", "MaxSpeed", "PersonalBestCount",
    "PitStopCount", "CompletedLaps",
)
WEATHER_FEATURES = ("AvgAirTemp", "AvgHumidity", "AvgTrackTemp", "AvgWindSpeed", "HadRainfall")
NUMERIC = ("Year", "GridPosition", "GridPositionDelta", *LAP_FEATURES, *WEATHER_FEATURES)
#: numbers the model sees by default; the difference of grid and finish holds the label
MODEL_NUMERIC = tuple(c for c in NUMERIC if c != "GridPositionDelta")


def standard_names(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Standard driver and team names on laps and results (second half of SRC6)."""
    laps = tables["laps"].withColumns(
        {"FullName": normalize_driver(F.col("Driver")), "TeamName": normalize_team(F.col("Team"))}
    )
    results = tables["results"].withColumns(
        {"FullName": normalize_driver(F.col("Driver")), "TeamName": normalize_team(F.col("TeamName"))}
    )
    return {**tables, "laps": laps, "results": results}


def with_lap_statistics(results: DataFrame, laps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results with the statistics of the laps of the same keys, which stay null without laps (JOIN7)."""
    return results.join(lap_statistics(laps, keys), list(keys), "left")


def feature_table(results: DataFrame, laps: DataFrame, weather: DataFrame) -> DataFrame:
    """One training row per result: result, lap statistics, race weather, missing values imputed (MLP1)."""
    if "LapTimeSeconds" not in laps.columns:
        laps = laps.withColumn("LapTimeSeconds", duration_seconds(F.col("LapTime")))
    race = ["Year", "GrandPrix"]
    joined = (
        with_lap_statistics(results.withColumn("Position", to_double(F.col("Position"))), laps, ["FullName", *race])
        .join(weather_statistics(weather), race, "left")
        .withColumns(
            {
                "GridPositionDelta": F.col("GridPosition") - F.col("Position"),
                "HadRainfall": F.col("HadRainfall").cast("int"),
            }
        )
        .dropna(subset=["Position"])
    )
    chosen = joined.select(
        "FullName", "TeamName", "Year", "GrandPrix", "Position",
        *[F.col(c).cast("double").alias(c) for c in NUMERIC if c != "Year"],
    )
    return impute_by_group(settle(chosen), "TeamName", [c for c in NUMERIC if c != "Year"])


#: training rows that a task keeps in memory, on average, at most; fixed value
ROWS_PER_TASK = 100_000


@dataclass(frozen=True)
class ModelSettings:
    max_iter: int = 20
    max_depth: int = 2
    step_size: float = 0.1
    seed: int = 42
    train_share: float = 0.8
    label: str = "Position"
    numeric: tuple[str, ...] = MODEL_NUMERIC
    categorical: tuple[str, ...] = CATEGORICAL


def stages(settings: ModelSettings) -> list:
    """Index, encode, scale and assemble the features, then boosted trees (MLP2-MLP4)."""
    indexers = [
        StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="frequencyDesc")
        for c in settings.categorical
    ]
    encoders = [OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_vec") for c in settings.categorical]
    numbers = VectorAssembler(inputCols=list(settings.numeric), outputCol="numeric_features", handleInvalid="keep")
    scaler = StandardScaler(
        inputCol="numeric_features", outputCol="scaled_numeric_features", withMean=True, withStd=True
    )
    together = VectorAssembler(
        inputCols=[*[f"{c}_vec" for c in settings.categorical], "scaled_numeric_features"],
        outputCol="features",
        handleInvalid="keep",
    )
    trees = GBTRegressor(
        featuresCol="features",
        labelCol=settings.label,
        maxIter=settings.max_iter,
        maxDepth=settings.max_depth,
        stepSize=settings.step_size,
        seed=settings.seed,
    )
    return [*indexers, *encoders, numbers, scaler, together, trees]


def category_index(features: DataFrame, settings: ModelSettings) -> DataFrame:
    """``column, value, index`` of the categorical features: the more frequent, the smaller, ties by name (MLP2)."""
    fitted = Pipeline(stages=stages(settings)[: len(settings.categorical)]).fit(features)
    rows = [(c, v, i) for c, m in zip(settings.categorical, fitted.stages) for i, v in enumerate(m.labels)]
    return features.sparkSession.createDataFrame(rows, "column STRING, value STRING, index INT")


def scaled_numbers(features: DataFrame, settings: ModelSettings) -> DataFrame:
    """``column, mean, deviation`` of the numeric features after scaling (MLP3)."""
    n = len(settings.categorical)
    scaled = Pipeline(stages=stages(settings)[2 * n : 2 * n + 2]).fit(features).transform(features)
    values = vector_to_array("scaled_numeric_features")
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.element_at(values, i).alias("v")) for i, c in enumerate(settings.numeric, 1)))
    return scaled.select(F.inline(each)).groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("deviation"))


def split(features: DataFrame, settings: ModelSettings, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Train / test by a hash of the row key: the same rows whatever the partitioning (MLP5)."""
    share = F.pmod(F.xxhash64(*key, F.lit(settings.seed)), F.lit(10000)) / 10000
    return features.filter(share < settings.train_share), features.filter(share >= settings.train_share)


def fit(features: DataFrame, settings: ModelSettings | None = None, key: Sequence[str] = ("FullName", "Year", "GrandPrix")):
    """Fitted model, scored test rows and their quality (MLP2-MLP5, AGG19)."""
    settings = settings or ModelSettings()
    train, test = split(features, settings, key)
    # a stored table may be few files of many rows, while the trees keep a row as a kilobyte or so
    rows = train.count()
    if rows > ROWS_PER_TASK * train.rdd.getNumPartitions():
        train = train.repartition(-(-rows // ROWS_PER_TASK))
    model = Pipeline(stages=stages(settings)).fit(train)
    scored = model.transform(test)
    return model, scored, prediction_quality(scored, settings.label)


def run_record(run_id: str, race: str, quality: DataFrame, settings: ModelSettings, start_ms: int, end_ms: int) -> DataFrame:
    """A run row with what was actually used and measured (MLP9)."""
    params = {
        "max_iter": settings.max_iter, "max_depth": settings.max_depth, "step_size": settings.step_size,
        "algorithm": "Gradient Boosting Trees", "categorical_features": len(settings.categorical),
        "numeric_features": len(settings.numeric),
    }
    metrics = [x for c in quality.columns for x in (F.lit(c), F.col(c))]
    return quality.select(
        F.lit(run_id).alias("run_id"),
        safe_name(F.lit(race)).alias("run_name"),
        F.lit("Race Prediction").alias("experiment"),
        F.lit(race).alias("race_name"),
        F.lit("FINISHED").alias("status"),
        F.lit(start_ms).cast("long").alias("start_time"),
        F.lit(end_ms).cast("long").alias("end_time"),
        F.create_map(*[F.lit(str(x)) for pair in params.items() for x in pair]).alias("params"),
        F.create_map(*metrics).alias("metrics"),
        F.create_map(F.lit("race_name"), F.lit(race)).alias("tags"),
    )


def next_season_rows(
    features: DataFrame,
    lineup: Mapping[str, Sequence[str]] | None = None,
    season: int = K.NEXT_SEASON,
    baseline: Mapping[str, float] | None = None,
    race: str | None = None,
) -> DataFrame:
    """One row per signed driver for the coming season (MLP6).

    Tier 1 the driver's newest row; 2 the team-mate's, lap times x1.01 and top speed x0.99; 3 the team's
    means; 4 the means at the grid place nearest to the team's assumed one. ``source_tier`` tells which.
    Every tier is an aggregate of the history joined to the line-up.
    """
    lineup, baseline = lineup or K.LINEUP, K.BASELINE_POSITIONS if baseline is None else baseline
    numbers = [c for c in features.columns if c not in (*CATEGORICAL, "Year")]
    spark = features.sparkSession
    signed = spark.createDataFrame(
        [
            (driver, team, place, float(baseline.get(team, K.DEFAULT_BASELINE_POSITION)), mate)
            for team, drivers in lineup.items()
            for place, driver in enumerate(drivers)
            for mate in ([d for d in drivers if d != driver] or [None])
        ],
        "FullName STRING, TeamName STRING, seat INT, baseline DOUBLE, mate STRING",
    )
    # only drivers in the line-up can be looked up, so the history is reduced to them first
    newest = (
        features.groupBy("FullName")
        .agg(F.max(F.struct("Year", "GrandPrix", *numbers)).alias("_r"))
        .select("FullName", F.struct(F.col("_r.GrandPrix").alias("GrandPrix"), *[F.col("_r")[c].cast("double").alias(c) for c in numbers]).alias("_row"))
    )
    slower = {
        "AvgLapTime": K.ROOKIE_LAP_FACTOR, "BestLapTime": K.ROOKIE_LAP_FACTOR, "MaxSpeed": K.ROOKIE_SPEED_FACTOR,
    }
    first_race = F.lit(race) if race else features.agg(F.min("GrandPrix").alias("g")).scalar()

    def as_row(prefix: Column, adjust: Mapping[str, float] | None = None, event: Column | None = None) -> Column:
        values = [(prefix[c] * (adjust or {}).get(c, 1.0)).alias(c) for c in numbers]
        return F.struct((prefix["GrandPrix"] if event is None else event).alias("GrandPrix"), *values)

    own = newest.select("FullName", F.col("_row").alias("_own"))
    mates = newest.select(F.col("FullName").alias("mate"), F.col("_row").alias("_mate"))
    teams = group_means(features, ["TeamName"], numbers).select("TeamName", F.struct(*numbers).alias("_team"))
    by_grid = group_means(features.withColumn("_grid", F.col("GridPosition")), ["_grid"], numbers)
    places = signed.select("baseline").distinct()
    # the nearest grid place at or below and at or above each assumed place, found by two as-of scans
    nearest = _nearest(places, by_grid.filter(F.col("_grid").isNotNull()), numbers)
    joined = (
        signed.join(own, "FullName", "left")
        .join(mates, "mate", "left")
        .groupBy("FullName", "TeamName", "baseline")
        .agg(F.max("_own").alias("_own"), F.max("_mate").alias("_mate"))
        .join(teams, "TeamName", "left")
        .join(nearest, "baseline", "left")
    )
    assumed = F.struct(
        first_race.alias("GrandPrix"),
        *[
            (F.col("baseline") if c == "GridPosition" else F.lit(0.0) if c == "GridPositionDelta" else F.col("_near")[c]).alias(c)
            for c in numbers
        ],
    )
    tiers = [
        (F.col("_own").isNotNull(), as_row(F.col("_own"), event=first_race if race else None)),
        (F.col("_mate").isNotNull(), as_row(F.col("_mate"), slower, first_race if race else None)),
        (F.col("_team").isNotNull(), as_row(F.col("_team"), event=first_race)),
    ]
    row, tier = None, None
    for i, (test, value) in enumerate(tiers, 1):
        row = F.when(test, value) if row is None else row.when(test, value)
        tier = F.when(test, i) if tier is None else tier.when(test, i)
    shaped = joined.withColumns({"_row": row.otherwise(assumed), "source_tier": tier.otherwise(4)})
    return shaped.select(
        "FullName", "TeamName", F.lit(season).alias("Year"), "_row.*", "source_tier"
    )


def _nearest(places: DataFrame, by_grid: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Means at the grid place nearest to each assumed place, the lower one when two are as near.

    There are no more assumed places than drivers in a line-up, so each is an aggregate of its own in one pass.
    """
    asked = sorted(r[0] for r in places.filter("baseline IS NOT NULL").distinct().collect())
    grid, entry = F.col("_grid"), F.struct(F.col("_grid").alias("at"), F.struct(*numbers).alias("means"))
    found = by_grid.agg(
        *(F.max_by(entry, F.when(grid <= p, grid)).alias(f"_below{i}") for i, p in enumerate(asked)),
        *(F.min_by(entry, F.when(grid >= p, grid)).alias(f"_above{i}") for i, p in enumerate(asked)),
    )

    def nearest(i: int, p: float) -> Column:
        below, above = F.col(f"_below{i}"), F.col(f"_above{i}")
        lower = above["at"].isNull() | (F.lit(p) - below["at"] <= above["at"] - F.lit(p))
        return F.struct(F.lit(p).alias("baseline"), F.when(lower, below["means"]).otherwise(above["means"]).alias("_near"))

    if not asked:
        return places.select("baseline", F.lit(None).alias("_near")).limit(0)
    return found.select(F.inline(F.array(*(nearest(i, p) for i, p in enumerate(asked)))))


def race_details(predictions: DataFrame, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Lap and race time estimates, tyre factor and gaps (FN15, WIN7, JOIN18), a leader per season and race.

    ``noise`` is the half-width of an optional random share of the race time; off by default.
    """
    known = race_parameters(predictions)
    penalty = (F.col("PredictedPosition") - 1) * 0.3
    weather = (
        F.when(F.coalesce("AvgAirTemp", F.lit(25.0)) > 30, 1.02)
        .when(F.coalesce("HadRainfall", F.lit(0)).cast("int") == 1, 1.08)
        .otherwise(1.0)
    )
    tyre = 1 + F.col("TyreFactor") * (penalty / 10)
    lap = F.col("AvgLap") * (1 + penalty / 100) * weather * tyre
    shaken = F.lit(1.0) if not noise else 1 + (F.rand(seed) - 0.5) * 2 * noise
    timed = known.withColumns(
        {"EstimatedLapTime": lap, "RaceTimeSeconds": lap * F.col("TotalLaps") * shaken, "TireDegradation": tyre,
         "EstimateWeatherFactor": weather}
    ).withColumn("EstimatedRaceTime", format_clock(F.col("RaceTimeSeconds"), pad_hours=False))
    race = [c for c in ("Year", "GrandPrix") if c in predictions.columns]
    return gap_to_leader(timed, race, "PredictedPosition", "RaceTimeSeconds", "FullName").drop("AvgLap", "TyreFactor")


def display_predictions(scored: DataFrame) -> DataFrame:
    """Scored rows to prediction rows: rounded place, change from the grid, weather factor (MLP7, FN14, FN17)."""
    place = F.bround("prediction", 1)
    return scored.withColumns(
        {
            "PredictedPosition": place,
            "PositionChange": F.col("GridPosition") - place,
            "WeatherImpact": R.weather_impact(
                F.coalesce("HadRainfall", F.lit(0)) != 0, F.col("AvgTrackTemp"), F.col("AvgWindSpeed")
            ),
        }
    ).select(
        "FullName", "TeamName", "PredictedPosition", "GridPosition", "PositionChange", "Year", "GrandPrix",
        "AvgAirTemp", "AvgTrackTemp", "AvgHumidity", "AvgWindSpeed", "HadRainfall", "WeatherImpact",
    )


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Race prediction with estimates and gaps, best first (MLP7)."""
    return race_details(display_predictions(model.transform(rows))).orderBy("PredictedPosition", "FullName")


def run(
    tables: Mapping[str, DataFrame],
    schedule: DataFrame,
    race: str,
    years: Sequence[int],
    settings: ModelSettings | None = None,
    lineup: Mapping[str, Sequence[str]] | None = None,
):
    """Features, model, next-season rows and prediction of one race (MLP8, PIPE13)."""
    chosen = standard_names(seasons_of_event(dict(tables), schedule, race, years))
    features = settle(feature_table(chosen["results"], chosen["laps"], chosen["weather"]))
    model, _, quality = fit(features, settings)
    return predict(model, next_season_rows(features, lineup, race=race)), quality


# --- prediction tables (PIPE12) ---------------------------------------------------------------------


def results_table(predictions: DataFrame) -> DataFrame:
    """Sequential places with driver, team and the estimated time (WIN8, FN13, PRJ28)."""
    rounded = F.bround("PredictedPosition", 0).cast("int")
    placed = sequential_places(
        predictions.withColumn("RoundedPosition", rounded),
        ["Year", "GrandPrix"],
        [F.col("RoundedPosition"), F.col("PredictedPosition"), F.col("FullName")],
    )
    return placed.select(
        "Year", "GrandPrix", "Position", F.col("FullName").alias("Driver"), F.col("TeamName").alias("Team"),
        F.format_string("%.3fs", F.col("RaceTimeSeconds")).alias("RaceTime"),
    )


def weather_table(predictions: DataFrame) -> DataFrame:
    """Impact factor and conditions to one place (PRJ32)."""
    return predictions.select(
        F.col("FullName").alias("Driver"),
        F.col("WeatherImpact").alias("ImpactFactor"),
        *[
            F.bround(c, 1).alias(n)
            for c, n in (("AvgAirTemp", "AirTemp"), ("AvgTrackTemp", "TrackTemp"), ("AvgHumidity", "Humidity"))
        ],
    )


def overall_condition(predictions: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """One condition for the whole race (AGG14)."""
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return predictions.groupBy(*group).agg(
        F.when(any_of(F.col("AvgTrackTemp") > 40), "Hot and Dry")
        .when(any_of(F.col("HadRainfall").cast("int") == 1), "Wet and Rainy")
        .when(any_of(F.col("AvgTrackTemp") < 20), "Cold and Potentially Slippery")
        .otherwise("Dry and Moderate")
        .alias("condition")
    )


def tyre_table(predictions: DataFrame, race: Sequence[str] = ("Year", "GrandPrix")) -> DataFrame:
    """Seconds per lap lost to the tyres, against the race's best lap (FN16)."""
    best = predictions.groupBy(*race).agg(F.min("EstimatedLapTime").alias("_best"))
    return predictions.join(best, list(race), "left").select(
        *race,
        F.col("FullName").alias("Driver"),
        F.col("TeamName").alias("Team"),
        F.bround("TireDegradation", 3).alias("DegFactor"),
        F.bround((F.col("TireDegradation") - 1) * F.col("_best"), 3).alias("LapTimeImpact"),
    )


def top_predictions(predictions: DataFrame, k: int = 10) -> DataFrame:
    """First k of the predicted order (SRT5)."""
    return predictions.orderBy("PredictedPosition", "FullName").limit(k)


def lap_chart(predictions: DataFrame, total_laps: int = 60, race: Sequence[str] = ("Year", "GrandPrix")) -> DataFrame:
    """Running order by lap from the estimated lap time and a tyre ramp (WIN10), without a random part."""
    base = F.coalesce(to_double(F.col("EstimatedLapTime")), F.lit(90.0))
    by_lap = predictions.select(
        *race, F.col("FullName").alias("Driver"), base.alias("_base"), "TireDegradation",
        F.explode(F.sequence(F.lit(1), F.lit(total_laps))).alias("LapNumber"),
    )
    factor = tyre_ramp(F.coalesce("TireDegradation", F.lit(1.0)), F.col("LapNumber"), F.lit(float(total_laps)))
    timed = by_lap.withColumn("LapTimeSeconds", F.col("_base") * factor).drop("_base", "TireDegradation")
    return running_order(timed, race, "Driver", "LapNumber", "LapTimeSeconds")
