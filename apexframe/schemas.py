"""Record schemas of the six topics and of the dimension tables, as Spark types.

Column names and types are fixed values: they are the wire format of the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "DOUBLE": T.DoubleType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "DATE": T.DateType(),
}


def flat_schema(text: str) -> T.StructType:
    """Schema of plain columns from ``name TYPE, name TYPE``; needs no running session."""
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


_SESSION = "Year INT, GrandPrix STRING, SessionType STRING"
_META = "DataType STRING, RecordId STRING"
_TAGS = "IsPrediction BOOLEAN, SourceYear INT, SourceEvent STRING"

LAPS = flat_schema(
    "Time STRING, Driver STRING, DriverNumber STRING, LapTime STRING, LapNumber DOUBLE, Stint DOUBLE, "
    "PitOutTime STRING, PitInTime STRING, Sector1Time STRING, Sector2Time STRING, Sector3Time STRING, "
    "Sector1SessionTime STRING, Sector2SessionTime STRING, Sector3SessionTime STRING, "
    "SpeedI1 DOUBLE, SpeedI2 DOUBLE, SpeedFL DOUBLE, SpeedST DOUBLE, IsPersonalBest BOOLEAN, "
    "Compound STRING, TyreLife DOUBLE, FreshTyre BOOLEAN, Team STRING, LapStartTime STRING, "
    "LapStartDate TIMESTAMP, TrackStatus STRING, Position DOUBLE, Deleted BOOLEAN, DeletedReason STRING, "
    f"FastF1Generated BOOLEAN, IsAccurate BOOLEAN, {_SESSION}, {_TAGS}"
)
CAR_TELEMETRY = flat_schema(
    "Time STRING, Date TIMESTAMP, Driver STRING, RPM DOUBLE, Speed DOUBLE, nGear INT, Throttle DOUBLE, "
    f"Brake DOUBLE, DRS INT, {_SESSION}, {_META}, LapNumber DOUBLE, {_TAGS}"
)
CAR_POSITION = flat_schema(
    "Time STRING, Date TIMESTAMP, Driver STRING, X DOUBLE, Y DOUBLE, Z DOUBLE, Status STRING, "
    f"{_SESSION}, {_META}, LapNumber DOUBLE, {_TAGS}"
)
DRIVER_INFO = flat_schema(
    "Driver STRING, DriverNumber STRING, FullName STRING, Abbreviation STRING, TeamName STRING, "
    f"Nationality STRING, {_SESSION}, {_META}, {_TAGS}"
)
RACE_RESULTS = flat_schema(
    "Driver STRING, DriverNumber STRING, Position DOUBLE, ClassifiedPosition STRING, GridPosition DOUBLE, "
    "Q1 STRING, Q2 STRING, Q3 STRING, Time STRING, Status STRING, Points DOUBLE, TeamName STRING, "
    f"{_SESSION}, {_META}, {_TAGS}"
)
WEATHER = flat_schema(
    "Time STRING, AirTemp DOUBLE, Humidity DOUBLE, Pressure DOUBLE, Rainfall BOOLEAN, TrackTemp DOUBLE, "
    f"WindDirection INT, WindSpeed DOUBLE, {_SESSION}, {_META}, {_TAGS}"
)

#: topic -> (table, schema); fixed values.
TOPICS = {
    "telemetry-data": ("telemetry", LAPS),
    "car-telemetry-data": ("car_telemetry", CAR_TELEMETRY),
    "car-position-data": ("car_position", CAR_POSITION),
    "driver-info-data": ("driver_info", DRIVER_INFO),
    "race-results-data": ("race_results", RACE_RESULTS),
    "weather-data": ("weather", WEATHER),
}
#: The tables a session needs before it counts as present; fixed values.
REQUIRED_TABLES = ("car_position", "car_telemetry", "driver_info", "race_results", "telemetry", "weather")

SESSION_KEYS = ("Year", "GrandPrix", "SessionType")

SCHEDULE = flat_schema(
    "Year INT, RoundNumber INT, EventName STRING, EventDate DATE, Location STRING, Country STRING"
)
CIRCUITS_RAW = T.StructType(
    [
        *flat_schema("circuitId STRING, circuitName STRING, url STRING").fields,
        T.StructField("Location", flat_schema("lat STRING, long STRING, locality STRING, country STRING")),
    ]
)
PREDICTION_ROW = flat_schema(
    "FullName STRING, TeamName STRING, PredictedPosition DOUBLE, GridPosition DOUBLE, PositionChange DOUBLE, "
    "Year INT, GrandPrix STRING, AvgAirTemp DOUBLE, AvgTrackTemp DOUBLE, AvgHumidity DOUBLE, "
    "AvgWindSpeed DOUBLE, HadRainfall INT, WeatherImpact DOUBLE, EstimatedLapTime DOUBLE, "
    "EstimatedRaceTime STRING, RaceTimeSeconds DOUBLE, TireDegradation DOUBLE, TotalLaps DOUBLE, "
    "GapToLeader DOUBLE, Gap STRING"
)
PREDICTION_DOCUMENT = T.StructType(
    [
        T.StructField("race", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("predictions", T.ArrayType(PREDICTION_ROW)),
    ]
)
FEATURES = flat_schema(
    "FullName STRING, TeamName STRING, Year INT, GrandPrix STRING, Position DOUBLE, GridPosition DOUBLE, "
    "GridPositionDelta DOUBLE, AvgLapTime DOUBLE, BestLapTime DOUBLE, LapTimeConsistency DOUBLE, "
    "AvgSpeed DOUBLE, MaxSpeed DOUBLE, PersonalBestCount BIGINT, PitStopCount BIGINT, CompletedLaps BIGINT, "
    "AvgAirTemp DOUBLE, AvgHumidity DOUBLE, AvgTrackTemp DOUBLE, AvgWindSpeed DOUBLE, HadRainfall INT"
)
RUNS = T.StructType(
    [
        *flat_schema(
            "run_id STRING, run_name STRING, experiment STRING, race_name STRING, status STRING, "
            "start_time BIGINT, end_time BIGINT"
        ).fields,
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)


def ensure_columns(df: DataFrame, defaults: dict[str, str | tuple[str, object]]) -> DataFrame:
    """Add the columns a reader expects but the table lacks: name -> type, or name -> (type, default)."""
    missing: dict[str, Column] = {}
    for name, spec in defaults.items():
        if name not in df.columns:
            kind, value = spec if isinstance(spec, tuple) else (spec, None)
            missing[name] = F.lit(value).cast(kind)
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema``; values that do not fit a type become null, absent columns null."""
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(
                f.name
            )
            for f in schema.fields
        ]
    )
