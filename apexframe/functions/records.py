"""Per-row derivations of the six record kinds (PRJ1-PRJ18, PRJ30-PRJ32, FN11-FN17, FN20, NUL1-NUL4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K


def flag(condition: Column) -> Column:
    """Three-valued condition to a plain boolean: unknown is false."""
    return F.coalesce(condition, F.lit(False))


def tag(df: DataFrame, **values: object) -> DataFrame:
    """Add literal columns, replacing any of the same name (PRJ1)."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def json_safe(df: DataFrame) -> DataFrame:
    """NaN to null, timestamps to ISO text (PRJ2)."""
    changed: dict[str, Column] = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            changed[f.name] = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(c, ".SSSSSS")
            changed[f.name] = F.concat(whole, F.when(micros == ".000000", "").otherwise(micros))
    return df.withColumns(changed) if changed else df


def record_id(*natural_key: str) -> Column:
    """Stable record id from the natural key, so that a replay produces the same id (PRJ3)."""
    return F.sha2(F.to_json(F.struct(*natural_key), {"ignoreNullFields": "false"}), 256)


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def driver_info_projection(results: DataFrame) -> DataFrame:
    """Driver rows from a result list, with the name and nationality fallbacks (PRJ4)."""
    composed = F.concat(F.coalesce("FirstName", F.lit("")), F.lit(" "), F.coalesce("LastName", F.lit("")))
    return results.select(
        F.col("Abbreviation").alias("Driver"),
        "DriverNumber",
        F.coalesce(non_empty(F.col("FullName")), composed).alias("FullName"),
        "Abbreviation",
        "TeamName",
        F.coalesce(non_empty(F.col("Nationality")), F.col("CountryCode")).alias("Nationality"),
        *K_SESSION,
        F.lit("DriverInfo").alias("DataType"),
    )


K_SESSION = ("Year", "GrandPrix", "SessionType")


def driver_info_from_laps(laps: DataFrame) -> DataFrame:
    """Drivers and their first team where there is no result list (PRJ5); partial aggregation only."""
    return (
        laps.groupBy(*K_SESSION, "Driver")
        .agg(F.min_by("Team", "LapNumber").alias("TeamName"))
        .select(
            "Driver",
            F.lit(None).cast("string").alias("DriverNumber"),
            F.lit(None).cast("string").alias("FullName"),
            F.col("Driver").alias("Abbreviation"),
            "TeamName",
            F.lit(None).cast("string").alias("Nationality"),
            *K_SESSION,
            F.lit("DriverInfo").alias("DataType"),
        )
    )


def result_projection(results: DataFrame) -> DataFrame:
    """Result rows of the sessions that have results (PRJ6)."""
    return results.filter(F.col("SessionType").isin(*K.RESULT_SESSION_TYPES)).select(
        F.col("Abbreviation").alias("Driver"),
        "DriverNumber",
        "Position",
        "ClassifiedPosition",
        "GridPosition",
        "Q1",
        "Q2",
        "Q3",
        "Time",
        "Status",
        "Points",
        "TeamName",
        *K_SESSION,
        F.lit("RaceResults").alias("DataType"),
    )


def sample_projection(df: DataFrame, data_type: str, natural_key: Sequence[str], **tags: object) -> DataFrame:
    """Tag, make JSON-safe and id a record set for publishing (PRJ7 = PRJ1 + PRJ2 + PRJ3)."""
    tagged = tag(df, DataType=data_type, **tags)
    return json_safe(tagged).withColumn("RecordId", record_id("DataType", *natural_key))


def prediction_tags(df: DataFrame) -> DataFrame:
    """Mark past records as model input of the session they come from (PRJ31)."""
    return df.withColumns(
        {
            "SessionType": F.lit("Race"),
            "IsPrediction": F.lit(True),
            "SourceYear": F.col("Year"),
            "SourceEvent": F.col("GrandPrix"),
        }
    )


def default_session(df: DataFrame) -> DataFrame:
    """Null session keys to their defaults (PRJ9)."""
    return df.fillna(
        {"Year": K.DEFAULT_YEAR, "GrandPrix": K.DEFAULT_GRAND_PRIX, "SessionType": K.DEFAULT_SESSION_TYPE}
    )


def lap_flags(df: DataFrame) -> DataFrame:
    """DidPit, IsFirstLap and the three track-status flags (PRJ10, PRJ11)."""
    status = F.col("TrackStatus")
    pit = F.col("PitInTime")
    return df.withColumns(
        {
            "DidPit": flag(pit.isNotNull() & ~pit.isin(*K.EMPTY_PIT_TIMES)),
            "IsFirstLap": flag(F.col("LapNumber") == 1),
            "IsYellowFlag": flag(status.contains("2")),
            "IsSafetyCarDeployed": flag(status.contains("4")),
            "IsVirtualSafetyCarDeployed": flag(status.contains("5")),
        }
    )


def average_speed() -> Column:
    """Mean of the four speed traps, null when any is missing (PRJ12)."""
    return (F.col("SpeedI1") + F.col("SpeedI2") + F.col("SpeedFL") + F.col("SpeedST")) / 4


def car_flags(df: DataFrame) -> DataFrame:
    """Braking, accelerating and DRS flags (PRJ13)."""
    return df.withColumns(
        {
            "IsBraking": flag(F.col("Brake") > 0),
            "IsAccelerating": flag(F.col("Throttle") > 0),
            "IsDRSOpen": flag(F.col("DRS") > 0),
        }
    )


def position_distance(df: DataFrame) -> DataFrame:
    """Distance from the origin, taken before missing coordinates become zero (PRJ14)."""
    x, y = F.col("X"), F.col("Y")
    return df.withColumn("DistanceFromOrigin", F.sqrt(x * x + y * y)).fillna(0, ["X", "Y", "Z"])


def numeric_position(df: DataFrame) -> DataFrame:
    """Position as a number, and its whole part (PRJ15)."""
    from .durations import to_double

    position = to_double(F.col("Position"))
    return df.withColumns({"Position": position, "PositionNumeric": position.try_cast("int")})


def position_category(place: Column, status: Column, points: Column | None = None, serving: bool = False) -> Column:
    """Podium / Points / outcome class.

    The ingest form (PRJ16) also looks at points and tells DNS and disqualification apart; the
    ``serving`` form (PRJ17) treats a missing place as unclassified and knows DNF only.
    """
    if serving:
        place = F.coalesce(place, F.lit(K.UNCLASSIFIED_POSITION))
    chain = F.when(place <= 3, "Podium").when(place <= 10, "Points")
    if not serving:
        if points is not None:
            chain = chain.when(points > 0, "Points")
        chain = chain.when(status == "DNF", "DNF").when(status == "DNS", "DNS").when(status == "DSQ", "Disqualified")
    else:
        chain = chain.when(status == "DNF", "DNF")
    return chain.otherwise("No Points")


def display_position(place: Column) -> Column:
    """Whole-number place, or DNF when unclassified (PRJ23)."""
    return F.when(place == K.UNCLASSIFIED_POSITION, "DNF").otherwise(place.cast("int").cast("string"))


def weather_columns(df: DataFrame) -> DataFrame:
    """Track-air difference and wet / dry class (PRJ18)."""
    return df.withColumns(
        {
            "TempDelta": F.col("TrackTemp") - F.col("AirTemp"),
            "WeatherCondition": F.when(F.col("Rainfall"), "Wet").otherwise("Dry"),
        }
    )


def is_valid_lap() -> Column:
    """Not deleted, timed, and between 30 and 300 seconds inclusive (PRJ19)."""
    return ~flag(F.col("Deleted")) & F.col("LapTimeSeconds").between(K.MIN_LAP_SECONDS, K.MAX_LAP_SECONDS)


def is_timed_lap() -> Column:
    """Not marked deleted and timed; an unknown mark passes (PRJ20)."""
    return ~F.col("Deleted").eqNullSafe(F.lit(True)) & F.col("LapTimeSeconds").isNotNull()


def session_rows(events: DataFrame, keys: Sequence[str] = ("Year", "EventName")) -> DataFrame:
    """One row per session held, from one date column per session key (PRJ30)."""
    from .durations import iso_date
    from .names import session_name

    held = [k for k in K.SESSION_NAMES if k in events.columns]
    order = F.array_position(F.array(*[F.lit(k) for k in K.SESSION_NAMES]), F.col("key"))
    return (
        events.unpivot(list(keys), held, "key", "held_on")
        .filter(F.col("held_on").isNotNull())
        .select(*keys, session_name(F.col("key")).alias("name"), "key", iso_date(F.col("held_on")).alias("date"), order.alias("ordinal"))
    )


def as_bit(c: Column) -> Column:
    """Boolean or text truth to 0/1; anything else is 0 (FN11)."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1").cast("int"), F.lit(0))


def half_even(c: Column, digits: int = 0) -> Column:
    """Half-even rounding (FN13)."""
    return F.bround(c, digits)


def weather_impact(rain: Column, track: Column, wind: Column) -> Column:
    """Lap-time multiplier from rain, track temperature and wind (FN14)."""
    track = F.coalesce(track, F.lit(30.0))
    return (
        F.when(flag(rain), 1.05).otherwise(1.0)
        * F.when(track > 40, 1.02).when(track < 20, 1.015).otherwise(1.0)
        * F.when(F.coalesce(wind, F.lit(10.0)) > 20, 1.01).otherwise(1.0)
    )


def epoch_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def run_minutes(start_ms: Column, end_ms: Column) -> Column:
    """Duration in minutes to 2 places, null while running (FN20)."""
    return F.bround((end_ms - start_ms) / F.lit(60000.0), 2)


def fill_by_type(df: DataFrame) -> DataFrame:
    """Numbers to 0, booleans to 0/1, the rest to text (NUL3)."""
    out: dict[str, Column] = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            out[f.name] = as_bit(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out[f.name] = F.coalesce(c.cast("string"), F.lit("None"))
    return df.withColumns(out)


def fill_all_zero(df: DataFrame) -> DataFrame:
    """Every null to 0, text included (NUL4)."""
    return df.fillna(0).fillna("0")


def round_columns(df: DataFrame, names: Sequence[str], digits: int) -> DataFrame:
    """Half-even rounding of several columns (PRJ32)."""
    return df.withColumns({n: F.bround(n, digits) for n in names})


def readiness(n: Column) -> Column:
    """Verdict on the number of completed races: 0, 1-2, 3 and more (PRJ29)."""
    return F.when(n == 0, "none").when(n < 3, "limited").otherwise("ready")
