"""Named queries behind the views: comparison, lap trace, classification, series, replay (PIPE7-PIPE11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durations import duration_seconds, seconds_to_minutes
from ..functions.records import fill_all_zero, is_valid_lap
from ..operators import laps as L
from ..operators import results as P
from ..operators.align import proportional_align, zip_align
from ..operators.lookup import by_driver_number, prefer
from ..schemas import SESSION_KEYS, ensure_columns


def compare_laps(laps: DataFrame, first: str, second: str, session: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Valid laps of two drivers lap by lap, with minutes for the chart (PIPE7)."""
    valid = laps.filter(is_valid_lap())
    table = L.lap_by_lap(valid, first, second, session)
    return table.withColumns(
        {
            "first_minutes": seconds_to_minutes(F.col("first_time")),
            "second_minutes": seconds_to_minutes(F.col("second_time")),
        }
    )


def compare_summary(laps: DataFrame, first: str, second: str, session: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Summary line of PIPE7."""
    return L.compare_summary(laps.filter(is_valid_lap()), first, second, session)


def lap_trace(
    positions: DataFrame, samples: DataFrame, driver_info: DataFrame, session: Sequence[str] = SESSION_KEYS
) -> DataFrame:
    """Track points with speed, per driver and lap, samples keyed by car number (PIPE8)."""
    keys = [*session, "DriverNumber", "DriverCode", "LapNumber"]
    side = lambda df: by_driver_number(df, driver_info, session).withColumn("_t", duration_seconds(F.col("Time")))
    traced = zip_align(
        side(positions).select(*keys, "X", "Y", "_t"),
        side(samples).select(*keys, "Speed", "_t"),
        keys,
        [F.col("_t")],
        [F.col("_t")],
        ["Speed"],
        fill="Speed",
    )
    return traced.drop("_t")


def classification(results: DataFrame, laps: DataFrame, session: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Race classification from the result list, or from last laps where a session has none (PIPE9)."""
    race = F.col("SessionType") == "Race"
    provisional = P.last_lap_classification(laps.filter(race), session)
    return P.classification(prefer(results.filter(race), provisional, session), session)


def position_series(laps: DataFrame, results: DataFrame, session: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """Position per lap, backfilled from the result list where laps have none (PIPE10)."""
    wanted = {
        "LapNumber": "double", "Position": "double", "Driver": "string", "Team": "string", "TeamID": "int",
        "LapTime": "string", "Compound": "string", "Stint": "double", "TyreLife": "double", "Time": "string",
        "DriverNumber": "string", "AverageSpeed": "double",
    }
    return P.backfill_position(ensure_columns(laps, wanted), results, session).select(*session, *wanted)


def replay(
    positions: DataFrame, samples: DataFrame, driver_info: DataFrame, session: Sequence[str] = SESSION_KEYS
) -> DataFrame:
    """Position frames of each driver with the telemetry at the same share of the series (PIPE11)."""
    keys = [*session, "DriverNumber"]
    def side(df: DataFrame, *columns: str) -> DataFrame:
        coded = by_driver_number(df, driver_info, session)
        return coded.select(*keys, "LapNumber", duration_seconds(F.col("Time")).alias("SessionSeconds"), *columns)

    order = [F.col("LapNumber"), F.col("SessionSeconds")]
    cars = ["Speed", "RPM", "Throttle", "Brake", "DRS"]
    frames = proportional_align(side(positions, "X", "Y", "Z"), side(samples, *cars), keys, order, order, cars)
    return fill_all_zero(frames)
