"""Lap analytics: statistics, comparison, catalogue of drivers and laps, track bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import format_lap_time, format_signed_gap
from ..functions.names import code_and_team, lap_label
from ..functions.records import is_timed_lap


def lap_statistics(laps: DataFrame, keys: Sequence[str] = ("FullName", "Year", "GrandPrix")) -> DataFrame:
    """Pace, speed, personal-best, stint and lap counts per driver and race (AGG1)."""
    return (
        laps.filter(_all_present(keys))
        .groupBy(*keys)
        .agg(
            F.avg("LapTimeSeconds").alias("AvgLapTime"),
            F.min("LapTimeSeconds").alias("BestLapTime"),
            F.stddev_samp("LapTimeSeconds").alias("LapTimeConsistency"),
            F.avg("SpeedST").alias("AvgSpeed"),
            F.max("SpeedST").alias("MaxSpeed"),
            F.sum(F.coalesce(F.col("IsPersonalBest").cast("int"), F.lit(0))).alias("PersonalBestCount"),
            F.count_distinct("Stint").alias("PitStopCount"),
            F.count("LapNumber").alias("CompletedLaps"),
        )
    )


def _all_present(keys: Sequence[str]) -> Column:
    """Rows with a missing group key form no group."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).isNotNull()
    return condition


def weather_statistics(weather: DataFrame, keys: Sequence[str] = ("Year", "GrandPrix")) -> DataFrame:
    """Mean conditions per race and whether it rained (AGG3)."""
    means = {
        "AirTemp": "AvgAirTemp",
        "Humidity": "AvgHumidity",
        "Pressure": "AvgPressure",
        "TrackTemp": "AvgTrackTemp",
        "WindSpeed": "AvgWindSpeed",
    }
    return (
        weather.filter(_all_present(keys))
        .groupBy(*keys)
        .agg(
            *[F.avg(c).alias(n) for c, n in means.items()],
            F.bool_or(F.coalesce("Rainfall", F.lit(False))).alias("HadRainfall"),
        )
    )


def driver_summary(laps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best, worst and mean lap time (first half of AGG9)."""
    return laps.groupBy(*keys).agg(
        F.min("LapTimeSeconds").alias("min_lap"),
        F.max("LapTimeSeconds").alias("max_lap"),
        F.avg("LapTimeSeconds").alias("avg_lap"),
    )


def faster_by(first: str, second: str, gap: Column) -> Column:
    """Verdict on a lap-time difference."""
    return (
        F.when(gap < 0, F.concat(F.lit(f"{first} faster by "), format_lap_time(F.abs(gap))))
        .when(gap > 0, F.concat(F.lit(f"{second} faster by "), format_lap_time(F.abs(gap))))
        .otherwise("No difference")
    )


def compare_summary(laps: DataFrame, first: str, second: str, session: Sequence[str], driver: str = "Driver") -> DataFrame:
    """Two drivers' summaries side by side with the verdicts (AGG9), one aggregation."""
    def of(name: str, agg, alias: str) -> Column:
        return agg(F.when(F.col(driver) == name, F.col("LapTimeSeconds"))).alias(alias)

    pairs = [(first, "first"), (second, "second")]
    wide = (
        laps.filter(F.col(driver).isin(first, second))
        .groupBy(*session)
        .agg(
            *[of(n, F.min, f"{p}_min") for n, p in pairs],
            *[of(n, F.max, f"{p}_max") for n, p in pairs],
            *[of(n, F.avg, f"{p}_avg") for n, p in pairs],
        )
    )
    best = F.col("first_min") - F.col("second_min")
    mean = F.col("first_avg") - F.col("second_avg")
    return wide.withColumns(
        {
            "best_gap": best,
            "avg_gap": mean,
            "best_verdict": faster_by(first, second, best),
            "avg_verdict": faster_by(first, second, mean),
        }
    )


def lap_by_lap(
    laps: DataFrame, first: str, second: str, session: Sequence[str], driver: str = "Driver", lap: str = "LapNumber"
) -> DataFrame:
    """Both drivers' lap times per lap, laps of either kept, with gap and display text (JOIN5)."""
    def side(name: str, out: str) -> DataFrame:
        return laps.filter(F.col(driver) == name).select(*session, lap, F.col("LapTimeSeconds").alias(out))

    gap = F.col("first_time") - F.col("second_time")
    return (
        side(first, "first_time")
        .join(side(second, "second_time"), [*session, lap], "full")
        .withColumns(
            {
                "gap": gap,
                "first_display": format_lap_time(F.col("first_time")),
                "second_display": format_lap_time(F.col("second_time")),
                "gap_display": format_signed_gap(gap),
            }
        )
    )


def driver_list(laps: DataFrame, session: Sequence[str]) -> DataFrame:
    """Drivers of a session with the team of their first record (AGG8)."""
    first = laps.groupBy(*session, "Driver").agg(
        F.min(F.struct("LapNumber", "DriverNumber", "Team", "TeamID")).alias("_f")
    )
    return first.select(
        *session,
        "Driver",
        F.col("_f.DriverNumber").alias("DriverNumber"),
        F.col("_f.Team").alias("Team"),
        F.col("_f.TeamID").alias("TeamID"),
        code_and_team(F.col("Driver"), F.col("_f.Team")).alias("DisplayName"),
    )


def lap_options(laps: DataFrame, *columns: str) -> DataFrame:
    """Selectable laps with their label (PRJ20 + FN19)."""
    return laps.filter(is_timed_lap()).select(
        *columns,
        "LapNumber",
        "LapTimeSeconds",
        "IsPersonalBest",
        lap_label(F.col("LapNumber"), F.col("LapTimeSeconds"), F.col("IsPersonalBest")).alias("DisplayName"),
    )


def fastest_lap(laps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lap number of the best valid lap, 1 for drivers without one (WIN6)."""
    best = F.min(F.when(is_timed_lap(), F.struct("LapTimeSeconds", "LapNumber")))
    return laps.groupBy(*keys).agg(F.coalesce(best["LapNumber"], F.lit(1.0)).alias("FastestLap"))


def track_bounds(points: DataFrame, keys: Sequence[str] = (), by_minimum: bool = False) -> DataFrame:
    """Bounding box of a trace with 10 % room (AGG10).

    Each side is padded by a tenth of its own coordinate, or with ``by_minimum`` both by the minimum's.
    """
    columns = []
    for axis in ("X", "Y"):
        low, high = F.min(axis), F.max(axis)
        pad_high = F.abs(low * 0.1) if by_minimum else F.abs(high * 0.1)
        columns += [
            (low - F.abs(low * 0.1)).alias(f"{axis.lower()}_min"),
            (high + pad_high).alias(f"{axis.lower()}_max"),
        ]
    return points.groupBy(*keys).agg(*columns)


def trace_start(points: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First point with both coordinates (WIN11)."""
    valid = F.when(F.col("X").isNotNull() & F.col("Y").isNotNull(), F.struct(*order, "X", "Y"))
    first = points.groupBy(*keys).agg(F.min(valid).alias("_f"))
    return first.select(*keys, F.col("_f.X").alias("start_x"), F.col("_f.Y").alias("start_y"))
