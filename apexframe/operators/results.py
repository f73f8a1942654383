"""Classifications, gaps and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.durations import format_leader_gap, to_double
from ..functions.names import driver_display
from ..functions.records import display_position, position_category
from ..schemas import ensure_columns
from .ordered import scan


def team_name_fallback(df: DataFrame, session: Sequence[str]) -> DataFrame:
    """TeamName from Team, for sessions in which no row has a TeamName (PRJ24)."""
    named = df.groupBy(*session).agg(F.count("TeamName").alias("_named"))
    joined = df.join(named, list(session), "left")
    value = F.when(F.col("_named") == 0, F.col("Team")).otherwise(F.col("TeamName"))
    return joined.withColumn("TeamName", value).select(*df.columns)


def classification(results: DataFrame, session: Sequence[str]) -> DataFrame:
    """Result rows with numeric place, display forms and category (PRJ17, PRJ23, PRJ24, PRJ25)."""
    text = {c: "string" for c in ("Driver", "DriverNumber", "Team", "TeamName", "Status")}
    full = ensure_columns(results, {**text, "Position": "double", "Points": "double"})
    place = F.coalesce(to_double(F.col("Position")), F.lit(float(K.UNCLASSIFIED_POSITION)))
    return team_name_fallback(full, session).withColumns(
        {
            "PositionNumeric": place,
            "DisplayPosition": display_position(place),
            "DriverDisplay": driver_display(F.col("Driver"), F.col("DriverNumber")),
            "PositionCategory": position_category(place, F.col("Status"), serving=True),
        }
    )


def last_lap_classification(laps: DataFrame, session: Sequence[str]) -> DataFrame:
    """Provisional result from every driver's last lap (WIN3)."""
    usable = laps.filter(F.col("Driver").isNotNull() & (F.col("LapNumber") != 0))
    fields = ["LapNumber", "DriverNumber", "Position", "Team", "TeamID"]
    last = usable.groupBy(*session, "Driver").agg(F.max(F.struct(*fields)).alias("_l"))
    return last.select(
        *session,
        "Driver",
        F.col("_l.DriverNumber").alias("DriverNumber"),
        F.col("_l.Position").alias("Position"),
        F.col("_l.Team").alias("Team"),
        F.col("_l.Team").alias("TeamName"),
        F.col("_l.TeamID").alias("TeamID"),
        F.lit("Finished").alias("Status"),
    )


def best_row_per_driver(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """First row per key in the given order (WIN4); an aggregate, not a sort of the whole key."""
    named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*named, *columns)).alias("_f"))
    return first.select(*keys, *[F.col("_f")[c].alias(c) for c in columns])


def nulls_last(c: Column) -> Column:
    """Sort key that puts missing values last in ascending order."""
    return F.coalesce(c.cast("double"), F.lit(1.7976931348623157e308))


def gap_to_leader(df: DataFrame, race: Sequence[str], position: str, seconds: str, tiebreak: str) -> DataFrame:
    """Seconds behind the first by position, and its display form (WIN7)."""
    leader = df.groupBy(*race).agg(
        F.min(F.struct(nulls_last(F.col(position)).alias("p"), F.col(tiebreak).alias("t"), F.col(seconds).alias("s")))[
            "s"
        ].alias("_leader")
    )
    gap = F.col(seconds) - F.col("_leader")
    return (
        df.join(leader, list(race), "left").withColumns({"GapToLeader": gap, "Gap": format_leader_gap(gap)}).drop("_leader")
    )


def group_means(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Means of columns per group (AGG13)."""
    return df.groupBy(*group).agg(*[F.avg(c).alias(c) for c in columns])


def sequential_places(df: DataFrame, race: Sequence[str], order: Sequence[Column], name: str = "Position") -> DataFrame:
    """1..n per race in the given order (WIN8)."""
    return scan(df, race, order, number=name)


def grid_places(df: DataFrame, session: Sequence[str], tiebreak: str) -> DataFrame:
    """Running place in the result grid, DNF for the unclassified (WIN12)."""
    numbered = scan(df, session, [F.col("PositionNumeric"), F.col(tiebreak)], number="_place")
    shown = F.when(F.col("PositionNumeric") == K.UNCLASSIFIED_POSITION, "DNF").otherwise(F.col("_place").cast("string"))
    return numbered.withColumn("GridPlace", shown).drop("_place")


def backfill_position(laps: DataFrame, results: DataFrame, session: Sequence[str]) -> DataFrame:
    """Lap positions from the result list, for race sessions in which no lap has one (JOIN6)."""
    known = laps.groupBy(*session).agg(F.count("Position").alias("_known"))
    final = results.groupBy(*session, "Driver").agg(F.min("Position").alias("_final"))
    backfilled = F.when(
        (F.col("_known") == 0) & (F.col("SessionType") == "Race"), F.coalesce("Position", "_final")
    ).otherwise(F.col("Position"))
    return (
        laps.join(known, list(session), "left")
        .join(final, [*session, "Driver"], "left")
        .withColumn("Position", backfilled)
        .select(*laps.columns)
    )
