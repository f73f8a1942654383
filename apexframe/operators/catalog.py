"""What data is there: counts, status, sessions, drivers, events (AGG5-AGG7, AGG11, AGG15, AGG20, SRC4, SRC9, PRJ29, SET3-SET5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import readiness


def table_counts(tables: Mapping[str, DataFrame], condition: Column | None = None) -> DataFrame:
    """Rows per table, zero for empty ones (AGG5)."""
    parts = []
    for name, df in tables.items():
        rows = df.filter(condition) if condition is not None else df
        parts.append(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n"))
    return reduce(DataFrame.unionByName, parts)


def session_table_counts(tables: Mapping[str, DataFrame], session: Sequence[str]) -> DataFrame:
    """Rows per session and table for all sessions at once; tables without rows are absent (AGG5)."""
    parts = [
        df.groupBy(*session).agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(name))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def availability(counts: DataFrame, required: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Status of a session from its table counts: exists, processing or not_found (AGG6, SET3)."""
    held = counts.groupBy(*group).agg(
        F.sort_array(F.collect_set(F.when((F.col("n") > 0) & F.col("table_name").isin(*required), F.col("table_name")))).alias("held"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )
    missing = F.array_except(F.array_sort(F.array(*[F.lit(r) for r in required])), F.col("held"))
    status = F.when(F.size(missing) == 0, "exists").when(F.col("total") > 0, "processing").otherwise("not_found")
    return held.select(
        *group,
        "total",
        F.size(missing).alias("missing_count"),
        F.array_join(missing, ",").alias("missing_tables"),
        status.alias("status"),
    )


def prediction_status(counts: DataFrame, running: bool = False) -> DataFrame:
    """Status of a prediction extract from its total count (AGG6)."""
    total = F.coalesce(F.sum("n"), F.lit(0))
    some, none = ("processing", "starting") if running else ("complete", "not_found")
    return counts.agg(total.alias("total")).withColumn("status", F.when(F.col("total") > 0, some).otherwise(none))


def session_catalogue(df: DataFrame) -> DataFrame:
    """Distinct sessions, newest year first (AGG7)."""
    return (
        df.select("Year", "GrandPrix", "SessionType")
        .distinct()
        .orderBy(F.desc("Year"), F.asc("GrandPrix"), F.asc("SessionType"))
    )


def nested_catalogue(df: DataFrame) -> DataFrame:
    """Year -> grand prix -> sessions as nested arrays; one entry per distinct session (AGG7)."""
    events = session_catalogue(df).groupBy("Year", "GrandPrix").agg(
        F.array_sort(F.collect_set("SessionType")).alias("sessions")
    )
    return events.groupBy("Year").agg(F.array_sort(F.collect_list(F.struct("GrandPrix", "sessions"))).alias("events"))


def distinct_sessions(df: DataFrame, *more: str) -> DataFrame:
    """Session triples, optionally with drivers, of a batch (AGG11)."""
    return df.select("Year", "GrandPrix", "SessionType", *more).distinct()


def source_years(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct source years (AGG15)."""
    return df.groupBy(*group).agg(F.sort_array(F.collect_set("SourceYear")).alias("source_years"))


def season_schedule(schedule: DataFrame, first: int = 2022, last: int = 2026) -> DataFrame:
    """Events of a range of seasons (SRC4)."""
    return schedule.filter(F.col("Year").between(first, last)).select(
        F.col("Year").alias("year"),
        F.col("EventName").alias("name"),
        F.col("RoundNumber").alias("round"),
        F.date_format("EventDate", "yyyy-MM-dd").alias("date"),
    )


def newest_schedule(schedule: DataFrame, candidates: Sequence[int] = (2026, 2025)) -> DataFrame:
    """Events of the newest candidate season that has any (SRC9)."""
    offered = schedule.filter(F.col("Year").isin(*candidates))
    newest = offered.agg(F.max("Year").alias("y"))
    return offered.filter(F.col("Year") == newest.scalar())


def season_progress(schedule: DataFrame, as_of: Column) -> DataFrame:
    """Completed and upcoming events per season and the training verdict (PRJ29)."""
    done = F.count_if(F.col("EventDate") < as_of)
    return schedule.groupBy("Year").agg(
        done.alias("completed"), F.count_if(~(F.col("EventDate") < as_of)).alias("upcoming"), readiness(done).alias("verdict")
    )


def other_options(options: DataFrame, chosen: Column) -> DataFrame:
    """Options without the chosen one (SET4)."""
    return options.filter(~chosen)


def has_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows added and removed between two reads, and whether there are any (SET5)."""
    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    added = size(after.exceptAll(before), "added")
    removed = size(before.exceptAll(after), "removed")
    return added.withColumn("removed", removed.scalar()).withColumn(
        "changed", (F.col("added") > 0) | (F.col("removed") > 0)
    )
