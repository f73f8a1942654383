"""Durations that travel as text: cleaning, parsing and display (FN1-FN6, FN18, FN23, FN24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K


def to_double(c: Column) -> Column:
    """Text to double, null where it is no number (FN12). A trailing type letter does not count as one."""
    text = c.cast("string")
    return F.when(~text.rlike("[dDfF]\\s*$"), text.try_cast("double"))


def clean_duration(c: Column, keep_days: bool = False) -> Column:
    """Strip a leading day count, keep clock forms, null the rest (FN1).

    ``keep_days`` adds the stripped days to the hours instead of losing them.
    """
    rest = F.regexp_replace(c, K.DAY_PREFIX, "")
    if keep_days:
        days = F.regexp_extract(c, r"^(\d+)\s+days\s+", 1).try_cast("int")
        hours = F.substring_index(rest, ":", 1).try_cast("int")
        padded = F.format_string("%02d", days * 24 + hours)
        carried = F.concat(padded, F.substr(rest, F.length(F.substring_index(rest, ":", 1)) + 1))
        rest = F.when((days > 0) & hours.isNotNull(), carried).otherwise(rest)
    return F.when(c.contains("days"), rest).when(c.rlike(K.CLOCK_FORM), c)


def clean_time_columns(df: DataFrame, keep_days: bool = False) -> DataFrame:
    """FN1 over every text column whose name contains "Time", in a single projection."""
    names = [f.name for f in df.schema.fields if "Time" in f.name and isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: clean_duration(F.col(n), keep_days) for n in names}) if names else df


#: up to two whole numbers and a decimal number, separated by colons
_PARSED = r"^(\s*[+-]?\d+\s*:){0,2}\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def duration_seconds(c: Column) -> Column:
    """``h:m:s``, ``m:s`` or ``s`` to seconds; null for null, empty, NaT and malformed text (FN2)."""
    parts = F.split(c, ":")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    zero = F.lit(0.0)
    return F.when(c.rlike(_PARSED), F.coalesce(part(-3), zero) * 3600 + F.coalesce(part(-2), zero) * 60 + part(-1))


def is_duration(c: Column) -> Column:
    """Whether ``duration_seconds`` gives a number."""
    return F.coalesce(c.rlike(_PARSED), F.lit(False))


def is_missing_duration(c: Column) -> Column:
    return c.isNull() | c.isin(*K.EMPTY_DURATIONS)


def format_lap_time(seconds: Column) -> Column:
    """Seconds as ``m:s.mmm`` with unpadded seconds; null shows as empty text (FN3)."""
    shown = F.format_string("%d:%.3f", F.floor(seconds / 60), F.pmod(seconds, F.lit(60.0)))
    return F.when(seconds.isNull(), F.lit("")).otherwise(shown)


def format_clock(seconds: Column, pad_hours: bool = True) -> Column:
    """Seconds as ``HH:MM:SS.mmm`` or ``H:MM:SS.mmm`` (FN4)."""
    pattern = "%02d:%02d:%06.3f" if pad_hours else "%01d:%02d:%06.3f"
    shown = F.format_string(
        pattern,
        F.floor(seconds / 3600),
        F.floor(F.pmod(seconds, F.lit(3600.0)) / 60),
        F.pmod(seconds, F.lit(60.0)),
    )
    return F.when(seconds.isNotNull(), shown)


def format_signed_gap(gap: Column) -> Column:
    """``+m:s`` / ``-m:s``; zero and unknown gaps show ``0.000`` (FN5)."""
    shown = format_lap_time(F.abs(gap))
    return (
        F.when(gap > 0, F.concat(F.lit("+"), shown)).when(gap < 0, F.concat(F.lit("-"), shown)).otherwise("0.000")
    )


def format_leader_gap(gap: Column) -> Column:
    """Leader / ``+1m 2.000s`` / ``+2.000s`` (FN6)."""
    return (
        F.when(gap < 0.001, F.lit("Leader"))
        .when(gap > 60, F.format_string("+%dm %.3fs", F.floor(gap / 60), F.pmod(gap, F.lit(60.0))))
        .when(gap.isNotNull(), F.format_string("+%.3fs", gap))
    )


def interval_seconds(c: Column) -> Column:
    """Seconds of a day-time interval column (FN18)."""
    return F.extract(F.lit("SECOND"), c).cast("double") + 60 * (
        F.extract(F.lit("MINUTE"), c) + 60 * (F.extract(F.lit("HOUR"), c) + 24 * F.extract(F.lit("DAY"), c))
    )


def seconds_to_minutes(seconds: Column) -> Column:
    return seconds / 60


def year_list(c: Column) -> Column:
    """Comma separated years to an int array (FN23)."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("int"))


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def parse_iso(c: Column) -> Column:
    """ISO text, with or without a Z, to a timestamp; null when malformed (FN24)."""
    return F.regexp_replace(c, "Z$", "+00:00").try_cast("timestamp")
