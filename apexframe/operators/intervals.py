"""Assigning samples to laps: lap spans, interval and as-of assignment (JOIN1, JOIN2, PRJ8)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durations import duration_seconds, format_clock, is_duration
from .ordered import scan, settle


def span_end_text(spans: DataFrame) -> DataFrame:
    """End of the lap as clock text (JOIN2)."""
    return spans.withColumn("EndTime", format_clock(F.col("EndSeconds")))


def lap_spans(laps: DataFrame, keys: Sequence[str] = ("Year", "GrandPrix", "SessionType", "Driver")) -> DataFrame:
    """Start and end of every lap in session seconds (JOIN2).

    A pit lap ends at pit entry, another one its lap time after the start; laps with neither are left out.
    """
    start = duration_seconds(F.col("LapStartTime"))
    pit_in = F.when(F.col("DidPit"), F.col("PitInTime"))
    end = F.coalesce(duration_seconds(pit_in), start + F.col("LapTimeSeconds"))
    # told from the stored columns, so that the times are worked out once and not again for the filter
    usable = is_duration(F.col("LapStartTime")) & (F.col("LapTimeSeconds").isNotNull() | is_duration(pit_in))
    return laps.filter(usable).select(*keys, "LapNumber", start.alias("StartSeconds"), end.alias("EndSeconds"))


def _ticks(df: DataFrame, name: str) -> Column:
    """Microseconds since the start of the clock; numbers are taken as seconds."""
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.round(F.col(name).cast("double") * 1e6).cast("long")


def _cover(spans: DataFrame, levels: int) -> Column:
    """The aligned power-of-two blocks that together make up ``[_s, _e]``; at most two per level."""

    def blocks(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first = F.call_function("shiftright", F.col("_s") + width - 1, k)
        stop = F.call_function("shiftright", F.col("_e") + 1, k)
        left = F.when((first < stop) & (first.bitwiseAND(F.lit(1).cast("long")) == 1), F.struct(k.alias("level"), first.alias("block")))
        right = F.when((first < stop) & (stop.bitwiseAND(F.lit(1).cast("long")) == 1), F.struct(k.alias("level"), (stop - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), blocks))


def disjoint_segments(spans: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Cut spans ``[_s, _e]`` into segments, each with the smallest payload that covers it.

    Returns keys, ``_at`` (segment start) and ``_payload`` (null where nothing covers the segment). Keys
    whose spans follow one another are read off directly; the others go through ``_overlapping``.
    """
    earlier = scan(
        spans, keys, [F.col("_s"), F.col("_e")], last_before={"_before": F.struct("_e", F.col(payload).alias("p"))}
    )
    end, held = F.col("_before._e"), F.col("_before.p")
    touching = (F.col("_s") == end) & (held <= F.col(payload)) & (F.col("_s") < F.col("_e"))
    follows = F.coalesce((F.col("_s") > end) | touching, F.col("_before").isNull())
    placed = settle(
        earlier.select(
            *keys, "_s", "_e", F.col(payload).alias("_p"), F.coalesce(touching, F.lit(False)).alias("_touch"), (~follows).alias("_clash")
        )
    )
    clashing = placed.filter("_clash").select(*keys).distinct()
    starts = F.col("_s") + F.col("_touch").cast("long")
    edge = F.explode(
        F.array(
            F.struct(starts.alias("_at"), F.col("_p").alias("_payload")),
            F.struct((F.col("_e") + 1).alias("_at"), F.lit(None).cast(spans.schema[payload].dataType).alias("_payload")),
        )
    ).alias("_x")

    def chained(rows: DataFrame) -> DataFrame:
        return rows.select(*keys, edge).groupBy(*keys, "_x._at").agg(F.min("_x._payload").alias("_payload"))

    if clashing.isEmpty():
        return chained(placed)
    return chained(placed.join(clashing, list(keys), "left_anti")).unionByName(
        _overlapping(placed.join(clashing, list(keys), "left_semi"), keys)
    )


def _overlapping(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments of spans that overlap, without pairing spans that cover a common stretch.

    Every span is written as a few aligned blocks, a block keeps its smallest payload, and a segment
    start looks up the blocks it lies in.
    """
    longest = spans.agg(F.max(F.col("_e") - F.col("_s"))).first()[0]
    levels = int(longest + 1).bit_length()
    blocks = (
        spans.select(*keys, "_p", F.inline(_cover(spans, levels)))
        .groupBy(*keys, "level", "block")
        .agg(F.min("_p").alias("_p"))
    )
    edges = spans.select(*keys, F.explode(F.array(F.col("_s"), F.col("_e") + 1)).alias("_at")).distinct()
    looked_up = edges.select(*keys, "_at", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn(
        "block", F.expr("shiftright(_at, level)")
    )
    return (
        looked_up.join(blocks, [*keys, "level", "block"], "left")
        .groupBy(*keys, "_at")
        .agg(F.min("_p").alias("_payload"))
    )


def assign_interval(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    t: str,
    start: str,
    end: str,
    payload: str,
    mode: str = "closed",
    name: str | None = None,
) -> DataFrame:
    """Give every point the payload of the span it falls in, null when none does (JOIN1).

    mode="closed"  start <= t <= end; the smallest payload wins where spans overlap
    mode="half"    start <= t < end; the same rule
    mode="asof"    the span that started last, if it has not ended; for spans that do not overlap

    Times are timestamps or seconds and are compared in microseconds. Points and span edges are merged
    in time order per key and the last edge is carried forward, so points and spans are not paired.
    """
    name = name or payload
    if mode != "asof":
        return assign_segments(points, span_segments(spans, keys, start, end, payload, mode), keys, t, name)
    clean = _clean_spans(spans, keys, start, end, payload)
    edges = (
        clean.groupBy(*keys, F.col("_s").alias("_at"))
        .agg(F.min(F.struct(F.col(payload).alias("p"), F.col("_e").alias("until"))).alias("_edge"))
    )
    return _carried(points, edges, keys, t, lambda edge: F.col("_at") <= edge["until"], name)


def _clean_spans(spans: DataFrame, keys: Sequence[str], start: str, end: str, payload: str, mode: str = "closed") -> DataFrame:
    """Keys, ``_s`` and ``_e`` (both ends included) in microseconds, and the payload of spans that cover something."""
    # spans are few next to points; written once, their times are computed once
    timed = settle(
        spans.select(*keys, _ticks(spans, start).alias("_s"), _ticks(spans, end).alias("_e"), F.col(payload))
    ).dropna(subset=[*keys, "_s", "_e"])
    if mode == "half":
        timed = timed.withColumn("_e", F.col("_e") - 1)
    return timed.filter(F.col("_s") <= F.col("_e"))


def span_segments(spans: DataFrame, keys: Sequence[str], start: str, end: str, payload: str, mode: str = "closed") -> DataFrame:
    """Keys, ``_at`` and ``_payload`` of the stretches that spans cut their key's time into; a written table.

    May be kept and looked up by ``assign_segments`` as often as wanted.
    """
    return settle(disjoint_segments(_clean_spans(spans, keys, start, end, payload, mode), keys, payload))


def assign_segments(points: DataFrame, segments: DataFrame, keys: Sequence[str], t: str, name: str) -> DataFrame:
    """Every point with the payload of the segment that it lies in, null before the first one."""
    edges = segments.select(*keys, "_at", F.struct(F.col("_payload").alias("p")).alias("_edge"))
    return _carried(points, edges, keys, t, lambda edge: F.lit(True), name)


def _carried(points: DataFrame, edges: DataFrame, keys: Sequence[str], t: str, live: Callable[[Column], Column], name: str) -> DataFrame:
    """Points and edges merged in time order, the last edge carried forward to the points."""
    kept = [c for c in points.columns if c != name]
    marked = points.select(*kept).withColumns({"_at": _ticks(points, t), "_point": F.lit(1)})
    merged = marked.unionByName(edges.withColumn("_point", F.lit(0)), allowMissingColumns=True)
    carried = scan(merged, keys, [F.col("_at"), F.col("_point")], last={"_last": F.col("_edge")})
    edge = F.col("_last")
    inside = F.col("_at").isNotNull() & live(edge)
    return carried.filter(F.col("_point") == 1).select(*kept, F.when(inside, edge["p"]).alias(name))


def assign_laps(
    samples: DataFrame,
    spans: DataFrame,
    keys: Sequence[str] = ("Year", "GrandPrix", "SessionType", "Driver"),
    keep_existing: bool = True,
    mode: str = "closed",
    segmented: bool = False,
) -> DataFrame:
    """LapNumber of car or position samples from their session time (JOIN1 on JOIN2; PRJ8).

    A sample outside all laps keeps the lap number it came with, unless ``keep_existing`` is False. With ``segmented``,
    ``spans`` are the segments that ``lap_segments`` gave.
    """
    timed = samples.withColumn("_t", duration_seconds(F.col("Time")))
    if segmented:
        found = assign_segments(timed, spans, keys, "_t", "_lap").drop("_t")
    else:
        found = assign_interval(
            timed, spans, keys, "_t", "StartSeconds", "EndSeconds", "LapNumber", mode=mode, name="_lap"
        ).drop("_t")
    if "LapNumber" in samples.columns and keep_existing:
        return found.withColumn("LapNumber", F.coalesce("_lap", "LapNumber")).select(*samples.columns)
    return found.withColumn("LapNumber", F.col("_lap")).drop("_lap")


def lap_segments(laps: DataFrame, keys: Sequence[str] = ("Year", "GrandPrix", "SessionType", "Driver")) -> DataFrame:
    """The stretches of time that the laps of every driver cut a session into, to be kept beside the laps."""
    return span_segments(lap_spans(laps, keys), keys, "StartSeconds", "EndSeconds", "LapNumber")
