"""Joining two sample series by position, by proportion or by time (JOIN14, JOIN15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import fill_speed, scan, settle


def zip_align(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_order: Sequence[Column],
    right_order: Sequence[Column],
    right_columns: Sequence[str],
    fill: str | None = None,
) -> DataFrame:
    """Pair the i-th left row of a key with its i-th right row; ``fill`` carries a column past the end (JOIN14).

    Row numbers are per key and the join is on (key, row number), which spreads a big key.
    """
    numbered = scan(left, keys, left_order, number="_i")
    other = scan(right, keys, right_order, number="_i").select(*keys, "_i", *right_columns)
    paired = numbered.join(other, [*keys, "_i"], "left")
    if fill:
        # written once: the fill reads it several times, and it took two numberings and a join to make
        paired = fill_speed(settle(paired), fill, keys, [F.col("_i")])
    return paired.select(*left.columns, F.col("_i").alias("row_number"), *right_columns)


def proportional_align(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_order: Sequence[Column],
    right_order: Sequence[Column],
    right_columns: Sequence[str],
) -> DataFrame:
    """Pair left frame i of n with the right row at the same share of its series (JOIN15)."""
    frames = scan(left, keys, left_order, number="_i", count="_n")
    rows = scan(right, keys, right_order, number="_j").select(*keys, "_j", *right_columns)
    sizes = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    frame = F.col("_i") - 1
    target = F.least(F.floor(frame / F.col("_n") * F.col("_m")), F.col("_m") - 1) + 1
    return (
        frames.join(sizes, list(keys), "left")
        .withColumns({"_j": target, "frame": frame})
        .join(rows, [*keys, "_j"], "left")
        .select(*left.columns, "frame", *right_columns)
    )


def asof_align(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    right_columns: Sequence[str],
) -> DataFrame:
    """Pair every left row with the right row that came last at or before it (time form of JOIN14)."""
    newest = right.groupBy(*keys, F.col(right_time).alias("_at")).agg(
        F.max(F.struct(*right_columns)).alias("_row")
    )
    points = left.withColumns({"_at": F.col(left_time), "_side": F.lit(1)})
    merged = points.unionByName(newest.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    carried = scan(merged, keys, [F.col("_at"), F.col("_side")], last={"_last": F.col("_row")})
    return carried.filter(F.col("_side") == 1).select(
        *left.columns, *[F.col("_last")[c].alias(c) for c in right_columns]
    )
