"""Experiment runs: tables, rankings, correlation, error distribution (AGG16-AGG19, SRT4, SRT6, MLP10-MLP12)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import title_case
from ..functions.records import epoch_millis, run_minutes


def experiments(runs: DataFrame) -> DataFrame:
    """Runs per experiment and their first and last time (AGG16)."""
    return runs.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("total_runs"),
        epoch_millis(F.min("start_time")).alias("created"),
        epoch_millis(F.max(F.coalesce("end_time", "start_time"))).alias("last_modified"),
    )


def latest_versions(models: DataFrame) -> DataFrame:
    """Highest version number per model (AGG17)."""
    return models.groupBy("model").agg(F.max(F.col("version").try_cast("int")).alias("latest_version"))


def run_table(runs: DataFrame) -> DataFrame:
    """One row per run with its headline metrics (MLP10)."""
    metric = lambda name: F.try_element_at(F.col("metrics"), F.lit(name))
    return runs.select(
        F.concat(F.substring("run_id", 1, 8), F.lit("...")).alias("run_label"),
        F.coalesce("run_name", F.lit("Unnamed")).alias("run_name"),
        "status",
        epoch_millis(F.col("start_time")).alias("start_time"),
        run_minutes(F.col("start_time"), F.col("end_time")).alias("duration_min"),
        F.coalesce("race_name", F.lit("Unknown")).alias("race_name"),
        metric("r2_score").alias("r2_score"),
        metric("rmse").alias("rmse"),
        metric("position_accuracy_within_2").alias("position_accuracy"),
        "run_id",
    )


def long_metrics(runs: DataFrame) -> DataFrame:
    """One row per run and metric."""
    return runs.select("run_id", "run_name", "race_name", F.explode("metrics").alias("metric", "value")).filter(
        F.col("value").isNotNull()
    )


def wide_metrics(runs: DataFrame, names: Sequence[str], *columns: str) -> DataFrame:
    """The named metrics as columns (MLP10)."""
    return runs.select(
        "run_id", *columns, *[F.try_element_at(F.col("metrics"), F.lit(n)).alias(n) for n in names]
    )


def run_details(runs: DataFrame) -> DataFrame:
    """Parameters, metrics (4 places) and tags of runs as key / value rows (MLP12)."""
    numbers = F.transform_values("metrics", lambda _, v: F.bround(v, 4).cast("string"))
    kinds = [("param", F.col("params")), ("metric", numbers), ("tag", F.col("tags"))]
    parts = [
        runs.select("run_id", F.lit(kind).alias("kind"), F.explode(entries).alias("name", "value"))
        for kind, entries in kinds
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def top_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    """Best k runs of every metric (SRT4). The row-number bound is applied before the shuffle."""
    by_metric = Window.partitionBy("metric").orderBy(F.desc("value"), F.asc("run_id"))
    ranked = long_metrics(runs).withColumn("place", F.row_number().over(by_metric)).filter(F.col("place") <= k)
    return ranked.withColumn("title", F.concat(title_case(F.col("metric")), F.lit(" Comparison")))


def top_by_metric(wide: DataFrame, metric: str, k: int = 5) -> DataFrame:
    """Best k runs of one metric, runs without it dropped."""
    return wide.dropna(subset=[metric]).orderBy(F.desc(metric), F.asc("run_id")).limit(k)


def metric_comparison(runs: DataFrame, metrics: Sequence[str], k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Best runs of the chosen metrics, and their correlation matrix (PIPE14)."""
    chosen = runs.withColumn("metrics", F.map_filter("metrics", lambda name, _: name.isin(*metrics)))
    return top_runs(chosen, k), correlation_matrix(wide_metrics(runs, metrics), metrics)


def recent_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    """Newest k runs of every experiment (SRT6)."""
    newest = Window.partitionBy("experiment").orderBy(F.desc("start_time"), F.asc("run_id"))
    return runs.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= k)


def correlation_matrix(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation in long form, one pass (AGG18)."""
    def pair(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.corr(F.when(both, F.col(a)), F.when(both, F.col(b)))

    cells = [(a, b, f"c{i}") for i, (a, b) in enumerate(product(metrics, metrics))]
    one_row = wide.agg(*[pair(a, b).alias(n) for a, b, n in cells])
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(n).alias("correlation"))
            for a, b, n in cells
        ]
    )
    return one_row.select(F.inline(entries))


def prediction_quality(scored: DataFrame, label: str, prediction: str = "prediction", group: Sequence[str] = ()) -> DataFrame:
    """Within-two share, podium agreement, r2 (null if all labels are alike), rmse and mae in one aggregation (AGG19)."""
    y, p = F.col(label), F.col(prediction)
    error = p - y
    share = lambda test: F.avg(test.cast("double"))
    return scored.groupBy(*group).agg(
        (1 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("r2_score"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        share(F.abs(error) <= 2).alias("position_accuracy_within_2"),
        share((y <= 3) == (p <= 3)).alias("podium_prediction_accuracy"),
    )


def error_histogram(scored: DataFrame, label: str, prediction: str = "prediction", bins: int = 20) -> DataFrame:
    """Counts of the residuals in equal-width bins from smallest to largest (MLP11)."""
    residuals = scored.select((F.col(prediction) - F.col(label)).alias("residual"))
    ends = residuals.agg(F.struct(F.min("residual").alias("low"), F.max("residual").alias("high")).alias("ends"))
    framed = residuals.withColumn("ends", ends.scalar())
    low, high = F.col("ends.low"), F.col("ends.high")
    flat = low == high
    low, high = F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)
    width = (high - low) / bins
    bin_of = F.least(F.floor((F.col("residual") - low) / width), F.lit(bins - 1)).cast("int")
    return framed.filter(F.col("residual").isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
