"""Reading topics, tables and files (SRC1-SRC9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durations import to_double
from ..functions.records import as_bit
from ..schemas import CIRCUITS_RAW, PREDICTION_DOCUMENT, TOPICS

#: topic -> most records taken per trigger; fixed values.
ADMISSION = {
    "telemetry-data": 10000,
    "car-telemetry-data": 50000,
    "car-position-data": 50000,
    "driver-info-data": 10000,
    "race-results-data": 10000,
    "weather-data": 10000,
}


def read_topic(
    spark: SparkSession,
    topic: str,
    source: str = "kafka",
    *,
    servers: str = "kafka:9092",
    path: str | None = None,
    max_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of a topic's values as text in a column ``value`` (SRC1, STR2).

    ``source="files"`` reads one JSON record per line from ``path`` with the same admission control in files.
    """
    if source == "kafka":
        return (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", "earliest")
            .option("failOnDataLoss", "false")
            .option("maxOffsetsPerTrigger", max_per_trigger or ADMISSION[topic])
            .load()
            .select(F.col("value").cast("string").alias("value"))
        )
    return spark.readStream.option("maxFilesPerTrigger", max_per_trigger or 1).text(path)


def decode(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON envelope to columns; text that is no JSON object goes to ``_corrupt_record`` (SRC2)."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return df.select(F.from_json(F.col(value).cast("string"), with_bad, options).alias("data")).select("data.*")


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded rows, and the ones that could not be decoded (SNK6)."""
    bad = F.col("_corrupt_record").isNotNull()
    return df.filter(~bad).drop("_corrupt_record"), df.filter(bad).select("_corrupt_record")


def decoded_topic(spark: SparkSession, topic: str, **kw) -> DataFrame:
    return decode(read_topic(spark, topic, **kw), TOPICS[topic][1])


def scan_session(
    df: DataFrame,
    columns: Sequence[str],
    year: int | None = None,
    grand_prix: str | None = None,
    session_type: str | None = None,
    **equals: object,
) -> DataFrame:
    """Filtered projection of a table laid out by session; filters reach the partitions and the file scan (SRC3)."""
    wanted = {"Year": year, "GrandPrix": grand_prix, "SessionType": session_type, **equals}
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df.select(*columns)


def read_circuits(spark: SparkSession, path: str, year: int) -> DataFrame:
    """Circuit documents flattened, coordinates as numbers (SRC5)."""
    return flatten_circuits(spark.read.schema(CIRCUITS_RAW).option("multiLine", True).json(path), year)


def flatten_circuits(raw: DataFrame, year: int | Column) -> DataFrame:
    return raw.select(
        (F.lit(year) if isinstance(year, int) else year).alias("year"),
        "circuitId",
        "circuitName",
        "url",
        to_double(F.col("Location.lat")).alias("latitude"),
        to_double(F.col("Location.long")).alias("longitude"),
        F.col("Location.locality").alias("locality"),
        F.col("Location.country").alias("country"),
    )


def new_circuits(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched circuits of the years not stored yet (SRC5)."""
    return fetched.join(stored.select("year").distinct(), "year", "left_anti")


def seasons_of_event(
    tables: dict[str, DataFrame], schedule: DataFrame, race: str, years: Sequence[int]
) -> dict[str, DataFrame]:
    """Race-session rows of one event over several seasons, event names per season (SRC6).

    The event of a season is the first whose name contains ``race``; seasons without one drop out.
    """
    hit = F.lower("EventName").contains(race.lower()) & F.col("Year").isin(*years)
    events = (
        schedule.filter(hit)
        .groupBy("Year")
        .agg(F.min_by("EventName", "RoundNumber").alias("GrandPrix"))
        .withColumn("SessionType", F.lit("Race"))
    )
    # the years also go to the scan, so that partitions of other seasons are not read
    return {
        name: df.filter(F.col("Year").isin(*years)).join(events, ["Year", "GrandPrix", "SessionType"], "left_semi")
        for name, df in tables.items()
    }


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Saved prediction documents, newest first; unreadable files are skipped (SRC7).

    Documents of one time are ordered by race and a digest, so that a saved prediction is sorted by many tasks.
    """
    return (
        spark.read.schema(PREDICTION_DOCUMENT)
        .option("mode", "DROPMALFORMED")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .orderBy(F.desc("timestamp"), "race", F.xxhash64("predictions"))
    )


def expand_predictions(documents: DataFrame) -> DataFrame:
    """One row per predicted driver (SRC7)."""
    return documents.select("race", "timestamp", F.inline("predictions"))


def typed(df: DataFrame, types: dict[str, str], bits: Sequence[str] = ("HadRainfall",)) -> DataFrame:
    """Columns with explicit types: numbers that do not parse become null, rain flags 0/1 (SRC8)."""
    out = {c: to_double(F.col(c)) if t == "double" else F.col(c).try_cast(t) for c, t in types.items()}
    out |= {c: as_bit(F.col(c)) for c in bits if c in df.columns}
    return df.withColumns(out)
