"""Writing topics, tables and files (SNK1-SNK7)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import bucketed, cuts, order_value, settle

#: rows per insert call of the row writer; fixed value.
INSERT_BATCH = 1000


def to_envelope(df: DataFrame) -> DataFrame:
    """Every row as one JSON text in ``value`` (SNK1)."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def publish(
    df: DataFrame, topic: str, sink: str = "kafka", *, servers: str = "kafka:9092", path: str | None = None, lines_per_file: int = 0
) -> None:
    """Send rows to a topic, or to compressed JSON-lines files with ``sink="files"`` (SNK1).

    A compressed file is read by one task; ``lines_per_file`` bounds it, without it a task writes one file.
    """
    envelope = to_envelope(df)
    if sink == "kafka":
        envelope.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    else:
        envelope.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", lines_per_file).text(path)


def interleaved(df: DataFrame, columns: Sequence[str], name: str, bits: int = 8) -> DataFrame:
    """``df`` with a number whose bits are taken in turn from the places of its columns among their quantiles.

    Rows that are near in all columns get near numbers, so files sorted by it have narrow ranges of every column, not of
    the first one alone. Columns have up to 2 ** ``bits`` places; their borders are lists of so many numbers.
    """
    places = []
    for i, c in enumerate(columns):
        at, place = f"_q{i}", f"_b{i}"
        df = df.withColumn(at, order_value(df, F.col(c)))
        df = bucketed(df, at, cuts(df.select(at), at, 1 << bits), place).drop(at)
        places.append(F.col(place).cast("long"))
    number = F.lit(0).cast("long")
    for bit in range(bits):
        for i, place in enumerate(reversed(places)):
            number = number + F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(places) + i)
    return df.withColumn(name, number).drop(*(f"_b{i}" for i in range(len(columns))))


def write_session_table(
    df: DataFrame,
    path: str,
    sort: Sequence[str] = ("Driver", "LapNumber", "Time"),
    mode: str = "append",
    cluster: Sequence[str] = (),
    bloom: Mapping[str, int] | None = None,
    row_group_bytes: int | None = None,
) -> None:
    """Parquet laid out by session and sorted inside the files, in place of secondary indexes (SNK5).

    Ranges are cut along session and sort columns, so that a big session is several files. With ``cluster`` the rows of a
    session are in the order of the interleaved bits of these columns, so that a lookup by any of them skips row groups.
    ``bloom`` names columns, each with about how many values a row group has, that get a Bloom filter per row group: a
    lookup of one value over all sessions reads the groups that hold it, and hardly any other.
    """
    keys = [c for c in ("Year", "GrandPrix", "SessionType") if c in df.columns]
    inner = [c for c in sort if c in df.columns]
    if cluster:
        # written once for its quantiles; also, Spark sorts anew, and not by the place, if it knows a session column as a constant
        df, inner = interleaved(settle(df), cluster, "_place"), ["_place", *inner]
    ordered = df.repartitionByRange(*keys, *inner).sortWithinPartitions(*keys, *inner).drop("_place")
    writer = ordered.write.mode(mode).partitionBy(*keys)
    for column, values in (bloom or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True).option(f"parquet.bloom.filter.expected.ndv#{column}", values)
    if row_group_bytes:
        # sizes are looked at often enough for small groups to come out small
        writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.block.size.row.check.max", 1000)
    writer.parquet(path)


def write_batch(df: DataFrame, batch_id: int, path: str, within: Sequence[str] = ()) -> None:
    """Micro-batch to its own partition; a repeated batch replaces itself instead of duplicating (SNK2).

    ``within`` are columns to partition by first, such as the session, so that readers of a session skip the others. Their
    rows are brought together, so that a batch leaves some files per partition and not one of every task in each; adaptive
    execution deals a large partition to several tasks.
    """
    if within:
        df = df.hint("rebalance", *within)
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*within, "batch_id").parquet(path)


def partition_values(df: DataFrame, columns: Sequence[str]) -> list[Row]:
    """The distinct values of partition columns in a micro-batch, at most one per row of it."""
    return df.select(*columns).distinct().collect()


def read_partitions(spark: SparkSession, path: str, schema: T.StructType, values: Sequence[Row]) -> DataFrame:
    """The given partitions of a table, by a filter of literals that prunes all others; empty if there is no such table.

    Only the folders of the first partition column that occur are listed.
    """
    if not values:
        return spark.createDataFrame([], schema)
    columns = values[0].__fields__
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tops = [f"{path}/{columns[0]}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for v in sorted({v[0] for v in values}, key=str)]
    tops = [top for top in tops if files.exists(jvm.org.apache.hadoop.fs.Path(top))]
    if not tops:
        return spark.createDataFrame([], schema)
    one_of = F.lit(False)
    for row in values:
        same = F.lit(True)
        for c in columns:
            same &= F.col(c).eqNullSafe(F.lit(row[c]).cast(schema[c].dataType))
        one_of |= same
    return spark.read.schema(schema).option("basePath", path).parquet(*tops).filter(one_of)


def unseen(rows: DataFrame, batch_id: int, path: str, within: Sequence[str], key: str = "RecordId", run: str = "") -> DataFrame:
    """The rows of a batch whose ``key`` the table does not hold yet in their own partitions, each key once (STR4 with SNK2).

    The table is one that ``write_batch`` writes with the columns ``within`` and ``run``, so a topic that is read again
    from its start, by a query with a new checkpoint and so a new ``run``, adds nothing. What the batch itself wrote when it
    was tried before does not count. Rows without a key are all new. The first column of ``within`` is a number or null.
    """
    spark = rows.sparkSession
    fields = [rows.schema[c] for c in (*within, key)]
    schema = T.StructType([*fields, T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())])
    stored = read_partitions(spark, path, schema, partition_values(rows, within))
    before = stored.filter((F.col("run") != run) | (F.col("batch_id") < batch_id)).select(*within, key)
    named = before.toDF(*(f"_{c}" for c in before.columns))
    same = F.col(key) == F.col(f"_{key}")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = rows.filter(F.col(key).isNotNull()).join(named, same, "left_anti").dropDuplicates([*within, key])
    return known.unionByName(rows.filter(F.col(key).isNull()))


def read_version(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Newest version of a small state table that is written whole by ``write_batch``, empty if there is none.

    ``before`` leaves out a batch's own version, so that a repeated batch starts from what the first attempt had.
    """
    try:
        versions = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if before is not None:
        versions = versions.filter(F.col("batch_id") < before)
    newest = versions.agg(F.max("batch_id").alias("b"))
    empty = spark.createDataFrame([], schema)
    return versions.filter(F.col("batch_id") == newest.scalar()).select(*empty.columns)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions in a folder, ascending, by one listing; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return sorted(int(f.getPath().getName()[9:]) for f in files.listStatus(folder) if f.getPath().getName().startswith("batch_id="))


def prune_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest versions of a state table; two are enough to repeat the last batch."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for number in versions(spark, path)[:-keep]:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={number}"), True)


def insert_rows(df: DataFrame, connect: Callable[[], object], insert: Callable[[object, list[dict]], None]) -> None:
    """Rows to an external store from the tasks, in groups of 1000 (SNK2).

    ``connect`` opens a client in the task; ``insert`` must upsert by RecordId, since tasks may be retried.
    """

    def send(rows: Iterator[Row]) -> Iterable:
        client = None
        while group := [r.asDict(recursive=True) for r in islice(rows, INSERT_BATCH)]:
            client = client or connect()
            insert(client, group)

    df.foreachPartition(send)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header (SNK3)."""
    df.write.mode(mode).option("header", True).csv(path)


def prediction_documents(predictions: DataFrame, timestamp: str | Column, race: str = "GrandPrix", per_document: int = 1000) -> DataFrame:
    """``{race, timestamp, place, predictions: [...]}``, documents per race and predicted place (SNK4).

    A document holds predictions that share a place, ordered by all their columns; a race's documents in order of ``place``
    are its whole prediction. A place that more than ``per_document`` rows share has so many documents that each has about
    that many of them, dealt by a digest of the row, so a document stays small however many rows a race or a place has.
    """
    entry = F.struct(*predictions.columns)
    named = predictions.select(F.col(race).alias("race"), F.col("PredictedPosition").alias("place"), entry.alias("_row"))
    sizes = named.groupBy("race", "place").agg(F.ceil(F.count(F.lit(1)) / per_document).alias("_parts"))
    large = sizes.filter("_parts > 1").select(F.col("race").alias("_race"), F.col("place").alias("_place"), "_parts")
    same = F.col("race").eqNullSafe(F.col("_race")) & F.col("place").eqNullSafe(F.col("_place"))
    dealt = named.join(large, same, "left").withColumn("part", F.pmod(F.xxhash64(F.to_json("_row")), F.coalesce("_parts", F.lit(1))).cast("int"))
    return (
        dealt.groupBy("race", "place", "part")
        .agg(F.array_sort(F.collect_list("_row")).alias("predictions"))
        .select("race", (F.lit(timestamp) if isinstance(timestamp, str) else timestamp).alias("timestamp"), "place", "predictions")
    )


def write_predictions(predictions: DataFrame, path: str, timestamp: str) -> None:
    """CSV and JSON documents of a prediction (SNK3, SNK4)."""
    write_csv(predictions, f"{path}/csv/{timestamp}")
    prediction_documents(predictions, timestamp).write.mode("append").json(f"{path}/json")


def dead_letters(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a check, and the others unchanged (SNK6)."""
    passed = F.coalesce(valid, F.lit(False))
    return df.filter(passed), df.filter(~passed)


def unless_empty(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch function that is skipped for empty batches (SNK7)."""

    def guarded(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write(batch, batch_id)

    return guarded
