"""The six streaming queries (STR1-STR4, STR6, SNK2, SNK6-SNK8).

Every micro-batch is a lazy plan over the batch and the serving tables; only the names of its sessions are collected, to read
no other partitions. A batch that is tried again replaces what it wrote, and a topic that is read again from its start
adds nothing.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import AccumulatorParam, TaskContext
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.records import default_session, record_id
from ..operators.intervals import lap_segments
from ..operators.lookup import extend_ids
from ..operators.ordered import enter_scope, numbered, scratch, scratch_scope, settle
from ..operators.partials import merged_sessions, session_partials
from ..plans import records
from ..schemas import LAPS, TOPICS
from ..sources.readers import decode, read_topic, split_corrupt
from ..sources.writers import partition_values, prune_versions, read_partitions, read_version, unless_empty, unseen, versions, write_batch

#: topic -> seconds between triggers; fixed values.
TRIGGER_SECONDS = {
    "telemetry-data": 10,
    "car-telemetry-data": 5,
    "car-position-data": 5,
    "driver-info-data": 10,
    "race-results-data": 10,
    "weather-data": 10,
}
_TEAM_IDS = "TeamName STRING, TeamID INT"
_LAST_KNOWN = "Year INT, GrandPrix STRING, SessionType STRING, Driver STRING, seen DOUBLE, known STRING"
SESSION = ("Year", "GrandPrix", "SessionType")
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class JobSettings:
    """Where the tables and checkpoints live, and how topics are read.

    ``tables`` and ``checkpoints`` are folders every executor reaches. ``once`` handles what is there and stops.
    All queries over one folder of tables run in one driver process, as the team ids have one writer.
    """

    tables: str
    checkpoints: str
    source: str = "kafka"
    servers: str = "kafka:9092"
    paths: dict[str, str] = field(default_factory=dict)
    once: bool = False
    max_per_trigger: int | None = None
    #: table -> a further step on its enriched rows, of the user's own
    extra: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


def serving_table(spark: SparkSession, settings: JobSettings, name: str, schema: T.StructType) -> DataFrame:
    """A serving table as it is now, empty with the topic schema before its first batch."""
    try:
        return spark.read.parquet(f"{settings.tables}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


_ONE_WRITER = threading.Lock()


def grow_team_ids(names: DataFrame, name: str, settings: JobSettings) -> DataFrame:
    """The team dictionary after the names of a batch; ids never change (STR6).

    Laps, results and driver records all bring names. Their queries run in one driver process and take turns here, so
    the dictionary has one writer; names that are known, as in a repeated batch, make no new version.
    """
    spark, path = names.sparkSession, f"{settings.tables}/team_ids"
    with _ONE_WRITER:
        known = read_version(spark, path, _TEAM_IDS)
        grown = settle(extend_ids(known, names.select(F.col(name).alias("TeamName")).distinct(), "TeamName", "TeamID"))
        if grown.count() > known.count():
            write_batch(grown, max(versions(spark, path), default=-1) + 1, path)
            prune_versions(spark, path, keep=3)
    return grown


def sessions_of(batch: DataFrame) -> list[Row]:
    """The sessions of a micro-batch; at most one per record, and the admission limit bounds those."""
    return partition_values(batch, SESSION)


def _session_id() -> Column:
    """A name for a session that needs no escaping as a folder."""
    return F.md5(F.to_json(F.struct(*SESSION), {"ignoreNullFields": "false"}).cast("binary"))


def _session_folders(spark: SparkSession, sessions: list[Row]) -> list[str]:
    schema = T.StructType([LAPS[c] for c in SESSION])
    named = spark.createDataFrame([tuple(r) for r in sessions], schema).select(_session_id().alias("id"))
    return sorted(r.id for r in named.collect())


_SEGMENT = T.StructType([LAPS[c] for c in (*SESSION, "Driver")] + [T.StructField("_at", T.LongType()), T.StructField("_payload", T.DoubleType())])


def segments_of(spark: SparkSession, settings: JobSettings, sessions: list[Row]) -> DataFrame:
    """The newest segments of the laps of some sessions (STR3); the folders of other sessions are neither listed nor read."""
    path = f"{settings.tables}/lap_segments"
    kept = T.StructType([*_SEGMENT.fields, T.StructField("session", T.StringType()), T.StructField("batch_id", T.LongType())])
    newest = {name: found[-1] for name in _session_folders(spark, sessions) if (found := versions(spark, f"{path}/session={name}"))}
    if not newest:
        return spark.createDataFrame([], _SEGMENT)
    folders = [f"{path}/session={name}/batch_id={number}" for name, number in newest.items()]
    table = spark.read.schema(kept).option("basePath", path).parquet(*folders)
    return table.filter(F.col("session").isin(*newest)).select(*_SEGMENT.names)


def extend_segments(spark: SparkSession, settings: JobSettings, batch: DataFrame) -> None:
    """Keep the segments beside the laps up to date after a batch of laps.

    A version of a session's segments holds all its drivers: those of drivers in the batch are made anew from their stored
    laps, the others are taken over. Readers use a version that is complete; the one before it stays for them.
    """
    path = f"{settings.tables}/lap_segments"
    sessions = sessions_of(batch)
    drivers = settle(batch.select(*SESSION, "Driver").distinct())
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"x.{c}")) for c in (*SESSION, "Driver")]
    matched = reduce(Column.__and__, same)
    laps = read_partitions(spark, f"{settings.tables}/telemetry", _derived_laps(), sessions)
    touched = lap_segments(laps.alias("x").join(drivers.alias("d"), matched, "left_semi"), (*SESSION, "Driver"))
    others = segments_of(spark, settings, sessions).alias("x").join(drivers.alias("d"), matched, "left_anti")
    folders = _session_folders(spark, sessions)
    number = max((n for name in folders for n in versions(spark, f"{path}/session={name}")), default=-1) + 1
    write_batch(others.unionByName(touched).withColumn("session", _session_id()), number, path, ["session"])
    for name in folders:
        prune_versions(spark, f"{path}/session={name}")


def _enriched(table: str, rows: DataFrame, batch_id: int, settings: JobSettings, ids: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The table rows of a batch, and for laps the state after it; writes nothing."""
    spark = rows.sparkSession
    drivers = lambda: serving_table(spark, settings, "driver_info", TOPICS["driver-info-data"][1])
    if table == "telemetry":
        known = read_version(spark, f"{settings.tables}/last_known", _LAST_KNOWN, before=batch_id)
        return records.laps_batch(rows, ids, known)
    if table in ("car_telemetry", "car_position"):
        make = records.car_samples if table == "car_telemetry" else records.positions
        return make(rows, drivers(), ids, segments_of(spark, settings, sessions_of(rows)), segmented=True), None
    if table == "driver_info":
        return records.driver_info(rows, ids), None
    if table == "race_results":
        return records.results(rows, ids), None
    return records.weather(rows), None


def _team_ids(table: str, rows: DataFrame, settings: JobSettings) -> DataFrame:
    name = {"telemetry": "Team", "driver_info": "TeamName", "race_results": "TeamName"}.get(table)
    if name:
        return grow_team_ids(rows, name, settings)
    return read_version(rows.sparkSession, f"{settings.tables}/team_ids", _TEAM_IDS)


def _derived_laps() -> T.StructType:
    return T.StructType([*LAPS.fields, T.StructField("DidPit", T.BooleanType()), T.StructField("LapTimeSeconds", T.DoubleType())])


def identified(rows: DataFrame) -> DataFrame:
    """Records with a RecordId: their own, or a digest of all they say, by which a record that is sent again is known."""
    own = F.col("RecordId") if "RecordId" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("RecordId", F.coalesce(own, record_id(*[c for c in rows.columns if c != "RecordId"])))


#: a part that fails is cut into so many; fixed value.
PIECES = 8


def _failing_parts(blocks: DataFrame, parts: list[int], size: int, attempt: Callable[[DataFrame], None]) -> list[int] | None:
    """Those of some parts of ``size`` rows that ``attempt`` fails with, by one run of it; None if this cannot be told.

    Every part is one task. A task that failed is tried again: it gets no rows then and reports its part, so the run goes on
    with the others. Where a task that fails ends the run, as with ``local[8]`` or in a step past a shuffle, there is no answer.
    """
    spark = blocks.sparkSession

    class Numbers(AccumulatorParam):  # a class of this function, as one of the module would have every new Python worker import it
        def zero(self, value: set) -> set:
            return set()

        def addInPlace(self, value: set, more: set) -> set:
            return value | more

    found = spark.sparkContext.accumulator(set(), Numbers())

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().attemptNumber() == 0
        for batch in batches:
            if first:
                yield batch
            else:
                found.add(set(batch.column("_part").to_pylist()))

    places = spark.createDataFrame(list(enumerate(parts)), "_task int, _part long")
    dealt = blocks.withColumn("_part", F.floor(F.col("_row") / size).cast("long")).join(places, "_part").repartitionById(len(parts), "_task")
    # sorted, as then a part's Python worker is done, and lives on, when one of the rows fails
    guarded = dealt.mapInArrow(once, dealt.schema).sortWithinPartitions("_row")
    try:
        attempt(guarded.drop("_part", "_task", "_block"))
    except (PySparkException, Py4JError):
        return None
    return sorted(found.value)


def failing_rows(rows: DataFrame, attempt: Callable[[DataFrame], None]) -> dict[int, str]:
    """The numbers (column ``_row``, 0 to n - 1) of rows with which ``attempt`` fails, each with its message (SNK6).

    Where tasks are tried again, one run of ``attempt`` tells all parts that fail; these are cut into eight, down to single
    rows, so log n runs do, whatever the number of bad rows. Each row found is then run alone, for its message and as a proof.
    Otherwise rows are halved as long as a part fails, so k bad rows of n take some k log n attempts. The rows are written
    once in blocks, and an attempt reads the blocks of its part only; attempts go side by side. What fails without any row is
    not the rows' fault and is raised.
    """
    spark = rows.sparkSession
    n = rows.count()
    if n == 0:
        return {}
    size = max(1 << 12, -(-n // (1 << 10)))
    folder = scratch(spark)
    path = f"{folder}/blocks-{uuid.uuid4().hex}"
    block = F.floor(F.col("_row") / size).cast("int")
    rows.withColumn("_block", block).repartition("_block").write.partitionBy("_block").parquet(path)
    blocks = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_block", T.IntegerType())])).parquet(path)

    def message(low: int, high: int) -> str | None:
        inside = F.col("_block").between(low // size, (high - 1) // size) & (F.col("_row") >= low) & (F.col("_row") < high)
        try:
            attempt(blocks.filter(inside).drop("_block"))
        except (PySparkException, Py4JError) as error:
            return str(error).split("\n", 1)[0][:500]

    def suspects() -> list[int] | None:
        """The bad rows by whole runs, none of the good ones but by a failure of the machine."""
        wide = 1
        while -(-n // wide) > max(4 * spark.sparkContext.defaultParallelism, n >> 12):
            wide *= PIECES
        parts = list(range(-(-n // wide)))
        while parts:
            read = sorted({b for p in parts for b in range(p * wide // size, (min(n, (p + 1) * wide) - 1) // size + 1)})
            parts = _failing_parts(blocks.filter(F.col("_block").isin(read)), parts, wide, attempt)
            if parts is None or wide == 1:
                break
            wide //= PIECES
            parts = [i for p in parts for i in range(p * PIECES, (p + 1) * PIECES) if i * wide < n]
        return parts

    def halved(low: int, high: int, said: str | None) -> tuple[dict[int, str], list[tuple]]:
        """Of a part that fails, by what it said or by inference: the bad row, or the halves that fail."""
        if high - low == 1:
            said = said or message(low, high)
            return ({low: said} if said else {}), []
        middle = (low + high) // 2
        first = message(low, middle)
        # if the first half does not fail, the second one must
        second = message(middle, high) if first else None
        return {}, [(low, middle, first)] * bool(first) + [(middle, high, second)] * bool(second or not first)

    whole = message(0, n)
    if whole is None:
        return {}
    attempt(rows.filter(F.lit(False)))
    single = suspects()
    found: dict[int, str] = {}
    with ThreadPoolExecutor(max(2, min(16, spark.sparkContext.defaultParallelism)), initializer=enter_scope, initargs=(folder,)) as pool:
        # a run without an answer, or one that met no failure, leaves all to halving
        running = {pool.submit(halved, row, row + 1, None) for row in single} if single else {pool.submit(halved, 0, n, whole)}
        while running:
            done, running = wait(running, return_when=FIRST_COMPLETED)
            for part in done:
                bad, failing = part.result()
                found |= bad
                running |= {pool.submit(halved, *more) for more in failing}
    return found


def batch_writer(topic: str, settings: JobSettings, run: str = "") -> Callable[[DataFrame, int], None]:
    """Batch function of a topic: undecodable rows aside, the rest enriched and written (STR3, STR4, SNK2, SNK6, SNK7).

    Records that the table holds already are left out, whatever batch or ``run`` brought them. If the enrichment of a batch
    fails, the rows it fails with are written to the rejected table with the message, and the others as ever.
    """
    table, _ = TOPICS[topic]
    path = f"{settings.tables}/{table}"
    more = settings.extra.get(table)

    def write(batch: DataFrame, batch_id: int) -> None:
        # the files of a shuffle go with the job that made them, not when the driver happens to collect its garbage
        batch.sparkSession.conf.set(_CLEAN, True)
        # several passes read the batch; its size is bounded by the admission limit
        batch.persist()
        try:
            with scratch_scope(batch.sparkSession):
                good, bad = split_corrupt(batch)
                keyed = identified(good)
                keyed = keyed if table in ("car_telemetry", "car_position") else default_session(keyed)
                fresh = settle(unseen(keyed, batch_id, path, SESSION, run=run))
                rejected = bad.withColumn("error", F.lit("not a record"))
                if not fresh.isEmpty():
                    fresh, failed = _written(fresh, batch_id)
                    if failed is not None:
                        rejected = rejected.unionByName(failed)
                unless_empty(lambda rows, b: write_batch(rows, b, f"{settings.tables}/_rejected/{table}", ["run"]))(rejected.withColumn("run", F.lit(run)), batch_id)
        finally:
            batch.unpersist()

    def _written(fresh: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame | None]:
        ids = _team_ids(table, fresh, settings)

        def enrich(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
            made, state = _enriched(table, rows, batch_id, settings, ids)
            return (more(made) if more else made), state

        def put(rows: DataFrame) -> None:
            made, state = enrich(rows)
            write_batch(made.withColumn("run", F.lit(run)), batch_id, path, (*SESSION, "run"))
            write_batch(session_partials(rows, table).withColumn("run", F.lit(run)), batch_id, f"{settings.tables}/_catalogue", ("table_name", "run"))
            if state is not None:
                write_batch(state, batch_id, f"{settings.tables}/last_known")
                prune_versions(rows.sparkSession, f"{settings.tables}/last_known")
                extend_segments(rows.sparkSession, settings, rows)

        try:
            put(fresh)
            return fresh, None
        except (PySparkException, Py4JError):
            numbered_rows = numbered(fresh, ["RecordId"], "_row")
            failed = failing_rows(numbered_rows, lambda rows: enrich(rows.drop("_row"))[0].write.format("noop").mode("overwrite").save())
            if not failed:
                raise
        reasons = fresh.sparkSession.createDataFrame(list(failed.items()), "_row long, error string")
        told = numbered_rows.join(reasons, "_row").select(F.to_json(F.struct(*fresh.columns), {"ignoreNullFields": "false"}).alias("_corrupt_record"), "error")
        rest = settle(numbered_rows.join(reasons, "_row", "left_anti").drop("_row"))
        if not rest.isEmpty():
            put(rest)
        return rest, told

    return unless_empty(write)


def catalogue(spark: SparkSession, settings: JobSettings) -> DataFrame:
    """Rows, drivers and teams per table and session, from what the batches have left, without a scan of the tables
    (AGG5-AGG7, AGG20); distinct names by sketches, see ``operators/partials``."""
    return merged_sessions(spark.read.parquet(f"{settings.tables}/_catalogue"))


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of all runs of a query with one checkpoint, kept in the checkpoint's folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/apexframe-run")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, False)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    return spark.read.text(f"{checkpoint}/apexframe-run").first()[0]


def start(spark: SparkSession, topic: str, settings: JobSettings) -> StreamingQuery:
    """One checkpointed query (SNK8)."""
    lines = read_topic(
        spark, topic, settings.source, servers=settings.servers, path=settings.paths.get(topic),
        max_per_trigger=settings.max_per_trigger,
    )
    checkpoint = f"{settings.checkpoints}/{topic}"
    writer = (
        decode(lines, TOPICS[topic][1])
        .writeStream.queryName(topic.replace("-", "_"))
        .option("checkpointLocation", checkpoint)
        .foreachBatch(batch_writer(topic, settings, run_of(spark, checkpoint)))
    )
    trigger = {"availableNow": True} if settings.once else {"processingTime": f"{TRIGGER_SECONDS[topic]} seconds"}
    return writer.trigger(**trigger).start()


def start_all(spark: SparkSession, settings: JobSettings, topics: list[str] | None = None) -> list[StreamingQuery]:
    """All queries of the topics that have a source (STR1); wait with ``spark.streams.awaitAnyTermination()``."""
    wanted = topics or [t for t in TOPICS if settings.source == "kafka" or t in settings.paths]
    return [start(spark, topic, settings) for topic in wanted]
