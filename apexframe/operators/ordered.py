"""Ordered per-key operators that stay balanced when one key holds most of the rows.

``Window.partitionBy(key).orderBy(t)`` sends a whole key to one task. Here the rows of a key are cut
into consecutive chunks along the order columns, at quantiles of the data, so that no chunk exceeds
about 1/n of all rows whatever the key distribution. Each chunk is summarised by a plain aggregate
(map-side combined), the summaries - at most a few per key and cut - are scanned to give every chunk
what precedes it, and that carry enters the chunk as a seed row ahead of its own rows. The rows
themselves are shuffled once.

The input is read for the cuts, the summaries and the rows, so its order columns must come out the same
each time: stored columns and exact arithmetic do, floating-point sums need ``settle`` first.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_LOW = -1.7976931348623157e308
_HERE = threading.local()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: the same values for every later pass, and a known size.

    Wanted before an ordered operator whose order column is a floating-point aggregate, or for a small
    side that several passes read. The table goes to the scratch folder.
    """
    path = f"{scratch(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """The folder for tables that live as long as a query: the scope's, or the application's.

    It lies in the session's ``spark.checkpoint.dir``, which all executors share; without one there is an
    error, except in local mode, where driver and executors are one process. The application's folder is
    deleted when the process ends.
    """
    scopes = getattr(_HERE, "scopes", None)
    if scopes:
        return scopes[-1]
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.gettempdir()
    folder = f"{shared}/apexframe-{context.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, context._jvm, context._jsc.hadoopConfiguration(), folder)
    return folder


_FOLDERS: set[str] = set()


def _delete(jvm, settings, folder: str) -> None:
    with contextlib.suppress(Exception):  # left-over scratch does no harm, a process that ends may have lost its JVM
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(settings).delete(path, True)


def enter_scope(folder: str) -> None:
    """From now on, scratch tables of this thread go to ``folder``, such as the scope of the thread that started it."""
    if not hasattr(_HERE, "scopes"):
        _HERE.scopes = []
    _HERE.scopes.append(folder)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[str]:
    """Within it, scratch tables go to a folder of their own, which is deleted at its end.

    For work that is finished inside, such as a micro-batch.
    """
    folder = f"{scratch(spark)}/scope-{uuid.uuid4().hex}"
    enter_scope(folder)
    try:
        yield folder
    finally:
        _HERE.scopes.pop()
        _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)


def numbered(rows: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """``rows`` with their place in the order of the columns ``order``, counted on from ``start``.

    Sorted by ranges and written once; the rows of a range are numbered on from the counts of the ranges before
    it, of which there is one per partition. The same for rows that are alike in all of ``order``, in any order.
    """
    within = (1 << 33) - 1
    placed = settle(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_place", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return placed.select("*", part).join(starts, "_part").select(
        *rows.columns, (F.col("_start") + F.col("_place").bitwiseAND(F.lit(within)) + start).alias(name)
    )


def order_value(df: DataFrame, c: Column) -> Column | None:
    """A double that never decreases along ``c`` (nulls first); None for types without one.

    Of a text it is the first six bytes, as a number that a double holds exactly.
    """
    kind = df.select(c.alias("x")).schema[0].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(c.cast("timestamp")).cast("double")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(c).cast("double")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        number = c.cast("double")
    elif isinstance(kind, T.StringType):
        number = F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    else:
        return None
    return F.coalesce(F.nanvl(number, -F.lit(_LOW)), F.lit(_LOW))


def default_chunks(df: DataFrame) -> int:
    """Enough chunks for every shuffle partition to get several: four for each, numbers that the driver lists."""
    return max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cuts(df: DataFrame, name: str, n: int) -> list[float]:
    """The ``n`` - 1 borders of the ``n``-quantiles of a number."""
    found = df.approxQuantile(name, [i / n for i in range(1, n)], 1.0 / (2 * n))
    return found or []


def bucketed(df: DataFrame, name: str, at: Sequence[float], out: str) -> DataFrame:
    """The place of a number among sorted borders, from 0."""
    borders = sorted({c for c in at if c > _LOW})
    if not borders:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=[float("-inf"), *borders, float("inf")], inputCol=name, outputCol=out).transform(df)


def _mixed(rows: DataFrame, heavy: Sequence[float]) -> list[float]:
    """Those of ``heavy``, values of ``_o1``, that stand for several values of ``_x``.

    A text is known by its first bytes only, and a double holds no long integer or decimal exactly.
    """
    kind = rows.schema["_x"].dataType
    if not isinstance(kind, (T.StringType, T.DecimalType)):
        heavy = [v for v in heavy if abs(v) >= 2.0**53]
    if not heavy:
        return []
    one = F.col("low").eqNullSafe(F.col("high")) & F.col("known").isin(0, F.col("all"))
    found = rows.filter(F.col("_o1").isin(*heavy)).groupBy("_o1").agg(
        F.min("_x").alias("low"), F.max("_x").alias("high"), F.count("_x").alias("known"), F.count(F.lit(1)).alias("all")
    )
    return sorted(r[0] for r in found.filter(~one).select("_o1").collect())


def _exact_cuts(rows: DataFrame, n: int) -> list[tuple[object, bool]]:
    """Borders along ``_x`` by its own order, with whether only one value lies from a border to the next.

    Equal values are counted first, so a frequent one is a single row here. There are at most ``2 * n`` borders, or so:
    one per ``n``-th of the rows, and those before and after a value that fills as much alone.
    """
    counted = settle(rows.filter("_x IS NOT NULL").groupBy("_x").agg(F.count(F.lit(1)).alias("_w")))
    part = F.shiftrightunsigned("_place", 33).alias("_part")
    placed = settle(counted.orderBy("_x").withColumn("_place", F.monotonically_increasing_id())).select("*", part)
    sums = placed.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    size = max(1, (placed.agg(F.sum("_w")).first()[0] or 0) // n)
    inside = Window.partitionBy("_part").orderBy("_place")
    upto = F.col("_start") + F.sum("_w").over(inside)
    alone = F.col("_w") >= size
    numbers = placed.join(starts, "_part").withColumns({"_q": F.floor((upto - F.col("_w")) / size), "_alone": alone})
    new = (F.lag("_q").over(inside).isNull() | (F.lag("_q").over(inside) != F.col("_q")) | F.lag("_alone").over(inside) | F.col("_alone"))
    return [(r[0], r[1]) for r in numbers.withColumn("_new", new).filter("_new").orderBy("_place").select("_x", "_alone").collect()]


#: Up to so many borders are a nested condition that Spark compiles; a longer list is one array literal that is searched.
_COMPILED = 128


def _reached(x: Column, borders: Sequence[object], passed: int = 0) -> Column:
    """How many of the sorted ``borders`` are not above ``x``, by halving."""
    if not borders:
        return F.lit(passed)
    if len(borders) > _COMPILED:
        held, n = F.array(*map(F.lit, borders)), len(borders)
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(held, at + step - 1) <= x), at + step).otherwise(at)) + passed
    half = len(borders) // 2
    return F.when(x < F.lit(borders[half]), _reached(x, borders[:half], passed)).otherwise(
        _reached(x, borders[half + 1 :], passed + half + 1)
    )


def chunk(df: DataFrame, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """Add ``_c1, _c2``: chunk numbers that never decrease along ``order``.

    Cuts are quantiles of the first order column, a list of at most ``n`` numbers. A number that fills several
    quantiles and stands for different values (texts that begin alike, integers that a double rounds) is cut again by
    those values. A single value that fills several quantiles is a tie too big for one chunk; its rows are cut again at
    the quantiles of the second order column, or of a hash of the row if there is no second one and any order will do.
    The cut lists only place the chunk borders, results do not depend on them.
    """
    n = n or default_chunks(df)
    first = order_value(df, order[0])
    if first is None:
        return df.withColumns({"_c1": F.lit(0), "_c2": F.lit(0)})
    shaped = df.withColumn("_o1", first)
    found = cuts(shaped.select("_o1"), "_o1", n)
    heavy = sorted({a for a, b in zip(found, found[1:]) if a == b})
    shaped = bucketed(shaped, "_o1", found, "_b1")
    c1, c2 = F.col("_b1") * 2, F.lit(0.0)
    drop = ["_o1", "_b1"]
    if heavy:
        is_heavy = F.col("_o1").isin(*heavy)
        # a light value above a heavy border belongs after all rows of that border value
        borders = [_LOW, *sorted({c for c in found if c > _LOW})]
        starts_heavy = F.col("_b1").isin(*[float(i) for i, v in enumerate(borders) if v in heavy])
        c1 = c1 + F.when(starts_heavy & ~is_heavy, 1).otherwise(0)
        is_tie, exact = is_heavy, order[0]
        if isinstance(df.select(exact.alias("x")).schema[0].dataType, (T.TimestampType, T.TimestampNTZType)):
            exact = F.unix_micros(exact.cast("timestamp"))
        mixed = _mixed(shaped.select("_o1", exact.alias("_x")), heavy)
        if mixed:
            is_mixed = F.col("_o1").isin(*mixed)
            exact_cuts = _exact_cuts(shaped.filter(is_mixed).select(exact.alias("_x")), n)
            # place 0 is for nulls only
            place = F.when(is_mixed & exact.isNotNull(), _reached(exact, [c for c, _ in exact_cuts])).otherwise(0)
            shaped = shaped.withColumn("_t1", place)
            c1 = c1 * (len(exact_cuts) + 1) + F.col("_t1")
            is_tie = is_heavy & (~is_mixed | F.col("_t1").isin(0, *[i for i, (_, alone) in enumerate(exact_cuts, 1) if alone]))
            drop.append("_t1")
        plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
        second = order_value(df, order[1]) if len(order) > 1 else F.xxhash64(*plain).cast("double")
        if second is not None:
            shaped = shaped.withColumn("_o2", second)
            shaped = bucketed(shaped, "_o2", cuts(shaped.filter(is_tie).select("_o2"), "_o2", n), "_b2")
            c2 = F.when(is_tie, F.col("_b2")).otherwise(0.0)
            drop += ["_o2", "_b2"]
    return shaped.withColumns({"_c1": c1.cast("int"), "_c2": c2.cast("int")}).drop(*drop)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    number: str | None = None,
    count: str | None = None,
    last: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Ordered columns per key, ascending along ``order`` (use a negated number to go down).

    number       1-based row number           count        rows of the key
    last         last non-null value so far   last_before  the same, before the current row
    running      running sum                  total        sum over the key
    """
    last, last_before = dict(last or {}), dict(last_before or {})
    running, total = dict(running or {}), dict(total or {})
    work = {f"_l_{n}": c for n, c in {**last, **last_before}.items()}
    sums = {f"_s_{n}": F.coalesce(c, F.lit(0)) for n, c in {**running, **total}.items()}
    order_names = [f"_k{i}" for i in range(len(order))]
    base = df.withColumns({**work, **sums, **dict(zip(order_names, order))})
    base = chunk(base, [F.col(n) for n in order_names], chunks)

    place = F.struct(*order_names)
    need_carry = [F.count(F.lit(1)).alias("_n")]
    need_carry += [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in work]
    need_carry += [F.sum(c).alias(c) for c in sums]
    summary = base.groupBy(*keys, "_c1", "_c2").agg(*need_carry)
    before = Window.partitionBy(*keys).orderBy("_c1", "_c2").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry: dict[str, Column] = {"_n": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(whole)}
    carry |= {c: F.last(c, ignorenulls=True).over(before) for c in work}
    carry |= {c: F.sum(c).over(before) for c in sums}
    carry |= {f"_t{c}": F.sum(c).over(whole) for c in sums}
    seeds = summary.withColumns(carry).withColumn("_seed", F.lit(True))

    rows = base.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    frame = Window.partitionBy(*keys, "_c1", "_c2").orderBy(F.desc("_seed"), *order_names)
    so_far = frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = frame.rowsBetween(Window.unboundedPreceding, -1)
    out: dict[str, Column] = {}
    if number:
        out[number] = F.sum(F.when(F.col("_seed"), F.col("_n")).otherwise(F.lit(1).cast("long"))).over(so_far)
    if count:
        out[count] = F.first("_all").over(so_far)
    out |= {n: F.last(f"_l_{n}", ignorenulls=True).over(so_far) for n in last}
    out |= {n: F.last(f"_l_{n}", ignorenulls=True).over(earlier) for n in last_before}
    out |= {n: F.sum(f"_s_{n}").over(so_far) for n in running}
    out |= {n: F.first(f"_t_s_{n}").over(so_far) for n in total}
    kept = [c for c in df.columns if c not in out]
    return rows.withColumns(out).filter(~F.col("_seed")).select(*kept, *out)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, **kw) -> DataFrame:
    """1-based row number per key."""
    return scan(df, keys, order, number=name, **kw)


def fill_last_known(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    order: Sequence[Column],
    flag_name: str = "LapTimeFilledByPrevious",
    missing: Column | None = None,
    **kw,
) -> DataFrame:
    """Missing values take the latest valid one before them, with a flag where that happened (WIN1)."""
    from ..functions.durations import is_missing_duration

    missing = is_missing_duration(F.col(value)) if missing is None else missing
    filled = scan(df, keys, order, last={"_known": F.when(~missing, F.col(value))}, **kw)
    substituted = missing & F.col("_known").isNotNull()
    return filled.withColumns(
        {flag_name: substituted, value: F.when(substituted, F.col("_known")).otherwise(F.col(value))}
    ).drop("_known").select(*df.columns, flag_name)


def fill_across_batches(
    batch: DataFrame,
    known: DataFrame,
    value: str,
    keys: Sequence[str],
    order: str,
    flag_name: str = "LapTimeFilledByPrevious",
) -> tuple[DataFrame, DataFrame]:
    """The last-known fill of one batch, given what earlier batches left (STR5): filled rows, new state.

    ``known`` has one row per key: ``seen`` (largest order value so far) and ``known`` (last valid value).
    Rows older than ``seen`` keep their own value and leave the state alone.
    """
    from ..functions.durations import is_missing_duration

    mark = "_late"
    joined = batch.join(known.select(*keys, "seen"), list(keys), "left")
    marked = joined.withColumn(mark, F.coalesce(F.col(order) < F.col("seen"), F.lit(False))).drop("seen")
    late = marked.filter(mark).drop(mark)
    fresh = marked.filter(~F.col(mark)).drop(mark).withColumn("_old", F.lit(False))
    old = known.select(*keys, F.lit(_LOW).alias(order), F.col("known").alias(value), F.lit(True).alias("_old"))
    seeded = fresh.unionByName(old, allowMissingColumns=True)
    filled = fill_last_known(seeded, value, keys, [F.col(order)], flag_name).filter(~F.col("_old")).drop("_old")
    rows = filled.unionByName(late.withColumn(flag_name, F.lit(False)))
    valid = F.when(~is_missing_duration(F.col(value)), F.col(value))
    news = fresh.select(*keys, F.col(order).alias("seen"), valid.alias("known"))
    state = (
        known.select(*keys, "seen", "known")
        .unionByName(news)
        .groupBy(*keys)
        .agg(
            F.max("seen").alias("seen"),
            F.max_by("known", F.when(F.col("known").isNotNull(), F.col("seen"))).alias("known"),
        )
    )
    return rows, state


def fill_speed(df: DataFrame, speed: str, keys: Sequence[str], order: Sequence[Column], **kw) -> DataFrame:
    """Zero and missing speeds take the previous non-zero one, a leading gap is zero (WIN2)."""
    known = F.when(F.col(speed) != 0, F.col(speed))
    return scan(df, keys, order, last={speed: known}, **kw).withColumn(speed, F.coalesce(speed, F.lit(0.0)))


def progress(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "LapProgress") -> DataFrame:
    """Share of the way through the key's rows, 0 at the first and 1 at the last (WIN9)."""
    placed = scan(df, keys, order, number="_i", count="_m")
    share = F.when(F.col("_m") > 1, (F.col("_i") - 1) / (F.col("_m") - 1)).otherwise(0.0)
    return placed.withColumn(name, share).drop("_i", "_m")


def running_order(laps: DataFrame, race: Sequence[str], driver: str, lap: str, seconds: str) -> DataFrame:
    """Cumulative race time per driver and the running order it gives on every lap (WIN10).

    Times are summed in whole microseconds, which gives the same sum in any order of addition.
    """
    micros = F.round(F.col(seconds) * 1e6).cast("long")
    summed = settle(scan(laps, [*race, driver], [F.col(lap)], running={"_sum": micros}))
    placed = scan(summed, [*race, lap], [F.col("_sum"), F.col(driver)], number="RunningPosition")
    return placed.withColumn("CumulativeTime", F.col("_sum") / 1e6).drop("_sum")


def tyre_ramp(degradation: Column, lap: Column, laps: Column) -> Column:
    """Tyre factor growing to its full value over the first 70 % of the race (WIN10)."""
    return 1 + (degradation - 1) * F.least(F.lit(1.0), lap / (laps * 0.7))


def value_counts(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """How often each value of each column comes per group: group columns, ``metric``, ``value``, ``_n``."""
    measures = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return (
        df.select(*group, F.inline(measures))
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*group, "metric", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def group_medians(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact medians per group in long form: group columns, ``metric``, ``median`` (AGG12).

    Values are counted first (map-side combined, spread over the values), then ranked by the chunked
    scan, so a group of any size is never held by one task.
    """
    return _medians_of(settle(value_counts(df, group, columns)), group)


def _medians_of(counted: DataFrame, group: Sequence[str]) -> DataFrame:
    ranked = scan(
        counted, [*group, "metric"], [F.col("value")], running={"_upto": F.col("_n")}, total={"_all": F.col("_n")}
    )
    low = F.floor((F.col("_all") + 1) / 2)
    high = F.floor(F.col("_all") / 2) + 1
    holds = [(F.col("_upto") - F.col("_n") < r) & (r <= F.col("_upto")) for r in (low, high)]
    return (
        ranked.filter(reduce(lambda a, b: a | b, holds))
        .groupBy(*group, "metric")
        .agg(((F.min("value") + F.max("value")) / 2).alias("median"))
    )


def impute_by_group(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Missing numbers take the group median, else the overall median, else 0 (NUL2)."""
    def wide(medians: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
        named = [
            F.max(F.when(F.col("metric") == c, F.col("median"))).alias(f"{prefix}{c}") for c in columns
        ]
        return medians.groupBy(*keys).agg(*named)

    counted = settle(value_counts(df, [group], columns))
    total = settle(counted.groupBy("metric", "value").agg(F.sum("_n").alias("_n")))
    of_group = wide(_medians_of(counted, [group]), "_g_", [group])
    overall = wide(_medians_of(total, []), "_a_", [])
    joined = df.join(of_group, group, "left").withColumn("_all", overall.select(F.struct("*")).scalar())
    filled = {
        c: F.coalesce(F.col(c), F.col(f"_g_{c}"), F.col("_all").getField(f"_a_{c}"), F.lit(0.0)) for c in columns
    }
    return joined.withColumns(filled).select(*df.columns)
