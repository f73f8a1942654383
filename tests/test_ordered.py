"""Chunked ordered operators against plain windows, with a hot key and heavy ties."""

import bisect
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from apexframe.operators import ordered as W
from apexframe.operators.align import asof_align, proportional_align, zip_align


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(3)
    rows = [
        (
            None if i % 50 == 0 else 0 if random.random() < 0.4 else random.randint(1, 9),
            random.choice([1, 1, 1, 2, 3, 4, None]), i, random.choice([None, float(i)]),
        )
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, "k INT, o INT, id LONG, v DOUBLE")


@pytest.mark.parametrize("chunks", [2, 7, 64])
def test_scan_equals_plain_windows(skewed, chunks):
    part = Window.partitionBy("k").orderBy("o", "id")
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    expected = skewed.select(
        "*", F.row_number().over(part).cast("long").alias("n"), F.count(F.lit(1)).over(Window.partitionBy("k")).alias("c"),
        F.last("v", True).over(upto).alias("l"), F.last("v", True).over(part.rowsBetween(Window.unboundedPreceding, -1)).alias("b"),
        F.sum(F.coalesce("v", F.lit(0.0))).over(upto).alias("s"), F.sum(F.coalesce("v", F.lit(0.0))).over(Window.partitionBy("k")).alias("t"),
    )
    got = W.scan(
        skewed, ["k"], [F.col("o"), F.col("id")], number="n", count="c", last={"l": F.col("v")}, last_before={"b": F.col("v")},
        running={"s": F.col("v")}, total={"t": F.col("v")}, chunks=chunks,
    )
    assert sorted(map(str, got.select(expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_chunks_split_a_hot_key(skewed):
    sizes = W.chunk(skewed, [F.col("o"), F.col("id")], 30).groupBy("k", "_c1", "_c2").count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * 3000 / 30


def test_chunks_split_a_hot_key_in_text_order(spark):
    rows = spark.range(6000).select(F.lit("hot").alias("k"), F.concat(F.lit("ab"), F.lpad(F.conv(F.col("id") * 7919 % 6000, 10, 36), 4, "0")).alias("o"), "id")
    sizes = W.chunk(rows, [F.col("o"), F.col("id")], 30).groupBy("_c1", "_c2").count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * 6000 / 30
    got = W.scan(rows, ["k"], [F.col("o"), F.col("id")], number="n", chunks=30)
    expected = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_chunks_split_ties_without_a_second_column(spark):
    rows = spark.range(6000).select(F.lit("hot").alias("k"), (F.col("id") % 2).alias("o"), "id")
    sizes = W.chunk(rows, [F.col("o")], 30).groupBy("_c1", "_c2").count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * 6000 / 30
    got = W.scan(rows, ["k"], [F.col("o")], number="n", chunks=30).collect()
    assert sorted(r.n for r in got) == list(range(1, 6001)) and max(r.n for r in got if r.o == 0) == 3000


@pytest.mark.parametrize("second", [True, False])
def test_chunks_keep_the_order_of_values_that_begin_alike(spark, second):
    number = F.col("id") * 7919 % 6000
    long_text = F.concat(F.lit("https://example.com/a/long/path/"), F.lpad(number.cast("string"), 6, "0"))
    texts = F.when(F.col("id") % 3 == 0, F.lit("Supplier#1")).when(F.col("id") % 50 == 1, None).when(F.col("id") % 7 == 2, F.lit("Supplier")).otherwise(long_text)
    for order in (texts, F.lit(1 << 60) + number % 3000, (F.lit("1e22").cast("decimal(38,2)") + number).cast("decimal(38,2)")):
        rows = spark.range(6000).select(F.lit("hot").alias("k"), order.alias("o"), (-F.col("id")).alias("id"))
        by = [F.col("o"), F.col("id")][: 1 + second]
        sizes = W.chunk(rows, by, 30).groupBy("_c1", "_c2").count()
        assert sizes.agg(F.max("count")).first()[0] < 3 * 6000 / 30
        got = W.scan(rows, ["k"], by, number="n", last_before={"b": F.col("o")}, chunks=30).collect()
        assert sorted(r.n for r in got) == list(range(1, 6001))
        in_order = [r.o for r in sorted(got, key=lambda r: r.n)]
        assert in_order == sorted((r.o for r in got), key=lambda o: (o is not None, o or 0))
        if second:
            expected = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o", "id"))).select("id", "n").collect()
            assert {(r.id, r.n) for r in got} == set(map(tuple, expected))


def test_scratch_is_deleted_with_its_scope(spark):
    import os

    with W.scratch_scope(spark) as folder:
        assert W.settle(spark.range(3)).count() == 3 and os.listdir(folder)
    assert not os.path.exists(folder) and W.scratch(spark) != folder


def test_no_shared_folder_is_an_error_on_a_cluster(spark):
    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()
        conf = {}

    with pytest.raises(RuntimeError):
        W.scratch(Session())


def test_numbered_goes_on_from_range_to_range(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(7)
    got = W.numbered(rows, ["x"], "n", start=1).collect()
    assert all(r.n == r.x + 1 for r in got) and len(got) == 5000


def test_fill_rules(spark):
    rows = [
        ("A", 1, None), ("A", 2, "90"), ("A", 3, ""), ("A", 4, "NaT"), ("A", 5, "91"), ("B", 1, "80"), ("B", 2, None),
    ]
    df = spark.createDataFrame(rows, "d STRING, lap INT, LapTime STRING")
    got = W.fill_last_known(df, "LapTime", ["d"], [F.col("lap")]).orderBy("d", "lap").collect()
    assert [(r.LapTime, r.LapTimeFilledByPrevious) for r in got] == [
        (None, False), ("90", False), ("90", True), ("90", True), ("91", False), ("80", False), ("80", True),
    ]


def test_fill_across_batches_equals_one_batch(spark):
    random.seed(5)
    rows = [(random.choice("ABC"), float(i), random.choice([None, "", f"t{i}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "d STRING, lap DOUBLE, LapTime STRING")
    whole = W.fill_last_known(df, "LapTime", ["d"], [F.col("lap")])
    state = spark.createDataFrame([], "d STRING, seen DOUBLE, known STRING")
    parts = None
    for low in range(0, 200, 50):
        rows_, state = W.fill_across_batches(df.filter(F.col("lap").between(low, low + 49)), state, "LapTime", ["d"], "lap")
        parts = rows_ if parts is None else parts.unionByName(rows_)
        state = W.settle(state)
    assert sorted(map(str, parts.select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_late_row_is_left_alone(spark):
    state = spark.createDataFrame([("A", 10.0, "t10")], "d STRING, seen DOUBLE, known STRING")
    batch = spark.createDataFrame([("A", 5.0, None), ("A", 4.0, "t4"), ("A", 11.0, None)], "d STRING, lap DOUBLE, LapTime STRING")
    rows, new = W.fill_across_batches(batch, state, "LapTime", ["d"], "lap")
    got = {r.lap: (r.LapTime, r.LapTimeFilledByPrevious) for r in rows.collect()}
    assert got == {5.0: (None, False), 4.0: ("t4", False), 11.0: ("t10", True)}
    assert [tuple(r) for r in new.collect()] == [("A", 11.0, "t10")]


def test_speed_fill(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None), (3, 5.0), (4, 0.0), (5, None)], "i INT, Speed DOUBLE")
    got = W.fill_speed(df.withColumn("k", F.lit(1)), "Speed", ["k"], [F.col("i")]).orderBy("i").collect()
    assert [r.Speed for r in got] == [0.0, 0.0, 5.0, 5.0, 5.0]


def test_exact_medians(spark):
    random.seed(7)
    rows = [(random.choice("ab"), random.choice([None, 1.0, 2.5, random.random() * 9])) for _ in range(501)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    got = {r.g: r["median"] for r in W.group_medians(df, ["g"], ["v"]).collect()}
    for g in "ab":
        assert got[g] == pytest.approx(statistics.median(v for k, v in rows if k == g and v is not None))


def test_impute_falls_back_from_group_to_all_to_zero(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None), ("a", 3.0, None), ("a", None, None), ("b", None, None)], "g STRING, v DOUBLE, w DOUBLE"
    )
    got = sorted(tuple(r) for r in W.impute_by_group(df, "g", ["v", "w"]).collect())
    assert got == [("a", 1.0, 0.0), ("a", 2.0, 0.0), ("a", 3.0, 0.0), ("b", 2.0, 0.0)]


def test_running_order_and_ties(spark):
    laps = spark.createDataFrame(
        [("r", "x", 1, 90.0), ("r", "y", 1, 91.0), ("r", "x", 2, 92.0), ("r", "y", 2, 91.0)], "race STRING, d STRING, lap INT, s DOUBLE"
    )
    got = {(r.d, r.lap): (r.CumulativeTime, r.RunningPosition) for r in W.running_order(laps, ["race"], "d", "lap", "s").collect()}
    assert got == {("x", 1): (90.0, 1), ("y", 1): (91.0, 2), ("x", 2): (182.0, 1), ("y", 2): (182.0, 2)}


def test_alignments(spark):
    left = spark.createDataFrame([("a", float(i)) for i in range(5)], "k STRING, t DOUBLE")
    right = spark.createDataFrame([("a", 0.5, 10.0), ("a", 2.5, 0.0), ("a", 3.5, 30.0)], "k STRING, u DOUBLE, Speed DOUBLE")
    zipped = zip_align(left, right, ["k"], [F.col("t")], [F.col("u")], ["Speed"], fill="Speed")
    assert [r.Speed for r in zipped.orderBy("t").collect()] == [10.0, 10.0, 30.0, 30.0, 30.0]
    spread = proportional_align(left, right, ["k"], [F.col("t")], [F.col("u")], ["Speed"])
    assert [r.Speed for r in spread.orderBy("t").collect()] == [[10.0, 0.0, 30.0][min(int(i / 5 * 3), 2)] for i in range(5)]
    timed = asof_align(left, right, ["k"], "t", "u", ["Speed"])
    assert [r.Speed for r in timed.orderBy("t").collect()] == [None, 10.0, 10.0, 0.0, 30.0]


@pytest.mark.parametrize("kind", ["string", "bigint", "decimal(20,3)", "double"])
def test_places_among_many_borders(spark, kind):
    """A long list of borders is searched, a short one is a condition; both count the borders that are not above."""
    values = [r[0] for r in spark.range(0, 3000).select(F.expr(f"CAST(CAST(id * 7919 % 100003 AS DECIMAL(20,3)) / 8 AS {kind})").alias("x")).distinct().collect()]
    for n in (1, 128, 129, 1024, 1500):
        borders = sorted(values[:n])
        df = spark.createDataFrame([(v,) for v in [*values, None]], f"x {kind}")
        got = df.withColumn("place", F.when(F.col("x").isNotNull(), W._reached(F.col("x"), borders))).collect()
        assert all(r.place == (None if r.x is None else bisect.bisect_right(borders, r.x)) for r in got)
