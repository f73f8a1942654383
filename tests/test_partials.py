"""Summaries that are merged, and lookups that skip row groups."""

import random

from pyspark.sql import functions as F

from apexframe.operators import partials as P
from apexframe.operators.ordered import group_medians
from apexframe.sources.writers import interleaved, prediction_documents, write_session_table


def read_rows(df):
    """Rows that the scan of a plan put out, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_a_lookup_by_driver_reads_a_small_share_of_the_row_groups(spark, tmp_path):
    """400,000 samples of 300 drivers in 20 sessions: one driver is found by reading under 10 % of the rows, a lap under 45 %."""
    rows = spark.range(400_000).select(
        F.lit(2024).alias("Year"), F.concat(F.lit("GP "), F.pmod(F.xxhash64("id"), F.lit(20))).alias("GrandPrix"), F.lit("Race").alias("SessionType"),
        F.concat(F.lit("D"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300)).cast("string")).alias("Driver"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.lit(60)).cast("double").alias("LapNumber"), F.rand(1).alias("Time"), "id",
    )
    path, plain = str(tmp_path / "clustered"), str(tmp_path / "plain")
    write_session_table(rows, path, cluster=("Driver", "LapNumber"), bloom={"Driver": 300}, row_group_bytes=8 << 10)
    rows.write.partitionBy("Year", "GrandPrix", "SessionType").option("parquet.block.size", 8 << 10).parquet(plain)
    n = rows.count()
    by_driver = spark.read.parquet(path).filter("Driver = 'D77'")
    by_lap = spark.read.parquet(path).filter("LapNumber = 30")
    assert by_driver.count() == rows.filter("Driver = 'D77'").count() and by_lap.count() == rows.filter("LapNumber = 30").count()
    assert read_rows(by_driver.select("id", "Driver")) < 0.1 * n, read_rows(by_driver.select("id", "Driver")) / n
    assert read_rows(by_lap.select("id", "LapNumber")) < 0.45 * n, read_rows(by_lap.select("id", "LapNumber")) / n
    assert read_rows(spark.read.parquet(plain).filter("Driver = 'D77'").select("id", "Driver")) > 0.4 * n
    assert spark.read.parquet(path).drop("batch_id").count() == n


def test_interleaved_bits(spark):
    df = spark.createDataFrame([(x, float(y)) for x in range(4) for y in range(4)], "x long, y double")
    got = {(r.x, int(r.y)): r.z for r in interleaved(df, ["x", "y"], "z", bits=2).collect()}
    spread = lambda v: (v & 1) | (v & 2) << 1
    # the lowest quantile border is the lowest value
    place = lambda v, cuts: sum(v >= c for c in cuts)
    xs = sorted({c for c in df.approxQuantile("x", [0.25, 0.5, 0.75], 0.125)})
    ys = sorted({c for c in df.approxQuantile("y", [0.25, 0.5, 0.75], 0.125)})
    assert got == {(x, y): spread(place(x, xs)) << 1 | spread(place(y, ys)) for x, y in got}


def test_merged_counts_and_sketches(spark):
    """After every batch the merged summary is that of all rows so far; the error of distinct names is within three deviations."""
    names = "Year int, GrandPrix string, SessionType string, Driver string, Team string"
    rng, rows, parts = random.Random(3), [], None
    for batch in range(4):
        new = [(2024, f"GP {rng.randrange(3)}", rng.choice(["Race", None]), rng.choice([None, "", f"d{rng.randrange(80)}"]), None if batch < 2 else "t") for _ in range(200)]
        rows += new
        part = P.session_partials(spark.createDataFrame(new, names), "laps")
        parts = part if parts is None else parts.unionByName(part)
        expected = {}
        for year, gp, kind, driver, team in rows:
            n, d, t = expected.setdefault(("laps", year, gp, kind), [0, set(), set()])
            expected[("laps", year, gp, kind)][0] += 1
            d |= {driver} - {None, ""}
            t |= {team} - {None}
        got = {tuple(r)[:4]: tuple(r)[4:] for r in P.merged_sessions(parts).collect()}
        assert got == {k: (n, len(d), len(t)) for k, (n, d, t) in expected.items()}
    many = spark.range(300_000).select(F.lit(1).alias("Year"), F.lit("g").alias("GrandPrix"), F.lit("s").alias("SessionType"), F.col("id").cast("string").alias("Driver"))
    halves = P.session_partials(many.filter("id % 2 = 0"), "x").unionByName(P.session_partials(many, "x"))
    row = P.merged_sessions(halves).first()
    assert row.n == 450_000 and abs(row.drivers / 300_000 - 1) < 3 * 1.04 / 2 ** (P.HLL_BITS / 2) and row.teams == 0


def test_rank_error_of_merged_quantiles(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    parts = P.quantile_partials(df.filter("id < 50000"), ["g"], ["x", "none"]).unionByName(P.quantile_partials(df.filter("id >= 50000"), ["g"], ["x", "none"]))
    medians = {r.g: r.median for r in P.sketched_medians(P.merged_quantiles(parts, ["g"])).collect()}
    exact = {r.g: r.median for r in group_medians(df, ["g"], ["x"]).collect()}
    for g, m in medians.items():
        rank = df.filter((F.col("g") == g) & (F.col("x") <= m)).count() / df.filter(F.col("g") == g).count()
        assert abs(rank - 0.5) < 0.014 and abs(m - exact[g]) < 30_000
    (overall,) = [r.median for r in P.sketched_medians(P.merged_quantiles(parts, [])).collect()]
    assert abs(df.filter(F.col("x") <= overall).count() / 200_000 - 0.5) < 0.014


def test_missing_numbers_from_kept_sketches(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("a", 2.0), ("b", None), ("b", float("nan"))], "g string, x double")
    got = P.impute_by_sketch(df, "g", ["x"], P.quantile_partials(df, ["g"], ["x"]))
    assert sorted(map(tuple, got.collect())) == [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)]


def test_documents_of_a_shared_place_stay_small(spark):
    rows = spark.range(3000).select(F.lit("r").alias("GrandPrix"), F.when(F.col("id") % 2 == 0, 1.0).when(F.col("id") % 3 == 0, 2.5).alias("PredictedPosition"), "id")
    documents = prediction_documents(rows, "t", per_document=100)
    sizes = [r.n for r in documents.select(F.size("predictions").alias("n")).collect()]
    assert max(sizes) < 200 and sum(sizes) == 3000
    assert documents.select(F.inline("predictions")).select("id").distinct().count() == 3000
    again = prediction_documents(rows.repartition(7), "t", per_document=100)
    assert sorted(map(str, again.collect())) == sorted(map(str, documents.collect()))
