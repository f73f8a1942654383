"""Dimension lookups and name resolution (JOIN3, JOIN4, JOIN9-JOIN13, JOIN16-JOIN18, AGG2).

No side is broadcast by hint: dimension tables are joined by key and Spark decides from the measured size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.names import lookup
from .ordered import numbered


def latest(df: DataFrame, keys: Sequence[str], recency: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of the most recent record per key, by aggregation (JOIN3, WIN5)."""
    picked = df.groupBy(*keys).agg(F.max(F.struct(*recency, *columns)).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in columns])


def with_latest_team(samples: DataFrame, driver_info: DataFrame, driver: str = "Driver", ids: DataFrame | None = None) -> DataFrame:
    """Team of each driver's newest record that names one (JOIN3), and with ``ids`` the team's id (JOIN4).

    The id is looked up once per driver, so the samples are joined once.
    """
    newest = driver_info.groupBy(F.col("Driver").alias(driver)).agg(
        F.max(F.struct("Year", "GrandPrix", "TeamName")).alias("_r")
    )
    teams = newest.select(driver, F.nullif(F.col("_r.TeamName"), F.lit("")).alias("Team"))
    if ids is None:
        return samples.drop("Team").join(teams, driver, "left")
    known = team_id(teams, ids)
    return samples.drop("Team", "TeamID").join(known, driver, "left").withColumn("TeamID", F.coalesce("TeamID", F.lit(0)))


def dense_ids(names: DataFrame, name: str, id_name: str, start: int = 1) -> DataFrame:
    """1..n over the distinct non-null names in sorted order (AGG2).

    Sorted by ranges and numbered range by range, so no task sees all names.
    """
    distinct = names.select(name).filter(F.col(name).isNotNull()).distinct()
    return numbered(distinct, [name], id_name, start).withColumn(id_name, F.col(id_name).cast("int"))


def extend_ids(known: DataFrame, names: DataFrame, name: str, id_name: str) -> DataFrame:
    """Known ids plus new ids, above the largest, for names that differ in more than case (STR6)."""
    fresh = (
        names.select(name)
        .filter(F.col(name).isNotNull() & (F.col(name) != ""))
        .withColumn("_low", F.lower(name))
        .join(known.select(F.lower(name).alias("_low")).distinct(), "_low", "left_anti")
        .groupBy("_low")
        .agg(F.min(name).alias(name))
    )
    top = known.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("top"))
    added = dense_ids(fresh, name, id_name)
    return known.select(name, id_name).unionByName(
        added.select(name, (F.col(id_name) + top.scalar()).cast("int").alias(id_name))
    )


def team_id(df: DataFrame, ids: DataFrame, team: str = "Team", out: str = "TeamID") -> DataFrame:
    """Id of a team, exact name first and then regardless of case; 0 when there is none (JOIN4)."""
    exact = ids.select(F.col(ids.columns[0]).alias("_name"), F.col(ids.columns[1]).alias("_exact"))
    folded = exact.groupBy(F.lower("_name").alias("_low")).agg(F.min("_exact").alias("_folded"))
    return (
        df.withColumn("_low", F.lower(team))
        .join(folded, "_low", "left")
        .join(exact.withColumnRenamed("_name", team), team, "left")
        .withColumn(out, F.coalesce("_exact", "_folded", F.lit(0)).cast("int"))
        .select(*[c for c in df.columns if c != out], out)
    )


@dataclass(frozen=True)
class Rule:
    """One way a left name can match a right row.

    kind: "equal", "left_in_right" (left text occurs in right text) or "right_in_left".
    tier: lower tiers win. pick: "first" or "last" right row in ordinal order.
    """

    tier: int
    kind: str
    left: Column
    right: Column
    pick: str = "first"


#: Texts up to this length are looked up as a whole, longer ones by their last so many characters.
_WHOLE = 64
#: Bits of the filter of the texts that are looked for, 64 to a number.
_SLOTS = 1 << 22


def _piece(text: Column) -> Column:
    """What a text is looked up by."""
    return F.when(F.length(text) > _WHOLE, F.right(text, F.lit(_WHOLE))).otherwise(text)


def _offered(large: DataFrame, small: DataFrame) -> DataFrame:
    """``large`` with a row per piece (``_piece``) of its texts (``_text``) that may be a text of ``small`` or the end of a long one.

    Pieces are as long as a text that is looked for, so an equal one is a find and not a candidate, however much texts
    have in common. Those that a filter of fixed size rules out make no row. A text has at most 64 pieces per character.
    """
    asked = small.select(_piece(F.col("_text")).alias("_piece"))
    slot = F.pmod(F.xxhash64("_piece"), F.lit(_SLOTS))
    sizes = asked.agg(F.array_sort(F.collect_set(F.length("_piece")))).scalar()
    used = asked.groupBy(F.shiftright(slot, 6).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("_bits"))
    every = small.sparkSession.range(_SLOTS >> 6).join(used, "id", "left").select(F.struct("id", F.coalesce("_bits", F.lit(0).cast("long")).alias("bits")).alias("_w"))
    held = every.agg(F.transform(F.array_sort(F.collect_list("_w")), lambda w: w["bits"])).scalar()
    text, n = F.col("_text"), F.col("_n")
    sized = large.withColumn("_sizes", sizes).select("*", F.explode("_sizes").alias("_n")).filter(n <= F.length(text)).drop("_sizes")
    starts = F.sequence(F.lit(1), F.when(n == 0, 1).otherwise(F.length(text) - n + 1))
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))
    word = F.get(held, F.shiftright(slot, 6).cast("int"))
    return sized.select(*large.columns, F.explode(pieces).alias("_piece")).filter(F.getbit(word, (slot % 64).cast("int")) == 1)


def _best_around(asked: DataFrame, named: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, _text, _row``: for every text of ``asked`` the first row of the texts of ``named`` that it occurs in."""
    offered = _offered(named, asked).withColumn("_large", F.when(F.length("_text") > _WHOLE, F.col("_text")))
    texts = asked.select(*key, "_text").distinct().withColumn("_piece", _piece(F.col("_text")))
    long = F.length("_text") > _WHOLE
    first = offered.groupBy(*key, "_piece").agg(F.min("_row").alias("_row"))
    whole = first.join(texts.filter(~long), [*key, "_piece"]).select(*key, "_text", "_row")
    ends = offered.filter(F.col("_large").isNotNull() & (F.length("_piece") == _WHOLE)).select(*key, "_piece", "_large", "_row")
    apart = ends.join(texts.filter(long), [*key, "_piece"]).filter(F.contains("_large", "_text"))
    return whole.unionByName(apart.groupBy(*key, "_text").agg(F.min("_row").alias("_row")))


def _best_inside(asked: DataFrame, named: DataFrame, key: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """``key, _text, _row``: for every text of ``asked`` the first row of the texts of ``named`` that occur in it.

    A text that several rules have is cut into pieces once; the bits of a number say which rules have it.
    """
    texts = asked.groupBy(*scope, "_text").agg(F.bit_or(F.expr("shiftleft(1L, _rule)")).alias("_rules"))
    offered = _offered(texts, named)
    names = named.select(*key, F.col("_text").alias("_small"), _piece(F.col("_text")).alias("_piece"), "_row")
    inside = (F.length("_small") <= _WHOLE) | F.contains("_text", "_small")
    found = offered.join(names, [*scope, "_piece"]).filter((F.getbit("_rules", F.col("_rule")) == 1) & inside)
    return found.groupBy(*key, "_text").agg(F.min("_row").alias("_row"))


def resolve_names(
    left: DataFrame,
    right: DataFrame,
    left_key: Sequence[str],
    ordinal: str,
    columns: Sequence[str],
    rules: Sequence[Rule],
    scope: Sequence[str] = (),
) -> DataFrame:
    """Left rows with the best matching right row, unmatched ones kept with nulls (JOIN9-JOIN11).

    The lowest tier wins, within a tier the first (or last) right row by ``ordinal``. "Occurs in" is looked up
    by pieces of the texts (``_offered``), and only the best row per text goes on. ``scope`` columns must agree on both sides
    (a season, say).
    """
    key = [*scope, "_rule"]
    asked, offered = [], []
    for i, rule in enumerate(rules):
        rank = F.col(ordinal).cast("long") if rule.pick == "first" else -F.col(ordinal).cast("long")
        row = F.struct(F.lit(rule.tier).alias("tier"), rank.alias("rank"), *columns)
        asked.append(left.select(*dict.fromkeys([*left_key, *scope]), F.lit(i).alias("_rule"), rule.left.alias("_text")))
        offered.append(right.select(*scope, F.lit(i).alias("_rule"), rule.right.alias("_text"), row.alias("_row")))
    # all rules at once, each within its number
    wanted = reduce(DataFrame.unionByName, asked).filter(F.col("_text").isNotNull())
    named = reduce(DataFrame.unionByName, offered).filter(F.col("_text").isNotNull())
    named = named.groupBy(*key, "_text").agg(F.min("_row").alias("_row"))

    def of(*kinds: str) -> Column:
        return F.col("_rule").isin([i for i, rule in enumerate(rules) if rule.kind in kinds])

    best = wanted.filter(of("equal")).join(named, [*key, "_text"]).select(*left_key, "_row")
    pairs = []
    if any(rule.kind == "left_in_right" for rule in rules):
        pairs.append(_best_around(wanted.filter(of("left_in_right")), named.filter(of("left_in_right")), key))
    if any(rule.kind == "right_in_left" for rule in rules):
        pairs.append(_best_inside(wanted.filter(of("right_in_left")), named.filter(of("right_in_left")), key, scope))
    for found in pairs:
        best = best.unionByName(wanted.join(found, [*key, "_text"]).select(*left_key, "_row"))
    chosen = best.groupBy(*left_key).agg(F.min("_row").alias("_row"))
    return left.join(chosen, list(left_key), "left").select(
        *left.columns,
        F.col("_row.tier").alias("match_tier"),
        *[F.col("_row")[c].alias(f"match_{c}") for c in columns],
    )


def schedule_with_circuits(schedule: DataFrame, circuits: DataFrame) -> DataFrame:
    """Events with the coordinates of their circuit (JOIN9).

    Circuit name or id against the location, else locality, else "locality, country"; per year.
    """
    place = F.lower("Location")
    rules = [
        Rule(1, kind, place, F.lower(F.col(c)))
        for c in ("circuitName", "circuitId")
        for kind in ("left_in_right", "right_in_left")
    ]
    rules += [
        Rule(2, "equal", place, F.lower("locality"), pick="last"),
        Rule(
            3,
            "equal",
            F.lower(F.concat(F.col("Location"), F.lit(", "), F.col("Country"))),
            F.lower(F.concat(F.col("locality"), F.lit(", "), F.col("country"))),
            pick="last",
        ),
    ]
    columns = ["latitude", "longitude", "locality", "circuitId"]
    found = resolve_names(schedule, circuits, ["Year", "RoundNumber"], "ordinal", columns, rules, scope=["Year"])
    return found.select(
        "Year",
        F.col("RoundNumber").alias("round"),
        F.col("EventName").alias("name"),
        F.col("Country").alias("country"),
        F.col("Location").alias("location"),
        F.date_format("EventDate", "yyyy-MM-dd").alias("date"),
        F.col("match_latitude").alias("lat"),
        F.col("match_longitude").alias("long"),
        F.col("match_locality").alias("locality"),
        F.col("match_circuitId").alias("circuitId"),
        "match_tier",
    )


def source_event(
    requests: DataFrame, schedule: DataFrame, key: Sequence[str], text: str, scope: Sequence[str] = ()
) -> DataFrame:
    """Past event for a requested name: event name either way, else location or country (JOIN10)."""
    wanted = F.lower(text)
    rules = [Rule(1, kind, wanted, F.lower("EventName")) for kind in ("left_in_right", "right_in_left")]
    rules += [Rule(2, "left_in_right", wanted, F.lower(c)) for c in ("Location", "Country")]
    return resolve_names(requests, schedule, key, "RoundNumber", ["EventName"], rules, scope)


def find_event(
    requests: DataFrame, schedule: DataFrame, key: Sequence[str], text: str, scope: Sequence[str] = ()
) -> DataFrame:
    """Event for a typed name or round number; unmatched requests keep nulls (JOIN11)."""
    rules = [
        Rule(1, "left_in_right", F.lower(text), F.lower("EventName")),
        Rule(
            2,
            "equal",
            F.trim(text).try_cast("int").cast("string"),
            F.col("RoundNumber").cast("string"),
        ),
    ]
    return resolve_names(requests, schedule, key, "RoundNumber", ["EventName", "RoundNumber"], rules, scope)


def by_driver_number(samples: DataFrame, driver_info: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples keyed by car number with the driver code beside them (JOIN12)."""
    codes = (
        driver_info.filter(F.col("Driver").isNotNull() & F.col("DriverNumber").isNotNull())
        .groupBy(*keys, "DriverNumber")
        .agg(F.max("Driver").alias("DriverCode"))
    )
    return samples.withColumn("DriverNumber", F.col("Driver")).join(codes, [*keys, "DriverNumber"])


def drivers_present(series: Sequence[DataFrame], driver_info: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every car number seen in any series, with details or stand-ins for them (JOIN13, SET2)."""
    numbers = None
    for df in series:
        part = df.select(*keys, F.col("Driver").alias("DriverNumber")).distinct()
        numbers = part if numbers is None else numbers.union(part)
    details = driver_info.groupBy(*keys, "DriverNumber").agg(
        F.max(F.struct("Driver", "FullName", "TeamName", "TeamID")).alias("_d")
    )
    known = F.col("_d.Driver").isNotNull()
    number = F.col("DriverNumber")
    return numbers.distinct().join(details, [*keys, "DriverNumber"], "left").select(
        *keys,
        F.coalesce(F.col("_d.Driver"), number).alias("Driver"),
        "DriverNumber",
        F.when(known, F.col("_d.FullName")).otherwise(F.concat(F.lit("Driver "), number)).alias("FullName"),
        F.col("_d.TeamName").alias("TeamName"),
        F.coalesce(F.col("_d.TeamID"), F.lit(0)).alias("TeamID"),
        F.when(known, F.concat_ws(" - ", F.col("_d.Driver"), F.col("_d.FullName")))
        .otherwise(F.concat(F.lit("Driver #"), number))
        .alias("DisplayName"),
    )


def exact_or_wider(df: DataFrame, exact: Column, group: Sequence[str]) -> DataFrame:
    """Rows meeting the exact test; groups with none of them keep all their rows (JOIN16)."""
    marked = df.withColumn("_exact", F.coalesce(exact, F.lit(False)))
    any_exact = marked.groupBy(*group).agg(F.bool_or("_exact").alias("_any"))
    return (
        marked.join(any_exact, list(group), "left")
        .filter(F.col("_exact") | ~F.col("_any"))
        .select(*df.columns)
    )


def prefer(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary rows, plus fallback rows of the keys the primary lacks (JOIN17)."""
    covered = primary.select(*keys).distinct()
    return primary.unionByName(fallback.join(covered, list(keys), "left_anti"), allowMissingColumns=True)


def race_parameters(df: DataFrame, race: str = "GrandPrix", table: dict | None = None) -> DataFrame:
    """Laps, average lap and tyre factor of a race, with the default row for others (JOIN18)."""
    table = K.RACE_PARAMETERS if table is None else table
    fields = ("TotalLaps", "AvgLap", "TyreFactor")
    return df.withColumns(
        {
            f: lookup({r: float(v[i]) for r, v in table.items()}, F.col(race), F.lit(float(K.DEFAULT_RACE_PARAMETERS[i])))
            for i, f in enumerate(fields)
        }
    )


def race_laps(sessions: DataFrame, laps: DataFrame, keys: Sequence[str] = ("Year", "GrandPrix", "SessionType")) -> DataFrame:
    """Laps of each session: its largest lap number, else the table, else the default (AGG4)."""
    known = laps.groupBy(*keys).agg(F.max("LapNumber").alias("_max"))
    table = {r: float(n) for r, n in K.RACE_LAPS.items()}
    return sessions.select(*keys).distinct().join(known, list(keys), "left").select(
        *keys,
        F.coalesce("_max", lookup(table, F.col("GrandPrix"), F.lit(float(K.DEFAULT_RACE_LAPS)))).alias("TotalLaps"),
    )
