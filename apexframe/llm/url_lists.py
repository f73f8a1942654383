"""Captures against dated URL lists, with DataFrame functions only.

A list is a log of dated entries for keys: a whole address, a host, or a domain with all hosts below it. Entries become
validity intervals: an entry holds from its date until the next one for its key, or until it expires; a later entry
replaces an earlier one for good, unless ``resume`` asks for the newest entry that has not expired. Every capture
is looked up as of its fetch time under each key that covers its address, and the most specific active entry decides.

The as-of join merges entries and captures in time order per key and carries the last entry forward, in chunks
along time, so entries and captures are not paired and a host with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import disjoint_segments
from ..operators.ordered import scan, settle

#: Actions; of entries for one key at one time, the later in this list holds.
ACTIONS = ("remove", "allow", "block")


def address(url: Column) -> Column:
    """Host in lower case and path, without scheme, port, query, fragment and a slash at the end; null if there is no host."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.concat(host(url), path)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def covering_keys(url: Column) -> Column:
    """Keys that cover an address with their rank: the address itself, then its domains from the host up to two labels."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.least(F.lit(2), n), n),
        lambda k: F.struct(k.alias("rank"), F.concat(F.lit("domain:"), F.array_join(F.slice(labels, n - k + 1, k), ".")).alias("key")),
    )
    whole = F.array(F.struct(F.lit(1 << 20).alias("rank"), F.concat(F.lit("address:"), address(url)).alias("key")))
    return F.when(host(url).isNotNull() & (host(url) != ""), F.concat(whole, domains))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``key, start, stop, action`` (microseconds, ``stop`` excluded, null without an end).

    Entries are ``key, action, listed_at, expires_at``. Of entries for one key at one time, the one of the last action
    in ``ACTIONS`` holds, then the one that expires last. Entries without a key, a known action or a date are left out.
    """
    order = F.array_position(F.array(*(F.lit(a) for a in ACTIONS)), F.col("action"))
    dated = entries.select("key", "action", micros(F.col("listed_at")).alias("start"), micros(F.col("expires_at")).alias("expires"))
    best = F.max(F.struct(order.alias("order"), F.col("expires").isNull().alias("open"), "expires", "action"))
    single = settle(
        dated.filter(F.col("key").isNotNull() & F.col("start").isNotNull() & F.col("action").isin(*ACTIONS))
        .groupBy("key", "start").agg(best.alias("best")).select("key", "start", "best.expires", "best.action")
    )
    following = scan(single, ["key"], [-F.col("start")], last_before={"next": F.col("start")})
    return following.select("key", "start", F.least("next", "expires").alias("stop"), "action")


def newest_unexpired(entries: DataFrame) -> DataFrame:
    """Intervals ``key, at, start, stop, action`` from ``at`` on, each with the newest entry of the key that has not expired then.

    An entry that another one covered for a time holds again after that. Of entries for one key at one time, the one of
    the last action in ``ACTIONS`` holds until it expires, then the other. Where none holds, the action is to remove.
    """
    order = F.array_position(F.array(*(F.lit(a) for a in ACTIONS)), F.col("action"))
    end = F.coalesce(micros(F.col("expires_at")) - 1, F.lit(1 << 60))
    spans = settle(
        entries.select("key", micros(F.col("listed_at")).alias("_s"), end.alias("_e"), "action", (-order).alias("order"))
        .filter(F.col("key").isNotNull() & F.col("action").isin(*ACTIONS) & (F.col("_s") <= F.col("_e")))
        .select("key", "_s", "_e", F.struct((-F.col("_s")).alias("back"), "order", "action").alias("entry")).distinct()
    )
    held = settle(disjoint_segments(spans, ["key"], "entry"))
    return held.select(
        "key", F.col("_at").alias("at"), F.coalesce(-F.col("_payload.back"), "_at").alias("start"), F.lit(None).cast("long").alias("stop"),
        F.coalesce("_payload.action", F.lit("remove")).alias("action"),
    )


def as_of(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows of ``captures`` (with ``key, at``) with ``entry``: the interval of the key that started last, at ``at`` or before.

    An interval starts with its entry, or at ``at`` if it has one.
    """
    points = captures.withColumns({"point": F.lit(1), "entry": F.lit(None).cast("struct<start: bigint, stop: bigint, action: string>")})
    edges = intervals.select("key", F.col("at" if "at" in intervals.columns else "start").alias("at"), F.lit(0).alias("point"), F.struct("start", "stop", "action").alias("entry"))
    merged = settle(points.unionByName(edges, allowMissingColumns=True))
    return scan(merged, ["key"], [F.col("at"), F.col("point")], last={"entry": F.col("entry")}).filter("point = 1").drop("point")


def judged(captures: DataFrame, entries: DataFrame, row_id: str = "page_id", url: str = "url", fetched_at: str = "fetched_at", resume: bool = False) -> DataFrame:
    """One row per capture: ``page_id, fetched`` (microseconds), ``verdict`` (block, allow or none), and the deciding
    entry's ``key`` and ``listed`` date (null for none).

    An entry is active from its date until its interval stops; entries that remove never decide, they only end what was.
    With ``resume``, a later entry of a key hides an earlier one only until it expires itself.
    The most specific active key decides. Captures without a host or fetch time have the verdict none. Null ids and
    repeated rows are rows like others, other columns are ignored, an empty table gives none. Of entries of one key and
    date, block goes before allow before remove. Addresses of any length are compared whole.
    """
    rows = captures.select(
        F.col(row_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), micros(F.col(fetched_at)).alias("at"),
        F.monotonically_increasing_id().alias("row"),
    )
    nothing = F.array(F.struct(F.lit(0).alias("rank"), F.lit(None).cast("string").alias("key")))
    keys = F.when(F.col("at").isNotNull(), covering_keys(F.col("url")))
    asked = rows.select("page_id", "at", "row", F.inline(F.concat(F.coalesce(keys, nothing.cast("array<struct<rank: int, key: string>>")), nothing)))
    # every capture also has a row without a key, which waits aside and keeps it in the result
    asked = settle(asked)
    intervals = newest_unexpired(entries) if resume else validity(entries)
    found = as_of(asked.filter("key IS NOT NULL"), intervals).unionByName(
        asked.filter("key IS NULL").withColumn("entry", F.lit(None).cast("struct<start: bigint, stop: bigint, action: string>"))
    )
    entry = F.col("entry")
    active = entry.isNotNull() & (entry["stop"].isNull() | (F.col("at") < entry["stop"])) & (entry["action"] != "remove")
    best = F.max(F.when(active, F.struct("rank", entry["action"].alias("action"), "key", entry["start"].alias("listed")))).alias("best")
    return found.groupBy("row", "page_id", "at").agg(best).select(
        "page_id", F.col("at").alias("fetched"), F.coalesce("best.action", F.lit("none")).alias("verdict"), "best.key", "best.listed"
    )
