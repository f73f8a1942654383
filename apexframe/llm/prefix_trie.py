"""The trie of all beginnings that conversations share, with subtree totals.

A beginning is known by its length and by four sums over its turns, of numbers that a digest of place, role and text gives. Sums can
be continued, so a conversation of any length is cut into ranges of turns and no task holds it whole. A node is named
by its smallest member and its depth. Totals come from ``forward``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import settle
from .common import slices, small_batches
from .forward import LEAST_NODES, QUEUE_MESSAGES, SHARD_NODES, subtree_totals

#: Sums that name a beginning; each is of numbers of 32 bits, so it holds for 2 ** 31 turns.
_SUMS = ["s0", "s1", "s2", "s3"]
_KEY = ["depth", *_SUMS]
#: Ids of a node that are put into one text.
IDS_AT_ONCE = 4096


def _running(rows: DataFrame, key: str, order: Sequence[str], number: str, sums: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their place per key (from 1), and running sums in place of ``sums``.

    The rows are sorted by ranges of key and order, so a key of any size is spread over several ranges; what the ranges before
    hold of a key is added within each.
    """
    sorted_rows = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = settle(sorted_rows.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftrightunsigned("_place", 33))
    totals = placed.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_{c}") for c in sums))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_part", key, *(F.sum(c).over(before).alias(c) for c in ("_n", *(f"_{c}" for c in sums)))).filter("_n IS NOT NULL")
    upto = Window.partitionBy("_part", key).orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {number: F.count(F.lit(1)).over(upto) + F.coalesce("_n", F.lit(0))}
    out |= {c: F.sum(c).over(upto) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}
    return placed.join(carry, ["_part", key], "left").withColumns(out).select(*rows.columns, *([number] if number not in rows.columns else []))


def turns(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, pos`` (from 1, in the order of the turns, null first), ``sha`` of role and text, and ``bytes`` of the text.

    Null roles and texts are empty. Equal turns of a conversation go by role, then by that digest. Rows without a
    conversation are left out.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    by = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = table.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), by.alias("role"),
        F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said), 256).alias("sha"), F.octet_length(said).cast("long").alias("bytes"),
    )
    return _running(rows, "conv", ["turn", "role", "sha"], "pos").select("conv", "pos", "sha", "bytes")


def sharing(placed: DataFrame, group: int = 5, cycle: int = 9) -> DataFrame:
    """Conversations that share beginnings, from those of ``turns``: conversation c starts with the first h turns of
    c - c % ``group``, h being the CRC-32 of its decimal id modulo ``cycle``, and goes on with its own turns after its first h.

    ``conv, pos, sha, bytes`` again; conversations without a turn have no row.
    """
    sizes = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % cycle
    wide = sizes.select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), h.alias("h"))
    known = settle(wide.join(sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size")), "base", "left"))
    taken = F.least("h", F.coalesce("base_size", F.lit(0)))
    firsts = placed.filter((F.col("pos") < cycle) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    begun = firsts.join(known, "base").filter("pos <= h").select("conv", "pos", "sha", "bytes")
    # both sides are exchanges of written tables, so that a long conversation can be split
    gone_on = placed.join(known, "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + taken).alias("pos"), "sha", "bytes")
    return begun.unionByName(gone_on)


def _number(place: Column, sha: Column, i: int) -> Column:
    """The ``i``-th number of 32 bits of a turn at its place."""
    return F.conv(F.substring(F.sha2(F.concat(place.cast("string"), F.lit(":"), sha), 256), 8 * i + 1, 8), 16, 10).cast("long")


_IDS = "depth long, s0 long, s1 long, s2 long, s3 long, first long, ids string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ends -> texts of up to ``IDS_AT_ONCE`` ids of one node."""
    at, ids = None, []
    for batch in slices(batches, 4096):
        out = []
        for *key, conv in zip(*(batch[c].to_pylist() for c in (*_KEY, "conv"))):
            if key != at or len(ids) == IDS_AT_ONCE:
                if ids:
                    out.append((*at, ids[0], ",".join(map(str, ids))))
                at, ids = key, []
            ids.append(conv)
        if out:
            yield _texts(out)
    if ids:
        yield _texts([(*at, ids[0], ",".join(map(str, ids)))])


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _IDS.split(", ")])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts of ids -> a digest per node, which is fed text by text."""
    at, state = None, None

    def row(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), [*[pa.int64()] * 5, pa.string()])], [*_KEY, "ends_sha256"])

    for batch in slices(batches, 256):
        out = []
        for *key, ids in zip(*(batch[c].to_pylist() for c in (*_KEY, "ids"))):
            if key != at:
                if at:
                    out.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield row(out)
    if at:
        yield row([(*at, state.hexdigest())])


def ends(last: DataFrame) -> DataFrame:
    """Per beginning (``depth, s0..s3``) the digest of the ids of the conversations that end there.

    A digest is taken in one task, as it must be, but over texts of many ids, which were sorted and joined in ranges.
    """
    tasks = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = last.repartitionByRange(tasks, *_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    texts = ranges.mapInArrow(_joined, _IDS)
    return texts.repartition(tasks, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digested, ", ".join(f"{c} long" for c in _KEY) + ", ends_sha256 string")


def trie(placed: DataFrame, ids: DataFrame, shard_nodes: int = SHARD_NODES, least_nodes: int = LEAST_NODES, queue_messages: int = QUEUE_MESSAGES) -> DataFrame:
    """The nodes of the trie of conversations ``placed`` (``conv, pos, sha, bytes``); ``ids`` has a row ``conv`` per
    conversation, those without a turn included.

    ``conv_id`` (smallest member), ``depth, parent_conv_id`` (null for the root), ``n_convs`` (members), ``n_children``,
    ``n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (over the subtree, bytes of the last text for each
    member but one) and ``ends_sha256`` (of the ids of the conversations that end here). No conversations, no rows.
    """
    spark = placed.sparkSession
    small_batches(placed)
    numbers = placed.select("conv", "pos", "bytes", *(_number(F.col("pos"), F.col("sha"), i).alias(f"t{i}") for i in range(4)))
    summed = _running(numbers.withColumns({s: F.col(f"t{i}") for i, s in enumerate(_SUMS)}), "conv", ["pos"], "depth", _SUMS)
    paths = settle(summed.select("conv", "depth", "bytes", *_SUMS, *((F.col(s) - F.col(f"t{i}")).alias(f"up_{s}") for i, s in enumerate(_SUMS))))
    members = ids.agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if not members["n"]:
        return spark.createDataFrame([], _TRIE)
    # all members of a node agree in its text and its parent
    alike = [F.max(c).alias(c) for c in ("bytes", *(f"up_{s}" for s in _SUMS))]
    below = settle(paths.groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), *alike))
    named = below.select((F.col("depth") + 1).alias("depth"), *(F.col(s).alias(f"up_{s}") for s in _SUMS), F.col("conv").alias("up"))
    deep = below.filter("depth > 1").join(named, ["depth", *(f"up_{s}" for s in _SUMS)])
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    zero = F.lit(0).cast("long")
    columns = lambda up: ["conv", "depth", up, "n_convs", saved.alias("saved"), *_SUMS]
    top = spark.range(1).select(
        F.lit(members["least"]).alias("conv"), zero.alias("depth"), F.lit(None).cast("long").alias("up"), F.lit(members["n"]).cast("long").alias("n_convs"), zero.alias("saved"), *(zero.alias(s) for s in _SUMS)
    )
    nodes = settle(deep.select(*columns(F.col("up"))).unionByName(below.filter("depth = 1").select(*columns(F.lit(members["least"]).alias("up")))).unionByName(top))
    shaped = nodes.select(F.col("conv").alias("a"), F.col("depth").alias("b"), F.col("up").alias("up_a"), F.when(F.col("up").isNotNull(), F.col("depth") - 1).alias("up_b"), "saved")
    totals = subtree_totals(shaped, shard_nodes, least_nodes, queue_messages=queue_messages)
    last = paths.groupBy("conv").agg(F.max(F.struct(*_KEY)).alias("k"))
    ended = settle(ids.join(last, "conv", "left").select("conv", *(F.coalesce(F.col("k")[c], zero).alias(c) for c in _KEY)))
    found = nodes.join(totals.toDF("conv", "depth", "n_children", "n_leaves", "saved_tokens"), ["conv", "depth"]).join(ends(ended), _KEY, "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


_TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **kw) -> DataFrame:
    """The trie of the conversations of a table as they are; for columns and defined cases see ``trie`` and ``turns``.

    Repeated rows are turns of their own. Texts and conversations may be of any length; other columns are ignored.
    """
    placed = settle(turns(table, conv, turn, role, text))
    return trie(placed, settle(placed.select("conv").distinct()), **kw)


def shared_prefix_trie(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **kw) -> DataFrame:
    """The trie of the conversations that ``sharing`` makes of a table's."""
    placed = settle(turns(table, conv, turn, role, text))
    return trie(settle(sharing(placed)), settle(placed.select("conv").distinct()), **kw)
