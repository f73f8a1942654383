"""Subtree totals of a forest of any shape by time-forward processing.

Nodes have a name of two numbers, ``a`` and a level ``b``; a parent's level is lower than its child's. Sorted by reverse level,
every node comes after its children, which have sent it their totals through a priority queue that is ordered by the place of
the receiver; the queue spills sorted runs to shared storage.

The nodes are cut into shards along (a, b), so that a shard has a bounded number of them whatever their shape, and every
shard is processed by itself. What goes to a parent in another shard is added up per parent. These parents form a smaller
forest: all of them in one connected piece of a shard hang on the parent of that piece. Its totals are found the same way,
with fewer shards, and enter the shards of the first forest, which are then processed once more.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import chunk, scratch, settle
from .common import slices
from .warc import store

#: Nodes of a shard, about: at most, and at least while there are fewer shards than shuffle partitions.
SHARD_NODES = 1 << 18
LEAST_NODES = 1 << 12
#: Shards of a forest for one of the forest of their parents, at least.
FAN_IN = 8
#: Messages that a queue holds in memory.
QUEUE_MESSAGES = 1 << 16
_RUN_ROWS = 1 << 10


class Queue:
    """Messages ``(place, ...)`` that come out in order of their place; every place is taken after all smaller ones."""

    def __init__(self, folder: str, limit: int = QUEUE_MESSAGES):
        self._folder, self._limit = folder, limit
        self._heap: list[tuple] = []
        self._heads: list[tuple] = []
        self._files: list[str] = []
        self._n = 0

    def push(self, place: tuple, message: tuple) -> None:
        # a number of its own keeps messages from being compared
        self._n += 1
        heapq.heappush(self._heap, (place, self._n, message))
        if len(self._heap) >= self._limit:
            self._spill()

    def _spill(self) -> None:
        self._heap.sort()
        files, top = store(self._folder)
        files.create_dir(top, recursive=True)
        path = f"{top}/run-{uuid.uuid4().hex}"
        with files.open_output_stream(path) as out:
            for i in range(0, len(self._heap), _RUN_ROWS):
                out.write(pickle.dumps(self._heap[i : i + _RUN_ROWS]))
        self._files.append(path)
        self._heap = []
        self._advance(self._rows(files, path))

    @staticmethod
    def _rows(files, path: str) -> Iterator[tuple]:
        with files.open_input_stream(path) as source:
            while True:
                try:
                    yield from pickle.load(source)
                except EOFError:
                    return

    def _advance(self, run: Iterator[tuple]) -> None:
        row = next(run, None)
        if row is not None:
            heapq.heappush(self._heads, (row[0], row[1], row[2], run))

    def take(self, place: tuple) -> Iterator[tuple]:
        """The messages for a place."""
        while self._heap and self._heap[0][0] == place:
            yield heapq.heappop(self._heap)[2]
        while self._heads and self._heads[0][0] == place:
            _, _, message, run = heapq.heappop(self._heads)
            yield message
            self._advance(run)

    def close(self) -> None:
        """Delete the runs; there must be no message left."""
        if self._heap or self._heads:
            raise RuntimeError("a message to a node that does not come")
        files, _ = store(self._folder)
        for path in self._files:
            files.delete_file(path)


_IN = ["shard", "b", "a", "up_a", "up_b", "inside", "awaits", "childless_counts", "children", "leaves", "saved"]
_CROSSING = "a long, b long, up_a long, up_b long, children long, leaves long, saved long"


def _forward(folder: str, limit: int, visit):
    """Rows by shard and reverse level; ``visit(row, children, leaves, saved, below)`` gives the rows to put out.

    ``below`` are the nodes below a node, in its shard, that await totals from other shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        at, queue = None, None
        for batch in slices(batches, 4096):
            out = []
            for row in zip(*(batch[c].to_pylist() for c in _IN)):
                shard, b, a, up_a, up_b, inside, awaits, childless_counts, children, leaves, saved = row
                if shard != at:
                    if queue:
                        queue.close()
                    at, queue = shard, Queue(folder, limit)
                below = [(a, b)] if awaits else []
                for more, more_leaves, more_saved, named in queue.take((-b, a)):
                    children, leaves, saved = children + more, leaves + more_leaves, saved + more_saved
                    if named:
                        # the shorter list goes to the longer one
                        below, named = (below, named) if len(below) >= len(named) else (named, below)
                        below.extend(named)
                if not children and not awaits and childless_counts:
                    leaves += 1
                if inside:
                    queue.push((-up_b, up_a), (1, leaves, saved, below))
                out.extend(visit(row, children, leaves, saved, below))
            if out:
                yield out
        if queue:
            queue.close()

    return run


def _crossing(folder: str, limit: int):
    """What leaves a shard: totals for a parent outside, and the parents inside that hang on it."""

    def visit(row, children, leaves, saved, below):
        up_a, up_b, inside = row[3:6]
        if not inside:
            if up_a is not None:
                yield (up_a, up_b, None, None, 1, leaves, saved)
            for a, b in below:
                yield (a, b, up_a, up_b, None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _forward(folder, limit, visit)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in _CROSSING.split(", ")])

    return run


def _final(folder: str, limit: int):
    def visit(row, children, leaves, saved, below):
        yield (row[2], row[1], children, leaves, saved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _forward(folder, limit, visit)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "children", "leaves", "saved"])

    return run


def subtree_totals(nodes: DataFrame, shard_nodes: int = SHARD_NODES, least_nodes: int = LEAST_NODES, most_shards: int | None = None, queue_messages: int = QUEUE_MESSAGES) -> DataFrame:
    """``a, b, children, leaves, saved`` of every node: its children, the childless nodes of its subtree, and the sum of
    ``saved`` over its subtree.

    ``nodes``: ``a, b, up_a, up_b`` (null for a node without a parent), ``saved``, all long; (a, b) is unique, every
    parent is a node, and ``up_b < b``. It should be a written table, as several passes read it.
    """
    first = nodes.select("a", "b", "up_a", "up_b", F.lit(True).alias("childless_counts"), *(F.lit(0).cast("long").alias(c) for c in ("children", "leaves")), "saved")
    return _totals(first, shard_nodes, least_nodes, most_shards, queue_messages)


def _totals(nodes: DataFrame, shard_nodes: int, least_nodes: int, most_shards: int | None, limit: int) -> DataFrame:
    spark = nodes.sparkSession
    folder = f"{scratch(spark)}/apexframe-queues-{uuid.uuid4().hex}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = nodes.count()
    shards = max(-(-count // shard_nodes), min(tasks, count // least_nodes), 1)
    shards = shards if most_shards is None else min(shards, most_shards)

    def processed(rows: DataFrame, step, schema: str) -> DataFrame:
        dealt = rows.select(*_IN).repartition(tasks, "shard").sortWithinPartitions("shard", F.desc("b"), "a")
        return dealt.mapInArrow(step(folder, limit), schema)

    totals = "a long, b long, children long, leaves long, saved long"
    if shards == 1:
        alone = nodes.withColumns({"shard": F.lit(0).cast("long"), "inside": F.col("up_a").isNotNull(), "awaits": F.lit(False)})
        return processed(alone, _final, totals)
    shard = F.shiftleft(F.col("_c1").cast("long"), 32).bitwiseOR(F.col("_c2").cast("long"))
    cut = settle(chunk(nodes, [F.col("a"), F.col("b")], shards).withColumn("shard", shard).drop("_c1", "_c2"))
    parents = cut.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("shard").alias("up_shard"))
    edges = settle(cut.join(parents, ["up_a", "up_b"], "left").withColumn("inside", F.coalesce(F.col("up_shard") == F.col("shard"), F.lit(False))))
    outside = edges.filter("up_a IS NOT NULL AND NOT inside").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct()
    flagged = settle(edges.join(outside.withColumn("awaits", F.lit(True)), ["a", "b"], "left").withColumn("awaits", F.coalesce("awaits", F.lit(False))))
    crossing = settle(processed(flagged, _crossing, _CROSSING))
    sums = crossing.filter("children IS NOT NULL").groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
    hangs = crossing.filter("children IS NULL").select("a", "b", "up_a", "up_b")
    upper = settle(sums.join(hangs, ["a", "b"], "left"))
    solved = _totals(upper.withColumn("childless_counts", F.lit(False)), shard_nodes, least_nodes, max(1, shards // FAN_IN), limit)
    more = upper.select("a", "b", F.col("children").alias("more")).join(solved.select("a", "b", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved")), ["a", "b"])
    filled = flagged.join(more, ["a", "b"], "left").withColumns({c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("children", "more"), ("leaves", "more_leaves"), ("saved", "more_saved"))})
    return processed(filled.withColumn("awaits", F.lit(False)), _final, totals)
