"""Exact deduplication by an extendible-hash index on shared files.

A text's key is a 64-bit hash of its normalised form, a bucket is the range of all keys with a common prefix, and
the directory maps the first bits of a key to its bucket. The directory starts with one bucket; a bucket whose distinct
texts exceed ``bucket_bytes`` is split by its next bit, and the directory doubles whenever a split needs a longer prefix
than it has. One owner task gets all keys of a bucket, walks them in key order, keeps a chain of the different texts of
one key and compares bytes along it, and writes the entries of its range to the index.

Copies are combined before they are shuffled, so a text that fills a third of the table reaches its owner as a few rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import scratch, settle
from .common import keep_rows, row_key, slices, small_batches, squeezed, texts_of

#: Distinct texts of a bucket, in bytes.
BUCKET_BYTES = 64 << 20
#: Bits by which the key counts get finer per look at the data; a look brings at most 2 ** LOOK_BITS rows per overfull bucket.
LOOK_BITS = 8
#: Copies are combined over so many bytes of text within a map task.
COMBINE_BYTES = 8 << 20
#: The directory has at most 2 ** MAX_BITS entries of four bytes. A bucket of that depth is not split any more; its owner
#: still streams through it in key order, so it may be of any size.
MAX_BITS = 22

_ENTRY = "bucket int, key long, keep_id long, group_size long, sha binary, chain int"


def prefix(key, bits: int):
    """The first bits of a key as a number; 0 for no bits."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_bytes: int) -> np.ndarray:
    """Bucket number by prefix, for distinct keys with their ``bytes``; its length is a power of two.

    Buckets are numbered in key order. The sizes of ever longer prefixes are looked up for overfull buckets only.
    """
    leaves: dict[tuple[int, int], int] = {}  # (bits, prefix) -> bytes, of buckets that are small enough
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    overfull = [(0, 0)] if total > bucket_bytes else []
    if not overfull:
        leaves[0, 0] = total
    while overfull:
        bits = overfull[0][0]
        finer = min(bits + LOOK_BITS, MAX_BITS)
        wanted = keys.sparkSession.createDataFrame([(p,) for _, p in overfull], "top long")
        counted = (
            keys.select(prefix(F.col("key"), bits).alias("top"), prefix(F.col("key"), finer).alias("p"), "bytes")
            .join(wanted, "top", "left_semi").groupBy("p").agg(F.sum("bytes").alias("bytes")).collect()
        )
        sizes = {(finer, row["p"]): row["bytes"] for row in counted}
        for b in range(finer - 1, bits, -1):
            for (_, p), n in [(k, n) for k, n in sizes.items() if k[0] == b + 1]:
                sizes[b, p >> 1] = sizes.get((b, p >> 1), 0) + n
        overfull, splitting = [], overfull
        while splitting:
            b, p = splitting.pop()
            for half in ((b + 1, 2 * p), (b + 1, 2 * p + 1)):
                n = sizes.get(half, 0)
                if n <= bucket_bytes or half[0] == MAX_BITS:
                    leaves[half] = n
                elif half[0] == finer:
                    overfull.append(half)
                else:
                    splitting.append(half)
    depth = max(b for b, _ in leaves)
    table = np.zeros(1 << depth, dtype=np.int32)
    for number, (b, p) in enumerate(sorted(leaves, key=lambda k: k[1] << (depth - k[0]))):
        table[p << (depth - b) : (p + 1) << (depth - b)] = number
    return table


def _combine(table: np.ndarray):
    """Map side: one row per distinct text and stretch of input, with its bucket."""
    shift = 64 - int(len(table)).bit_length() + 1

    def rows(held: dict) -> pa.RecordBatch:
        keys = np.array([k for k, _ in held], dtype=np.int64)
        tops = (keys.view(np.uint64) >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), dtype=np.int64)
        ids, counts = zip(*held.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(table[tops]), pa.array(keys), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array([t for _, t in held], pa.string())],
            ["bucket", "key", "first", "n", "text"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in slices(batches):
            for key, row_id, text in zip(batch["key"].to_pylist(), batch["id"].to_pylist(), texts_of(batch, "text")):
                if (key, text) in held:
                    first, n = held[key, text]
                    held[key, text] = (row_id if first is None else first if row_id is None else min(first, row_id), n + 1)
                else:
                    held[key, text] = (row_id, 1)
                    size += len(text)
            if size >= COMBINE_BYTES:
                yield rows(held)
                held, size = {}, 0
        if held:
            yield rows(held)

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner side: rows in key order; a key's different texts form a chain along which bytes are compared."""
    at, chain = None, []

    def entries():
        for number, (text, first, n) in enumerate(chain):
            yield (*at, first, n, hashlib.sha256(text).digest(), number)

    def out(found):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()))],
            ["bucket", "key", "keep_id", "group_size", "sha", "chain"],
        )

    for batch in slices(batches):
        found = []
        columns = [batch[c].to_pylist() for c in ("bucket", "key", "first", "n")]
        for bucket, key, first, n, text in zip(*columns, batch["text"].cast(pa.binary()).to_pylist()):
            if (bucket, key) != at:
                found.extend(entries())
                at, chain = (bucket, key), []
            for link in chain:
                if link[0] == text:
                    link[1] = first if link[1] is None else link[1] if first is None else min(first, link[1])
                    link[2] += n
                    break
            else:
                chain.append([text, first, n])
        if found:
            yield out(found)
    if chain:
        yield out(list(entries()))


def build_index(docs: DataFrame, row_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """The index table, and the keys of all rows (``id, key, sha, row_key, tag``; ``tag`` numbers the rows).

    Index: one row per distinct text with its bucket, key, place in the key's chain, digest, the smallest id and the
    number of rows. Null text counts as empty; a null id is larger than any other.
    """
    spark = docs.sparkSession
    base = small_batches(docs).select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("raw"), squeezed(F.col(text)).alias("text"))
    base = base.withColumn("key", F.xxhash64("text"))
    keys = settle(
        base.select(
            "id", "key", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("bytes"),
            row_key(F.col("id"), F.col("raw")).alias("row_key"), F.monotonically_increasing_id().alias("tag"),
        )
    )
    sizes = keys.groupBy("key").agg(F.max("bytes").alias("bytes"))
    table = directory(sizes, bucket_bytes)
    combined = base.select("key", "id", "text").mapInArrow(_combine(table), "bucket int, key long, first long, n long, text string")
    folder = f"{scratch(spark)}/apexframe-index-{uuid.uuid4().hex}"
    # a task per bucket, or several buckets in turn if there are more of them than shuffle partitions
    tasks = min(int(table[-1]) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    owners = combined.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key")
    owners.mapInArrow(_own, _ENTRY).write.parquet(folder)
    return spark.read.schema(_ENTRY).parquet(folder), keys.drop("bytes")


def exact_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, row_key``.

    Texts are equal if they are identical once every run of white space is one space. The row with the smallest id
    stays; of rows that repeat that id (or if all ids are null) exactly one. Null text is empty text. Any further columns
    of ``docs`` are ignored; an empty table gives none.
    """
    index, keys = build_index(docs, row_id, text, bucket_bytes)
    # of rows with one id, the same row stays however the files are cut
    chosen = keys.groupBy("key", "sha").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row_key", "tag")).alias("best"))
    # written, so that the join below has a shuffle of its own, in which the rows of a text with many copies can be split
    groups = settle(index.join(chosen, ["key", "sha"]).select("key", "sha", "keep_id", "group_size", F.col("best.tag").alias("keep_tag")))
    return keys.join(groups, ["key", "sha"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "row_key",
    )


def deduplicated(docs: DataFrame, row_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with one row of every group of equal texts, its columns unchanged."""
    kept = exact_duplicates(docs, row_id, text, bucket_bytes).filter("kept").select(F.col("row_key").alias("_key"))
    return keep_rows(docs, row_id, text, kept, single=True)
