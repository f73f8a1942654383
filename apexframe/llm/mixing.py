"""Mixing sources to target weights: hash-random order per source, distributed prefix sums, and a cut at the budget.

Every row gets a hash-random key. Rows are range-sorted by (source, key), so a large source is spread over many
partitions. A task sums up the words before each row within its own stretch of a source, the totals of the stretches
are summed up per source, and the sum of both places every row on its source's line of words. The budget of a
source covers that line once or several times; what it covers of a row is what the mix takes of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered, settle
from .common import SPACE, WORD, free_name, row_key, slices

WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the times a source may be repeated at most.
SHARE, EPOCHS = 1.5, 2
_NAMED = ["unknown", "name"]


def sized(docs: DataFrame, row_id: str, text: str, source: str, row: str | None = None) -> DataFrame:
    """``id, unknown, name, size, key, row, tag``: words of every row, its hash-random key, and a number of its own.

    The key is the first 60 bits of a digest of id and text, so rows that repeat both share it; the number parts them.
    """
    digest = row_key(F.col(row_id).cast("long"), F.col(text))
    return docs.select(
        F.col(row_id).cast("long").alias("id"), F.col(source).isNull().alias("unknown"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("key"), (F.col(row) if row else F.lit(None).cast("string")).alias("row"),
        F.monotonically_increasing_id().alias("tag"),
    )


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``unknown, name, source_size, target``: ``share`` of all words dealt out by weight, at most ``epochs`` sizes a source.

    What a source cannot take is dealt out again among the others, until no target is above its limit. A round
    brings one row of sums to the driver.
    """
    # by code point, the unknown one last
    sources = numbered(rows.groupBy(*_NAMED).agg(F.sum("size").alias("source_size")), _NAMED, "rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = settle(sources.withColumns({"weight": weight, "most": F.col("source_size") * epochs}))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words per unit of weight
    while total:
        full = F.col("most") <= F.col("weight") * level
        open_weight, held = sources.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, F.col("most")))).first()
        if not open_weight or (now := (share * total - (held or 0)) / open_weight) <= level:
            break
        level = now
    return sources.select(*_NAMED, "source_size", F.least(F.col("most").cast("double"), F.col("weight") * level).alias("target"))


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order of source: words before each row within the partition's stretch of its source."""
    at, carried = None, 0
    for batch in slices(batches, 1 << 16):
        sizes = batch["size"].to_numpy()
        sums = np.cumsum(sizes) - sizes
        names = list(zip(batch["unknown"].to_pylist(), batch["name"].to_pylist()))
        starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
        before = np.empty_like(sizes)
        for i, j in zip(starts, [*starts[1:], len(names)]):
            carried = carried if names[i] == at else 0
            at = names[i]
            before[i:j] = sums[i:j] - sums[i] + carried
            carried = int(before[j - 1] + sizes[j - 1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "before"])


def mixed(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None,
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken`` (and ``row``, a column passed through).

    ``taken`` counts the words the mix takes of the row, repeats included, so it is at most ``epochs`` sizes; a source's
    taken words add up to its target without the fraction. At most one row of a source is taken in part. The order is a
    hash of id and text, so reruns agree; rows that repeat both are alike. Null text has size 0, null sources are one
    source, the last; null ids are rows like others; an empty table gives none. Long texts count whole. Other columns are ignored.
    """
    rows = settle(sized(docs, row_id, text, source, row))
    shares = targets(rows, weights, share, epochs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *_NAMED, "key", "tag").sortWithinPartitions(*_NAMED, "key", "tag")
    kinds = "id long, unknown boolean, name string, size long, row string, part int"
    # written once: the stretches' totals and the rows must come from one and the same sort
    line = settle(ordered.drop("key", "tag").withColumn("part", F.spark_partition_id()).mapInArrow(_before, f"{kinds}, before long"))
    so_far = Window.partitionBy(*_NAMED).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    stretches = line.groupBy(*_NAMED, "part").agg(F.sum("size").alias("words")).select(
        *_NAMED, "part", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("start")
    )
    placed = line.join(stretches.join(shares, _NAMED), [*_NAMED, "part"])
    budget, size = F.floor("target").cast("long"), F.col("size")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("start") - F.col("before")
    taken = whole * size + F.greatest(F.lit(0), F.least(size, rest))
    return placed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), "row")


def mixture(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a row per epoch that takes it.

    Of the row at a source's cut, the last copy ends after its last taken word, and ``length``, if there is such a column,
    becomes the length of that text. Rows without words are taken by no budget and are not in the mix.
    """
    row_name, size, taken, copy = (free_name(docs, c) for c in ("_row", "_size", "_taken", "_copy"))
    keyed = docs.withColumn(row_name, F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))), 256))
    plan = mixed(keyed, row_id, text, source, row_name, weights, share, epochs).filter("taken > 0")
    plan = plan.select(F.col("row").alias(row_name), F.col("size").alias(size), F.col("taken").alias(taken))
    copies = keyed.dropDuplicates([row_name]).join(plan, row_name).withColumn(
        copy, F.explode(F.expr(f"sequence(1L, ({taken} + {size} - 1) div {size})"))
    )
    left = F.col(taken) - (F.col(copy) - 1) * F.col(size)
    part = left < F.col(size)
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"{SPACE}*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.when(part, left).otherwise(1).cast("int")), "")
    changed = {text: F.when(part, cut).otherwise(F.col(text))}
    if length and length in docs.columns:
        changed[length] = F.when(part, F.length(cut)).otherwise(F.col(length)).cast(docs.schema[length].dataType)
    return copies.withColumns(changed).select(*docs.columns)
