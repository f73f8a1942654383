"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words; every other character is part of a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that goes to a Python task; the default of 64 MB times its copies is too much beside a heap.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's limit of an Arrow batch to ``BATCH_BYTES`` if it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession.conf.get(name).removesuffix("b")) > BATCH_BYTES:
        df.sparkSession.conf.set(name, f"{BATCH_BYTES}b")
    return df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows``, so that only few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def squeezed(text: Column) -> Column:
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def row_key(row_id: Column, text: Column) -> Column:
    """A digest of a row's id and text, never null; equal only for rows that repeat both."""
    return F.sha2(F.concat(F.coalesce(row_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))), 256)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, row_id: str, text: str, keys: DataFrame, single: bool) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in ``keys`` (column ``_key``), with the columns of ``docs``.

    The texts are shuffled once, by a digest, so that no key is hot. With ``single`` one row stays of rows
    that repeat both id and text, without another shuffle.
    """
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, row_key(F.col(row_id).cast("long"), F.col(text)))
    kept = keyed.join(keys.select(F.col("_key").alias(key)).distinct(), key, "left_semi")
    if single:
        kept = kept.dropDuplicates([key])
    return kept.select(*docs.columns)
