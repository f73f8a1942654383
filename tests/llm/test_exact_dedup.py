import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from apexframe.llm import exact_dedup as E

FOLDER = "/root/testdata/sf0.001"


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", row[1] or "")].append(row[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in df.collect()), key=str)


EDGES = [
    (1, "a  b"), (2, "a b"), (3, "a\tb"), (4, None), (5, ""), (6, " "), (7, "\n"), (None, "a b"), (None, "only null"), (None, "only null"),
    (8, "x" * 300_000), (9, "x" * 300_000), (10, "x" * 299_999 + "y"), (11, "tie"), (11, "tie"), (11, "other"), (12, "é é"), (13, "é é"),
]


def test_edge_rows(make):
    assert got(E.exact_duplicates(make(EDGES))) == expected(EDGES)


def test_empty_table(make):
    assert got(E.exact_duplicates(make([]))) == []
    assert E.deduplicated(make([])).count() == 0


def test_splitting_buckets_changes_nothing(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    for size in (1 << 30, 40_000, 500):
        assert got(E.exact_duplicates(documents, bucket_bytes=size)) == expected(rows)


def test_collisions_are_chained(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict(
        {"bucket": pa.array([0] * 4, pa.int32()), "key": [5, 5, 5, 6], "first": [3, 9, 1, 2], "n": [1, 2, 4, 1], "text": ["a", "b", "a", "a"]}
    )
    rows = [r for b in E._own(iter([batch])) for r in b.to_pylist()]
    assert [(r["key"], r["chain"], r["keep_id"], r["group_size"]) for r in rows] == [(5, 0, 1, 5), (5, 1, 9, 2), (6, 0, 2, 1)]


def test_directory_doubles_and_splits(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"), F.lit(10).alias("bytes"))
    table = E.directory(keys, 1000)
    assert len(table) & (len(table) - 1) == 0 and len(table) >= 64
    assert (np.diff(table) >= 0).all() and table[0] == 0
    tops = np.array([r[0] for r in keys.select(E.prefix(F.col("key"), int(len(table)).bit_length() - 1)).collect()])
    assert np.bincount(table[tops]).max() * 10 <= 1000
    assert len(E.directory(keys, 1 << 20)) == 1
    assert len(E.directory(keys.limit(0), 10)) == 1


def test_stage_keeps_whole_rows(make):
    docs = make(EDGES)
    kept = E.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in EDGES})


def test_the_same_row_stays_in_any_layout(spark, make):
    rows = [(1, "a  b"), (1, "a b"), (1, "a\tb"), (2, "a b"), (None, "c"), (None, " c"), (None, "c ")]
    kept = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        for files in (1, 5):
            kept.add(tuple(sorted((str(r.doc_id), r.text) for r in E.deduplicated(make(order).repartition(files)).collect())))
    assert len(kept) == 1 and len(kept.pop()) == 4


def test_the_copies_of_one_text_are_split(spark, make):
    from pyspark.sql import functions as F

    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot text").otherwise(F.concat(F.lit("t "), "id")).alias("text"))
    low = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        found = E.exact_duplicates(docs)
        assert found.filter("kept").count() == 30_001
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
