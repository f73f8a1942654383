import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(os.path.dirname(HERE))]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (id, text) or (id, text, source), with columns whose names operators also use."""

    def build(rows, clashing=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clashing:
            from pyspark.sql import functions as F

            for name in ("key", "fp", "kept", "size", "bucket", "_key", "n", "id", "row_key", "anchor", "root", "chunk", "host"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build
