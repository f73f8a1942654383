"""The pipeline against a version of every stage by brute force, on whole small tables."""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import test_host_rules
import test_mixing
import test_simhash

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(rows):
    """The verdicts on hosts are tested by themselves; here no host is bad."""
    out = []
    for r in rows:
        n, _, _, _, _, repeats = test_host_rules.brute(r[1])
        if n >= 10 and 100 * repeats <= 20 * n:
            out.append(r)
    return out


def exact(rows):
    best = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    return list(best.values())


def near(rows):
    component = {doc: c for doc, _, c in test_simhash.brute([r[:2] for r in rows])}
    return [r for r in rows if component[r[0]] == r[0]]


def mix(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    target = test_mixing.targets({s: sum(len(words(r[1])) for r in v) for s, v in by_source.items()})
    out = []
    for source, members in by_source.items():
        left = int(target[source])
        members.sort(key=lambda r: hashlib.sha256(f"{'null' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest())
        while left:
            for r in members:
                n = len(words(r[1]))
                if 0 < n <= left:
                    out.append(r)
                elif left and n:
                    text = r[1][: [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", r[1])][left - 1]]
                    out.append((r[0], text, r[2], r[3], len(text)))
                left -= min(n, left)
    return out


def encoded(rows):
    library, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((r[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


BRUTE = [quality, exact, near, mix, encoded]


def rows_of(df):
    return sorted(map(tuple, df.select(*(COLUMNS if "text" in df.columns else df.columns)).collect()), key=str)


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    for (name, stage), brute in zip(P.STAGES, BRUTE):
        out = stage(spark, docs, FOLDER)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = brute(rows)
        assert rows and rows_of(docs) == sorted(rows, key=str), name
    assert rows_of(P.run(spark, FOLDER)) == sorted(rows, key=str)


def test_odd_rows_go_through_every_stage(make, spark):
    long = " ".join(f"w{i}" for i in range(300))
    odd = [(None, None, None), (1, "", "a"), (2, long, None), (2, long, None), (3, long.replace("w", "é"), "a"), (3, "other " + long.replace("w", "z"), "b"), (None, long.replace("w", "q"), "b"), (4, "x" * 300_000, "c")]
    for rows in (odd, []):
        docs = make(rows)
        for name, stage in P.STAGES:
            docs = stage(spark, docs, FOLDER)
            if name != P.STAGES[-1][0]:
                assert docs.columns == make([]).columns
                assert docs.filter(F.col("_key") != "x").isEmpty()
        assert docs.count() == (0 if not rows else docs.count())


def test_stages_are_the_operators_in_order():
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
