"""Decontamination by suffix arrays against a plain search."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from apexframe.llm import suffix_arrays as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    windows = [(str(i) if i is not None else "null", tuple(w[k : k + 10])) for i, t in items if (w := words(t)) for k in range(max(len(w) - 9, 1))]
    for doc_id, text in docs:
        own, hit, names = words(text), set(), set()
        for name, window in windows:
            for k in range(len(own) - len(window) + 1):
                if tuple(own[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    names.add(name)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(own), len(hit), len(names), sha, bool(hit)))
    return out


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def check(spark, make, docs, items, clashing=True):
    found = S.judged(make(docs, clashing), items_of(spark, items))
    got = [tuple(r)[:6] for r in found.collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items), key=str)


def some_texts(n, seed, size=60, vocabulary=6):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefghij"[:vocabulary]) for _ in range(rng.randrange(size))) for _ in range(n)]


def test_few_words_many_repeats(spark, make):
    docs = [(i, t) for i, t in enumerate(some_texts(60, 1))]
    items = [(i, t) for i, t in enumerate(some_texts(25, 2, 24, 3))]
    check(spark, make, docs, items)


def test_edges(spark, make):
    passage = "Der Übermut, tut-selten GUT und so w3iter bis zum ende des satzes ohne halt"
    docs = [
        (1, passage), (2, None), (3, ""), (4, "..."), (5, "x " + passage.upper().replace("Ü", "ü") + " y"), (5, passage), (5, passage), (None, passage),
        (6, passage.replace("-", "\x00\n")), (7, "kurz und gut"), (8, "ganz kurz, und gut."), (9, "und gut"), (10, passage[:40]), (11, passage[40:]),
    ]
    items = [(1, passage), (2, "Kurz und gut"), (3, None), (4, "!"), (None, "bis zum ende"), (10, passage + " mehr"), (9, passage), (9, "kurz")]
    check(spark, make, docs, items)


def test_empty_tables(spark, make):
    assert S.judged(make([]), items_of(spark, [(1, "a b")])).count() == 0
    row = S.judged(make([(1, "a b")]), items_of(spark, [])).first()
    assert tuple(row)[:6] == (1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_many_shards_and_blocks(spark, make, monkeypatch):
    """Limits are module values that the tasks get with the code; here within one process."""
    docs, items = some_texts(80, 3), some_texts(30, 4, 30, 4)
    monkeypatch.setattr(S, "_AT_ONCE", 3)
    whole = S.Shard([d.encode() for d in docs], 64)
    import pyarrow as pa

    table = pa.table({"item": [str(i) for i in range(len(items))], "text": [t.encode() for t in items]})
    one = S._hits(whole, [S.Items(table)])
    n_hit, names = [], []
    for i in range(0, len(docs), 7):
        shard = S.Shard([d.encode() for d in docs[i : i + 7]], 64)
        h, n = S._hits(shard, [S.Items(table.slice(k, 4)) for k in range(0, len(items), 4)])
        n_hit += list(h)
        names += n
    assert list(one[0]) == n_hit and one[1] == names
    expected = brute(list(enumerate(docs)), list(enumerate(items)))
    assert [r[2] for r in expected] == n_hit


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40).map(" ".join), max_size=6), st.integers(1, 50))
def test_suffixes_are_sorted(texts, depth):
    shard = S.Shard([t.encode() for t in texts], depth)
    assert sorted(shard.sa) == list(range(len(shard.text)))
    keys = [tuple(shard.text[p : p + depth]) for p in shard.sa]
    cut = [k[: k.index(0) + 1] if 0 in k else k for k in keys]
    assert all(a <= b or a[: len(b)] == b for a, b in zip(cut, cut[1:]))


def test_longest_match(spark, make):
    docs = [(1, "a b c d e f"), (2, "x c d e f g h"), (3, None)]
    items = items_of(spark, [(1, "z c d e f g q"), (2, "nothing here"), (3, "a b")])
    got = {r.item_id: tuple(r)[1:] for r in S.longest_matches(make(docs), items).collect()}
    assert got == {"1": (5, 1, "2", 1), "3": (2, 0, "1", 0)}


def test_affected_rows_go_and_columns_stay(spark, make):
    docs = make([(1, "one two three"), (2, "four"), (3, None), (2, "four")]).withColumnRenamed("fp", "n_hit")
    kept = S.decontaminated(docs, items_of(spark, [(1, "two three")]))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 3]


def test_a_very_long_text_and_a_hot_passage(spark, make):
    rng = np.random.default_rng(5)
    long = " ".join(map(str, rng.integers(0, 5000, 400_000)))
    hot = " ".join(f"h{i}" for i in range(30))
    docs = [(0, long + " " + hot)] + [(i, f"{hot} tail{i}" if i % 3 == 0 else f"plain {i}") for i in range(1, 3000)]
    got = {r.doc_id: r.n_hit for r in S.judged(make(docs, False), items_of(spark, [(1, hot)])).collect()}
    assert got == {i: 30 if i % 3 == 0 else 0 for i in range(3000)}


@pytest.mark.parametrize("files", [1, 9])
def test_the_layout_does_not_matter(spark, make, files):
    docs = [(i, t) for i, t in enumerate(some_texts(50, 7))]
    items = [(i, t) for i, t in enumerate(some_texts(9, 8, 20, 3))]
    found = S.judged(make(docs).repartition(files), items_of(spark, items).repartition(files))
    assert sorted([tuple(r)[:6] for r in found.collect()]) == sorted(brute(docs, items))
