"""Quotient filters as lossless counters, and phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from apexframe.llm import phrases as P
from apexframe.llm import quotient_filters as Q


def brute(docs, least, best=2000):
    """Rows of (lang, rank, phrase, a, l, r, n, score)."""
    f, n = {}, Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for k in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[k : k + m])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            inside = [b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in inside):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:best], 1)]
    return sorted(out)


def some_docs(n, seed, vocabulary=9):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 3 else f"Wört{i}" for i in range(vocabulary)]
    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " a b c d "]) for _ in range(rng.randrange(30)))
    return [(rng.choice(["en", "en", "de", None, "und"]), rng.choice([text(), text(), text(), None, ""])) for _ in range(n)]


def mined(make, docs, **kw):
    table = make([(i, t, lang if lang is not None else "") for i, (lang, t) in enumerate(docs)])
    table = table.withColumn("lang", F.when(F.col("source") != "", F.col("source")))
    return sorted(tuple(r) for r in P.collocations(table, **kw).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_counting(make, seed):
    docs = some_docs(150, seed)
    assert mined(make, docs, least=4) == brute(docs, 4)


def test_ranks_are_cut(make):
    docs = some_docs(150, 3)
    assert mined(make, docs, least=3, best=5) == brute(docs, 3, 5)


def test_edges(make):
    words = ["x", "\x00", "\x01y", "a'b", "über"]
    docs = [("en", "one two three four five " * 3), ("en", "one two. three four"), (None, " ".join(words) + "\n"), ("und", " ".join(words))] * 3
    docs += [("xx", None), ("xx", ""), ("yy", "...!?"), ("en", "one  two\tthree")]
    assert mined(make, docs, least=2) == brute(docs, 2)


def test_nothing_comes_often_enough(make):
    assert mined(make, []) == [] and mined(make, [("en", None), ("en", "a b c")]) == []


def test_a_hot_phrase_in_a_very_long_text(make):
    docs = [("en", "hot phrase here now " * 200_000)] + [("en", f"hot phrase {i}") for i in range(300)]
    got = mined(make, docs, least=100)
    assert [r for r in got if r[2] == "hot phrase"] == [] and got == brute(docs, 100)


def test_segments_in_several_rounds(make, monkeypatch):
    docs = some_docs(150, 4)
    monkeypatch.setattr(P, "SEGMENT_ENTRIES", 8)
    monkeypatch.setattr(P, "ROUND_BITS", 3)
    assert len(P.rounds(8)) == 3 and P.rounds(0) == [0] and P.rounds(9) == [3, 6, 9]
    assert mined(make, docs, least=3) == brute(docs, 3)


def test_counts_past_64_bits(spark, make, monkeypatch):
    """Products are decimals: counts near 2 ** 62 give exact scores."""
    big = 4_000_000_000_000_000_003
    listed = spark.createDataFrame([("en", "a", big + 5, 1), ("en", "b", big + 1, 2)], "lang string, word string, n long, number long")
    table = spark.createDataFrame([(1 << 32 | 2, 0, big)], "high long, low long, a long")
    monkeypatch.setattr(P, "counted", lambda *a: (listed.drop("number"), table, listed))
    row = P.collocations(make([(1, "x")])).first()
    assert (row.phrase, row.score) == ("a b", 2000000 * big // (2 * big + 6))


KEYS = st.integers(1, 32).flatmap(
    lambda bits: st.tuples(
        st.just(bits),
        st.lists(st.tuples(st.integers(0, (1 << 2 * bits) - 1), st.integers(0, (1 << 2 * bits) - 1), st.sampled_from([1, 2, 254, 255, 256, 1 << 40])), max_size=80),
        st.integers(0, min(2 * bits, 6)),
    )
)


@settings(max_examples=200, deadline=None)
@given(KEYS)
def test_filters_lose_nothing(case):
    bits, rows, segment_bits = case
    high, low = (np.array([r[i] for r in rows], dtype=np.uint64) for i in (0, 1))
    counts = np.array([r[2] for r in rows], dtype=np.int64)
    expected = Counter()
    for h, l, c in rows:
        expected[h, l] += c
    moved = Q.permute(high, low, 2 * bits)
    back = Q.restore(*moved, 2 * bits)
    assert (back[0] == high).all() and (back[1] == low).all()
    summed = Q.summed(*moved, counts, 2 * bits)
    got = {}
    for segment, f in Q.split(*summed, 2 * bits, segment_bits):
        h, l, c = Q.decode(f, segment, 2 * bits, segment_bits)
        assert all(int(x) >> (2 * bits - segment_bits) == segment for x in h)
        got |= {(int(a), int(b)): int(n) for a, b, n in zip(*Q.restore(h, l, 2 * bits), c)}
    assert got == expected


def test_equal_first_bits_are_told_apart():
    high, low = np.array([5, 5, 5], dtype=np.uint64), np.array([1, 0, 1], dtype=np.uint64)
    h, l, c = Q.summed(high, low, None, 40)
    assert list(l) == [0, 1] and list(c) == [1, 2]


def test_merge_in_bounded_pieces():
    rng = np.random.default_rng(1)
    expected, batches = Counter(), []
    for _ in range(40):
        high, low = rng.integers(0, 40, 50).astype(np.uint64), rng.integers(0, 3, 50).astype(np.uint64)
        for h, l in zip(high, low):
            expected[int(h), int(l)] += 1
        batches += P._emit(*Q.summed(*Q.permute(high, low, 12), None, 12), 6, 0)
    for limit in (0, 30):
        old, P.SEGMENT_ENTRIES = P.SEGMENT_ENTRIES, 16
        try:
            pieces = list(P._merge(6, 0, limit)(iter(batches)))
        finally:
            P.SEGMENT_ENTRIES = old
        got = Counter()
        for _, (h, l, c) in pieces:
            for a, b, n in zip(*Q.restore(h, l, 12), c):
                got[int(a), int(b)] += int(n)
        assert got == expected and (len(pieces) == 1) == (limit == 0)


def test_words_of_a_stretch():
    batch = pa.record_batch({"lang": ["en", "en"], "text": ["A b,C", "d"]})
    (held,) = P._stretches(iter([batch]))
    assert [t for t in P.tokens(held["en"]) if t] == [b"a", b"b", b"\n", b"c", b"\n", b"d"]
