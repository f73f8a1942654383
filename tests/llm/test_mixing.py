import re
from collections import defaultdict

from apexframe.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, open_ = {}, set(names)
    while open_:
        level = (share * sum(sizes.values()) - sum(held.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > epochs * sizes[s]}
        if not over:
            return held | {s: weight[s] * level for s in open_}
        held |= {s: epochs * sizes[s] for s in over}
        open_ -= over
    return held


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    target = targets(sizes)
    taken, by_id = defaultdict(int), {r[0]: r for r in rows}
    assert len(got) == len(rows)
    for r in got:
        _, text, source = by_id[r.doc_id]
        assert (r.size, r.source_size) == (words(text), sizes[source]) and abs(r.target - target[source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for source, t in target.items():
        assert 0 <= t - taken[source] < 1 + 1e-6


ROWS = (
    [(i, "w " * (1 + i % 7), f"s{i % 5}") for i in range(300)] + [(1000 + i, "x y z", "hot") for i in range(400)]
    + [(2000, None, "s0"), (2001, "", "none here"), (2002, "a b c", None), (2003, "q " * 100_000, "é"), (2004, "b", "Z")]
)


def test_budgets(make):
    got = M.mixed(make(ROWS)).collect()
    check(ROWS, got)
    again = M.mixed(make(list(reversed(ROWS))).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_repeated_rows_and_null_ids(make):
    rows = [(1, "a b c", "s")] * 5 + [(None, "a b c", "s")] * 3 + [(None, None, None)]
    got = M.mixed(make(rows)).collect()
    assert len(got) == 9 and sum(r.taken for r in got) == 36 and max(r.taken for r in got) <= 6


def test_empty_table_and_no_words(make):
    assert M.mixed(make([])).count() == 0 and M.mixture(make([])).count() == 0
    assert [(r.size, r.target, r.taken) for r in M.mixed(make([(1, None, "a"), (2, " ", None)])).collect()] == [(0, 0.0, 0)] * 2


def test_mixture_is_what_is_taken(make):
    docs = make(ROWS)
    taken = {r.doc_id: r.taken for r in M.mixed(docs).collect()}
    texts = {r[0]: r[1] for r in ROWS}
    out = M.mixture(docs)
    assert out.columns == docs.columns
    got, partial = defaultdict(int), defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += words(r.text)
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) and r["_key"] == "x"
        partial[r.source] += r.text != texts[r.doc_id]
    assert got == {k: v for k, v in taken.items() if v}
    assert max(partial.values()) <= 1


def test_repeated_rows_in_the_mixture(make):
    rows = [(1, "a b c", "s")] * 5 + [(1, "a b c", "t")] * 2 + [(None, "d e", "s")]
    docs = make(rows)
    plan = sum(r.taken for r in M.mixed(docs).collect())
    assert sum(words(r.text) for r in M.mixture(docs).collect()) == plan


def test_more_sources_than_partitions(make):
    rows = [(i, "w " * (1 + i % 3), f"source {i:04d}") for i in range(500)]
    check(rows, M.mixed(make(rows)).collect())
