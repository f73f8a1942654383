import re

import numpy as np
import xxhash

from apexframe.llm import simhash as S

FOLDER = "/root/testdata/sf0.001"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, bits=2):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return sorted(((doc, f"{prints[i]:016x}", smallest.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


BASE = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions in a quiet tower near water " * 6
EDGES = [
    (1, None), (2, ""), (3, " \n"), (None, ""), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, BASE), (9, BASE + "end"),
    (10, BASE.upper()), (11, "É È"), (12, "é è"), (13, BASE), (13, BASE), (13, "something else entirely here"), (14, "w " * 200_000), (None, "alone with no id"),
]


def test_edge_rows(make):
    assert got(S.near_duplicates(make(EDGES))) == brute(EDGES)


def test_empty_table(make):
    assert got(S.near_duplicates(make([]))) == []
    assert S.one_per_group(make([])).count() == 0


def test_whole_table(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(S.near_duplicates(documents)) == brute(rows)


def test_every_close_pair_is_linked(spark):
    rng = np.random.default_rng(3)
    center = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = [center]
    for _ in range(40):  # long chains of close fingerprints, and one crowded ball
        fps.append(fps[-1] ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)))
        fps.append(center[:1].repeat(40) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)))
    fps = np.unique(np.concatenate(fps))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    label = {r.v: r.root for r in S.components(S.fingerprint_links(df)).collect()}
    same, root = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, np.arange(len(fps))
    while True:
        least = np.where(same, root[None, :], len(fps)).min(axis=1)
        if (least == root).all():
            break
        root = least
    groups = {}
    for x, r in zip(fps.view(np.int64).tolist(), root.tolist()):
        groups.setdefault(r, set()).add(label.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_crowded_anchors_look_neighbours_up():
    rng = np.random.default_rng(5)
    there = np.unique(np.concatenate([rng.integers(0, 2**64, 9000, dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)]))
    few = {int(x): set(y.tolist()) for x, y in S.linked(there[:50], there, 2)}
    plain = {int(x): {int(y) for y in there if 0 < (int(x) ^ int(y)).bit_count() <= 2} for x in there[:50]}
    assert few == plain


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    label = {r.v: r.root for r in S.components(links).collect()}
    assert {label[i] for i in range(301)} == {0} and label[1000] == label[1001] == 1000


def test_stage_keeps_one_of_each_group(make):
    docs = make(EDGES)
    kept = S.one_per_group(docs)
    groups = {r[2] if r[2] is not None else r[1] for r in brute(EDGES)}
    assert kept.columns == docs.columns
    assert kept.count() == len(groups)
