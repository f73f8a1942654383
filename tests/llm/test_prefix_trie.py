"""The trie against a plain one, and subtree totals against sums over paths."""

import hashlib
import random
import zlib

import pytest

from apexframe.llm import forward as W
from apexframe.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def placed(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out.setdefault(conv, []).append((turn is not None, turn or 0, role, sha, text))
    return {c: [(t[2], t[4]) for t in sorted(own)] for c, own in out.items()}


def shared(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(abs(c) % 5 * (1 if c > 0 else -1)), [])[:h] + own[h:]
    return out


def brute(convs):
    members, last = {}, {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
        last.setdefault(tuple(own), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(last.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha))
    return sorted(out, key=str)


def rows_of(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


def some_rows(n, seed, turns=9):
    rng = random.Random(seed)
    rows = []
    for c in range(-n // 4, n):
        for t in range(rng.randrange(turns)):
            rows.append((c, rng.choice([t, t, t, None]) if rng.random() < 0.1 else t, rng.choice(["user", "user", "bot", None]), rng.choice(["hi", "hi", "hi", "é", "", None])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_beginnings(spark, seed):
    rows = some_rows(60, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(T.shared_prefix_trie(df, shard_nodes=25, least_nodes=20, queue_messages=4)) == brute(shared(placed(rows)))


def test_plain_conversations_in_one_shard(spark):
    rows = some_rows(40, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(T.prefix_trie(df)) == brute(placed(rows))


def test_edges(spark):
    rows = [
        (7, None, None, None), (7, 0, "user", "a"), (7, 0, "user", "a"), (8, 0, "user", "a"), (8, 1, "b", "c"), (9, 0, "use", "ra"),
        (None, 0, "user", "a"), (-3, 5, "", ""), (2**62, 1, "user", "x" * 100_000), (10, 0, "user", "a"), (10, 3, "user", "a" * 10),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "depth", "bytes", "a", "_part", "s0", "sha")})
    assert rows_of(T.prefix_trie(df)) == brute(placed(rows))
    assert rows_of(T.shared_prefix_trie(df)) == brute(shared(placed(rows)))
    assert rows_of(T.prefix_trie(df.filter("conv_id = 0"))) == [] == rows_of(T.shared_prefix_trie(df.filter("conv_id IS NULL")))


def test_one_long_conversation_and_one_hot_beginning(spark):
    """A conversation with a third of all turns is cut into several shards, a turn that half of them begin with is one parent."""
    rows = [(3, t, "user", f"t{t}") for t in range(1500)] + [(c, t, "user", "hot" if t == 0 and c % 2 else f"{c} {t}") for c in range(100, 800) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(T.prefix_trie(df, shard_nodes=200, least_nodes=150, queue_messages=50)) == brute(placed(rows))


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(T, "IDS_AT_ONCE", 7)
    import pyarrow as pa

    table = pa.table({"depth": [1] * 50 + [2] * 3, **{s: [0] * 53 for s in T._SUMS}, "conv": [*range(50), 5, 60, 700]})
    texts = [b for b in T._joined(iter(table.to_batches(max_chunksize=11)))]
    assert sum(b.num_rows for b in texts) == 8 + 1
    rows = [r for b in T._digested(iter(texts)) for r in b.to_pylist()]
    assert [r["ends_sha256"] for r in rows] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for ids in (range(50), (5, 60, 700))]


def forest(kind, n, rng):
    """(a, b, parent) of nodes; parents come first."""
    nodes = [(0, 0, None)]
    for i in range(1, n):
        p = {"chain": nodes[-1], "star": nodes[0], "random": rng.choice(nodes), "stairs": nodes[max(0, i - 2)], "roots": rng.choice(nodes)}[kind]
        if kind == "roots" and rng.random() < 0.3:
            nodes.append((rng.randrange(10**6) * n + i, rng.randrange(5), None))
        else:
            nodes.append((rng.randrange(10**6) * n + i if kind != "chain" else 0, p[1] + 1 if kind != "random" else p[1] + rng.randrange(1, 4), p[:2]))
    return nodes


@pytest.mark.parametrize("kind", ["chain", "star", "random", "stairs", "roots"])
def test_totals_of_any_shape(spark, kind):
    rng = random.Random(kind)
    nodes = forest(kind, 600, rng)
    kids, values = {}, {n[:2]: rng.randrange(100) for n in nodes}
    for a, b, p in nodes:
        if p is not None:
            kids.setdefault(p, []).append((a, b))
    total = {}
    for a, b, _ in sorted(nodes, key=lambda n: -n[1]):
        below = [total[k] for k in kids.get((a, b), [])]
        total[a, b] = (len(below), sum(t[1] for t in below) or 1, values[a, b] + sum(t[2] for t in below))
    df = spark.createDataFrame([(a, b, *(p or (None, None)), values[a, b]) for a, b, p in nodes], "a long, b long, up_a long, up_b long, saved long")
    got = {(r.a, r.b): (r.children, r.leaves, r.saved) for r in W.subtree_totals(df, 40, 30, queue_messages=8).collect()}
    assert got == total


def test_queue_spills_and_cleans_up(tmp_path):
    rng = random.Random(1)
    queue, sent = W.Queue(str(tmp_path / "q"), 10), {}
    for _ in range(500):
        place = (-rng.randrange(20), rng.randrange(5))
        queue.push(place, (place, rng.random()))
        sent[place] = sent.get(place, 0) + 1
    assert len(list((tmp_path / "q").iterdir())) == 50
    for place in sorted(sent):
        got = list(queue.take(place))
        assert len(got) == sent[place] and all(m[0] == place for m in got)
    queue.close()
    assert not list((tmp_path / "q").iterdir())
    queue.push((0, 0), ())
    with pytest.raises(RuntimeError):
        queue.close()
