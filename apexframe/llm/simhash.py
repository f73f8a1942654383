"""SimHash near-duplicates by covering the fingerprints with anchors.

The anchors are the words of a covering code: two perfect binary Golay codes, each over its own 23 bits of the
fingerprint. Every 23-bit word lies within radius 3 of exactly one code word, so every fingerprint has one home anchor.
If two fingerprints differ in at most t bits, then the second one lies within radius 3 + t1 and 3 + t2 of the two halves of
the first one's home, with t1 + t2 <= t. So each fingerprint is replicated to every anchor within covering radius
plus threshold in that sense (about 61 anchors out of 16.8 million at t = 2), and at every anchor the fingerprints at home
there are compared with all that came. No pair within the threshold can be missed, whatever the other bits are.

Rows with one fingerprint are combined first. At an anchor, links are reduced to a spanning forest, so there are never
more links than replicas, and an anchor with many rows looks neighbours up instead of comparing all with all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import settle
from .common import WORD, keep_rows, row_key, slices, small_batches, texts_of

#: Generator polynomial of the binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
LENGTH, RADIUS = 23, 3
#: XXH64 seed of the shingles.
SEED = 42
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_WORD = re.compile(WORD)


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the hashes of the word shingles, repeats included."""
    words = [w.encode() for w in _WORD.findall(text.translate(_LOWER))]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:] if len(words) >= shingle else ends[-1:]
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, n, 4096):
        ones += np.unpackbits(hashes[part : part + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``id, row_key, fp`` of every row; null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts_of(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["row_key"], pa.array(fps)], ["id", "row_key", "fp"])

    rows = small_batches(docs).select(F.col(row_id).cast("long").alias("id"), row_key(F.col(row_id).cast("long"), F.col(text)).alias("row_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, row_key string, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """The 4096 code words in order, and the nearest code word's index of each of the 2 ** 23 words."""
    words = np.zeros(1, dtype=np.int64)
    for shift in range(12):
        words = np.concatenate((words, words ^ (GOLAY << shift)))
    words.sort()
    nearest = np.zeros(1 << LENGTH, dtype=np.int16)
    for weight in range(RADIUS + 1):
        for bits in combinations(range(LENGTH), weight):
            nearest[words ^ sum(1 << b for b in bits)] = np.arange(len(words))
    return words, nearest


@lru_cache(4)
def _around(extra: int) -> list[np.ndarray]:
    """Per excess e <= extra: the differences of weight RADIUS + e to a code word, for all words with one syndrome.

    A code word within RADIUS + e of x is x ^ d for a difference d with the syndrome of x, so differences are
    grouped by syndrome: entry [e][syndrome] is a row of equal length, filled up with -1.
    """
    rows = []
    for weight in range(RADIUS + 1, RADIUS + extra + 1):
        found: list[list[int]] = [[] for _ in range(1 << 11)]
        for bits in combinations(range(LENGTH), weight):
            d = sum(1 << b for b in bits)
            found[_syndrome_of(d)].append(d)
        width = max(map(len, found))
        rows.append(np.array([f + [-1] * (width - len(f)) for f in found], dtype=np.int64))
    return rows


@lru_cache(1)
def _powers() -> list[int]:
    """x^i modulo the generator."""
    out, value = [], 1
    for _ in range(LENGTH):
        out.append(value)
        value <<= 1
        if value >> 11:
            value ^= GOLAY
    return out


def _syndrome_of(word: int) -> int:
    value = 0
    for b, power in enumerate(_powers()):
        if word >> b & 1:
            value ^= power
    return value


def syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.int64)
    for b, power in enumerate(_powers()):
        out ^= np.where(words >> b & 1, power, 0)
    return out


def replicas(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (anchor, position in ``fps``, at home) for every anchor within covering radius plus ``bits``."""
    words, nearest = golay()
    mask = (1 << LENGTH) - 1
    near: list[list[tuple[np.ndarray, np.ndarray]]] = []  # per half, by excess: positions and code word indices
    for half in (fps & np.uint64(mask), fps >> np.uint64(LENGTH) & np.uint64(mask)):
        half = half.astype(np.int64)
        levels = [(np.arange(len(half)), nearest[half].astype(np.int64))]
        syndrome = syndromes(half)
        for table in _around(bits):
            differences = table[syndrome]
            position, column = np.nonzero(differences >= 0)
            levels.append((position, nearest[half[position] ^ differences[position, column]].astype(np.int64)))
        near.append(levels)
    anchors, positions, home = [], [], []
    for e1 in range(bits + 1):
        for e2 in range(bits + 1 - e1):
            (p1, a1), (p2, a2) = near[0][e1], near[1][e2]
            # both lists are in order of position: pair all entries of one position
            starts, counts = np.searchsorted(p2, p1, "left"), np.searchsorted(p2, p1, "right") - np.searchsorted(p2, p1, "left")
            first = np.repeat(np.arange(len(p1)), counts)
            second = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
            anchors.append(a1[first] << 12 | a2[second])
            positions.append(p1[first])
            home.append(np.full(len(first), e1 == e2 == 0))
    return np.concatenate(anchors), np.concatenate(positions), np.concatenate(home)


@lru_cache(4)
def _flips(bits: int) -> np.ndarray:
    return np.array([sum(1 << b for b in chosen) for k in range(1, bits + 1) for chosen in combinations(range(64), k)], dtype=np.uint64)


def linked(homes: np.ndarray, there: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per fingerprint at home, the other fingerprints of the anchor within ``bits``; ``there`` is sorted and distinct."""
    flips = _flips(bits)
    for x in homes:
        if len(there) > 4 * len(flips):
            wanted = flips ^ x
            at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
            yield x, wanted[there[at] == wanted]
        else:
            distance = np.bitwise_count(there ^ x)
            yield x, there[(distance <= bits) & (distance > 0)]


def _compare(bits: int):
    """Rows of whole anchors, in order of anchor; links as (larger, smaller), a spanning forest per anchor."""

    def links(fps: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        there = np.unique(fps)
        for x, near in linked(np.unique(fps[home]), there, bits):
            a = find(int(x))
            for y in near.tolist():
                b = find(y)
                if a != b:
                    a, b = min(a, b), max(a, b)
                    root[b] = a
        return [(x, r) for x in list(root) if (r := find(x)) != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]
        done = False
        while not done:
            batch = next(batches, None)
            done = batch is None
            if not done:
                new = [batch["anchor"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["home"].to_numpy(zero_copy_only=False)]
                held = [np.concatenate(x) for x in zip(held, new)]
            anchor, fps, home = held
            if not len(anchor):
                continue
            # all but the last anchor are complete; at the end that one is, too
            stop = len(anchor) if done else int(np.searchsorted(anchor, anchor[-1], "left"))
            held = [x[stop:] for x in held]
            anchor, fps, home = anchor[:stop], fps[:stop], home[:stop]
            edges = np.flatnonzero(np.diff(anchor, prepend=-1, append=-1))
            sizes = np.diff(edges)
            at_home = np.add.reduceat(home, edges[:-1], dtype=np.int64) if len(edges) > 1 else np.zeros(0)
            found = []
            for k in np.flatnonzero((sizes > 1) & (at_home > 0)):
                found += links(fps[edges[k] : edges[k + 1]], home[edges[k] : edges[k + 1]])
            if found:
                a, b = np.array(found, dtype=np.uint64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64))], ["a", "b"])

    return run


def fingerprint_links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that join all that lie within ``bits`` of each other."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            fps = batch["fp"].to_numpy().view(np.uint64)
            anchor, position, home = replicas(fps, bits)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fps[position].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    spread_out = distinct.select("fp").mapInArrow(spread, "anchor int, fp long, home boolean")
    return spread_out.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(bits), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``v, root``: every vertex of a link with one representative of its connected component.

    Alternates large-star and small-star steps, which bring the links to stars in a number of rounds that is
    logarithmic in the length of the longest chain. Each round is a table in the shared folder.
    """

    def closest(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("w").alias("m"))

    def large_star(edges: DataFrame) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = closest(both).withColumn("m", F.least("u", "m"))
        return both.filter("w > u").join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()

    def small_star(edges: DataFrame) -> DataFrame:
        least = closest(edges)
        moved = edges.join(least, "u").filter("w > m").select(F.col("w").alias("u"), F.col("m").alias("w"))
        return moved.unionByName(least.withColumnRenamed("m", "w")).distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "w") % F.lit(1 << 40))).first())

    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).filter("u > w").distinct())
    before = state(edges)
    while True:
        edges = settle(small_star(large_star(edges)))
        if (now := state(edges)) == before:
            break
        before = now
    return edges.select(F.col("u").alias("v"), F.col("w").alias("root")).unionByName(
        edges.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, row_key, keep_key``.

    Fingerprints link at ``bits`` or fewer differing bits; a component is what links reach. ``component_id`` is its
    smallest id (null only if all of its ids are null), ``keep_key`` the row key of the one document that stays: the smallest
    id, ties by row key. Null, empty and blank texts have fingerprint zero and link like any other; long texts
    are read whole, by one task each. Other columns of ``docs`` are ignored; an empty table gives none.
    """
    prints = settle(fingerprints(docs, row_id, text, shingle))
    per_print = settle(
        prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row_key")).alias("best"))
    )
    member = components(fingerprint_links(per_print, bits))
    rooted = per_print.join(member, per_print["fp"] == member["v"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "best")
    best = rooted.groupBy("root").agg(F.min("best").alias("chosen"))
    classes = rooted.join(best, "root").select("fp", F.col("chosen.id").alias("component_id"), F.col("chosen.row_key").alias("keep_key"))
    return prints.join(classes, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_key", "keep_key"
    )


def one_per_group(docs: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` with one row of every group of near-duplicates, its columns unchanged."""
    found = near_duplicates(docs, row_id, text, shingle, bits)
    return keep_rows(docs, row_id, text, found.filter("row_key = keep_key").select(F.col("row_key").alias("_key")), single=True)
