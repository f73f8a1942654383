"""Phrases that belong together, from exact counts of all short phrases in counting quotient filters.

1. Words are counted per language; those that come at least ``least`` times get numbers. A phrase that comes so often has
   only such words, so no other phrase needs a counter.
2. Every task packs the phrases of two to four word numbers of a stretch of text and writes them as sorted quotient filters
   (``quotient_filters``), one per segment of the permuted keys. The permutation spreads the keys evenly, and a phrase is one
   counter of a filter however often it comes, so no segment is hot.
3. The filters of a segment are merged, in several rounds if there are many segments, and what comes at least ``least``
   times is taken out and turned back into word numbers.
4. Cuts, containment and ranks are joins and aggregates over these phrases.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered, scratch, settle
from . import quotient_filters as Q
from .blocks import Blocks
from .common import slices, small_batches

#: Words of a phrase.
SIZES = (2, 3, 4)
#: Bytes of text that are counted together.
STRETCH_BYTES = 8 << 20
#: Bytes of the word list that a task looks at together.
BLOCK_BYTES = 8 << 20
#: Counters of a segment, about; a task merges a segment in memory.
SEGMENT_ENTRIES = 2 << 20
#: First bits of the segments that one round tells apart.
ROUND_BITS = 9
#: Parts that the best phrases of a language are first sought in.
SALTS = 16
#: A language's name where there is none.
UNKNOWN = "und"

#: A-Z become lower case, a tab a space, and what ends a piece a line end.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c == 9 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts; a line end, which no word holds, stands between pieces. There may be empty ones."""
    return b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ").split(b" ")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """About ``STRETCH_BYTES`` of texts at a time, by language."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in slices(batches):
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
        if size >= STRETCH_BYTES:
            yield held
            held, size = {}, 0
    if held:
        yield held


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _stretches(batches):
        for lang, texts in held.items():
            found = Counter(tokens(texts))
            found.pop(b"\n", None), found.pop(b"", None)
            columns = [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])


def _word_block(rows: pa.Table) -> dict[str, list[tuple[bytes, int]]]:
    out: dict[str, list[tuple[bytes, int]]] = {}
    for lang, word, number in zip(rows["lang"].to_pylist(), rows["word"].cast(pa.binary()).to_pylist(), rows["number"].to_pylist()):
        out.setdefault(lang, []).append((word, number))
    return out


def _number_words(words: list[bytes], lang: str, blocks: Blocks) -> np.ndarray:
    """Numbers of the words of a text, 0 between pieces and for words without one; empty words are left out."""
    own = dict.fromkeys(words, 0)
    own[b""] = -1
    for block in blocks:
        for word, number in block.get(lang, ()):
            if word in own:
                own[word] = number
    found = np.array(list(map(own.__getitem__, words)), dtype=np.int64)
    return found[found >= 0].astype(np.uint64)


def packed(numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of two to four words as two halves of a key each; 0 is no word."""
    highs, lows = [], []
    shift, zero = np.uint64(bits), np.uint64(0)
    n = len(numbers)
    at = np.flatnonzero(numbers)
    for size in SIZES:
        # those that go on with one more word
        first = at if size > SIZES[0] else at[at + 1 < n]
        first = first[first + size - 1 < n]
        first = first[numbers[first + size - 1] != 0]
        at = first
        third = numbers[first + 2] if size > 2 else zero
        fourth = numbers[first + 3] if size > 3 else zero
        highs.append(numbers[first] << shift | numbers[first + 1])
        lows.append(np.broadcast_to(third << shift | fourth, first.shape))
    return np.concatenate(highs), np.concatenate(lows)


_FILTER = "segment long, quotient_bits int, entries int, occupied binary, run_ends binary, remainders binary, counters binary, large binary"


def _rows(filters: list[tuple[int, Q.Filter]]) -> pa.RecordBatch:
    columns = zip(*((s, f.quotient_bits, f.entries, f.occupied, f.run_ends, f.remainders, f.counters, f.large) for s, f in filters))
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in _FILTER.split(", ")])


def _emit(high, low, counts, bits: int, segment_bits: int) -> Iterator[pa.RecordBatch]:
    found = []
    for pair in Q.split(high, low, counts, 2 * bits, segment_bits):
        found.append(pair)
        if len(found) == 64:
            yield _rows(found)
            found = []
    if found:
        yield _rows(found)


def _count_phrases(folder: str, bits: int, segment_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(folder, ["lang", "word", "number"], _word_block, BLOCK_BYTES)
        for held in _stretches(batches):
            parts = [packed(_number_words(tokens(texts), lang, blocks), bits) for lang, texts in held.items()]
            high, low = (np.concatenate(p) for p in zip(*parts))
            high, low = Q.permute(high, low, 2 * bits)
            yield from _emit(*Q.summed(high, low, None, 2 * bits), bits, segment_bits)

    return run


def _merge(bits: int, segment_bits: int, limit: int):
    """Batches of filters in order of their segment -> (segment, merged keys and counts).

    With a ``limit`` a segment may come out in several pieces of about so many counters; without one, whole.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        at, held, size, merged = None, [], 0, 0
        def one():
            return Q.summed(*(np.concatenate(c) for c in zip(*held)), 2 * bits)

        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                segment = row.pop("segment")
                if segment != at and held:
                    yield at, one()
                    held, size, merged = [], 0, 0
                at = segment
                held.append(Q.decode(Q.Filter(**row), segment, 2 * bits, segment_bits))
                size += len(held[-1][0])
                # what was merged before counts once, so the work stays in proportion
                if size - merged > max(merged, SEGMENT_ENTRIES):
                    held = [one()]
                    size = merged = len(held[0][0])
                    if limit and merged >= limit:
                        yield at, held[0]
                        held, size, merged = [], 0, 0
        if held:
            yield at, one()

    return run


def _refine(bits: int, segment_bits: int, next_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (high, low, counts) in _merge(bits, segment_bits, 2 * SEGMENT_ENTRIES)(batches):
            yield from _emit(high, low, counts, bits, next_bits)

    return run


_PHRASE = "high long, low long, a long"


def _frequent(bits: int, segment_bits: int, least: int):
    """Keys with at least ``least`` counts; a half is two numbers of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (high, low, counts) in _merge(bits, segment_bits, 0)(batches):
            often = counts >= least
            if often.any():
                halves = Q.restore(high[often], low[often], 2 * bits)
                wide = [((h >> np.uint64(bits)) << np.uint64(32) | h & np.uint64((1 << bits) - 1)).view(np.int64) for h in halves]
                yield pa.RecordBatch.from_arrays([*map(pa.array, wide), pa.array(counts[often])], ["high", "low", "a"])

    return run


def rounds(segment_bits: int) -> list[int]:
    """First bits of the segments after each round of merging, in steps of at most ``ROUND_BITS``."""
    n = max(1, -(-segment_bits // ROUND_BITS))
    return [segment_bits * (i + 1) // n for i in range(n)]


def counted(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All words (``lang, word, n``), the phrases of at least ``least`` occurrences (``high, low, a``) and the words of as
    many (``lang, word, n, number``). ``high`` holds the numbers of the first two words of a phrase and ``low`` those of
    the last two, 32 bits each, 0 for none."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    words = settle(rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    listed = numbered(words.filter(F.col("n") >= least), ["lang", "word"], "number", 1)
    folder = f"{scratch(spark)}/apexframe-words-{uuid.uuid4().hex}"
    listed.write.parquet(folder)
    listed = spark.read.schema(listed.schema).parquet(folder)
    sums = listed.agg(F.max("number").alias("number"), F.sum("n").alias("n")).first()
    bits = max(1, int(sums["number"] or 0).bit_length())
    if bits > 32:
        raise ValueError("more than 2 ** 32 words that come often enough")
    entries = len(SIZES) * int(sums["n"] or 0)
    segment_bits = min(max(0, (entries // SEGMENT_ENTRIES).bit_length()), 2 * bits)
    steps = rounds(segment_bits)
    filters = rows.mapInArrow(_count_phrases(folder, bits, steps[0]), _FILTER)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for here, then in zip(steps, steps[1:]):
        # any filters of a segment may meet here, so they are spread over tasks, the same ones each time
        dealt = filters.repartition(tasks, "segment", F.pmod(F.xxhash64("remainders"), F.lit(64))).sortWithinPartitions("segment")
        filters = dealt.mapInArrow(_refine(bits, here, then), _FILTER)
    whole = filters.repartition(tasks, "segment").sortWithinPartitions("segment")
    phrases = settle(whole.mapInArrow(_frequent(bits, steps[-1], least), _PHRASE))
    return words, phrases, listed


def _parts() -> list[tuple[str, int, int, int, int]]:
    """Every run of words of a phrase, as (name, size of the phrase, first word, words)."""
    return [(f"p{first}{count}", size, first, count) for size in SIZES for count in range(1, size) for first in range(size - count + 1)]


def _key(names: list) -> tuple:
    """The two halves of the key of up to four word numbers."""
    full = [*names, *[F.lit(0).cast("long")] * (4 - len(names))]
    return tuple(F.shiftleft(full[i], 32).bitwiseOR(full[i + 1]) for i in (0, 2))


def collocations(docs: DataFrame, least: int = 30, best: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``best`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends; words are separated by spaces and tabs.
    A phrase is two to four words of a piece with at least ``least`` occurrences ``a``, overlapping ones included; ``n`` are
    all words of the language. Cut after its first words, it has parts of ``l`` and ``r`` occurrences and scores
    floor(2000000 a / (l + r)); its lowest cut counts, of equal ones that with the shortest first part. A phrase that lies
    inside a longer one with at least 80 % of its occurrences goes. Ties of the score go by ``a``, then by the phrase in
    byte order. Null texts are empty, a null language is ``und``, repeated rows count each time, texts of any length are
    counted whole. Other columns are ignored; an empty table, or one without such phrases, gives no rows.
    """
    words, phrases, listed = counted(docs, least, text, lang)
    numbers = [F.shiftrightunsigned("high", 32), F.col("high").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("low", 32), F.col("low").bitwiseAND(0xFFFFFFFF)]
    size = F.when(numbers[2] == 0, 2).when(numbers[3] == 0, 3).otherwise(4)
    whole = phrases.withColumn("size", size)
    runs = F.array_compact(F.array(*(
        F.when(F.col("size") == n, F.struct(F.lit(name).alias("part"), *(k.alias(x) for k, x in zip(_key(numbers[first : first + count]), ("p_high", "p_low")))))
        for name, n, first, count in _parts()
    )))
    # both sides of the joins below are written tables or exchanges of their own, so that a word of many phrases can be split
    needed = settle(whole.select("high", "low", "a", "size", F.inline(runs)))
    single = listed.select(F.shiftleft("number", 32).alias("p_high"), F.lit(0).cast("long").alias("p_low"), F.col("n").alias("f"), "lang", "word")
    known = settle(single.unionByName(phrases.select(F.col("high").alias("p_high"), F.col("low").alias("p_low"), F.col("a").alias("f")), allowMissingColumns=True))
    joined = needed.join(known, ["p_high", "p_low"])

    def of(part: str, column: str):
        return F.max(F.when(F.col("part") == part, F.col(column)))

    kinds = sorted({name for name, *_ in _parts()})
    named = [of(p, "f").alias(p) for p in kinds] + [of(f"p{i}1", "word").alias(f"w{i}") for i in range(4)]
    told = joined.groupBy("high", "low", "a", "size").agg(F.max("lang").alias("lang"), *named)
    cuts = []
    for n in SIZES:
        for k in range(1, n):
            left, right = f"p0{k}", f"p{k}{n - k}"
            score = F.expr(f"cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div (cast({left} as decimal(20, 0)) + cast({right} as decimal(20, 0)))")
            cut = F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
            cuts.append(F.when(F.col("size") == n, cut))
    scored = told.withColumn("cut", F.array_min(F.array_compact(F.array(*cuts))))
    inner = [(name, n) for name, n, _, count in _parts() if count > 1]
    longer = needed.filter(F.col("part").isin(*{name for name, _ in inner})).groupBy("p_high", "p_low").agg(F.max("a").alias("longer"))
    free = scored.join(longer.toDF("high", "low", "longer"), ["high", "low"], "left").filter(
        F.expr("longer IS NULL OR cast(100 as decimal(3, 0)) * cast(longer as decimal(20, 0)) < cast(80 as decimal(2, 0)) * cast(a as decimal(20, 0))")
    )
    shown = free.select("lang", F.concat_ws(" ", "w0", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score"), F.pmod(F.xxhash64("high", "low"), F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of parts of a language first, so that the last ranking gets a bounded number of rows
    few = shown.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
