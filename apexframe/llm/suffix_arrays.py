"""Benchmark decontamination by suffix arrays of the training text.

Each task cuts its documents into shards of ``SHARD_BYTES`` and sorts all word positions of a shard by the words that
follow them (prefix doubling, as deep as the longest test item, since no search looks further). Every suffix of every test
item is then looked up by binary search, one word deeper at a time, which gives its longest verbatim match in the shard and
the range of all positions where a window of it occurs. A match never passes the end of a document.

The test items are a table in shared storage that a task reads block by block, so neither they nor the documents are
broadcast, shuffled or collected; memory is bounded by a shard, a block and the longest single text.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import scratch
from .blocks import Blocks
from .common import slices, small_batches

#: Words of a window.
WINDOW = 10
#: Document bytes of a shard.
SHARD_BYTES = 8 << 20
#: Bytes of test items that are searched together.
BLOCK_BYTES = 4 << 20
#: Occurrences that are looked at together.
_AT_ONCE = 1 << 20

#: Bytes 0-9, a-z and those above 0x7F are part of words, A-Z become lower case, others separate words.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Items:
    """A block of test items: their names and words, and where each begins; items without words are left out."""

    def __init__(self, rows: pa.Table):
        found = [(name, words_of(text)) for name, text in zip(rows["item"].to_pylist(), rows["text"].to_pylist())]
        found = [(name, words) for name, words in found if words]
        self.names = [name for name, _ in found]
        self.words = [w for _, words in found for w in words]
        sizes = np.array([len(words) for _, words in found], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(found)), sizes)
        #: Words from a position to the end of its item, and words of a window that begins there.
        self.left = self.starts[1:][self.owner] - np.arange(len(self.words))
        self.window = np.minimum(sizes, WINDOW)[self.owner]


class Shard:
    """Suffix array over the words of some documents, exact to ``depth`` words."""

    def __init__(self, texts: list[bytes], depth: int):
        # words are numbered from 1 as they come, 0 stands for the end of a document
        numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        sizes, parts = [], []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            parts.append(np.zeros(len(words) + 1, dtype=np.int64))
            parts[-1][:-1] = list(map(numbers.__getitem__, words))
        self.numbers = numbers
        self.sizes = np.array(sizes, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)]).astype(np.int64)
        self.text = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        self.sa = self._sorted(depth)

    def _sorted(self, depth: int) -> np.ndarray:
        n = len(self.text)
        if not n:
            return np.zeros(0, dtype=np.int64)
        bits = max(1, len(self.numbers).bit_length())
        known = min(63 // bits, max(depth, 1))
        key = np.zeros(n, dtype=np.int64)
        for i in range(known):
            key <<= bits
            key[: max(n - i, 0)] |= self.text[i:]
        sa = np.argsort(key, kind="stable")
        new = np.ones(n, dtype=bool)
        new[1:] = key[sa[1:]] != key[sa[:-1]]
        while known < depth:
            # a rank is the first place of a group of equal beginnings; only groups of several are sorted on
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank = np.empty(n + 1, dtype=np.int64)
            rank[sa], rank[n] = first, -1
            alone = new & np.append(new[1:], True)
            open_ = np.flatnonzero(~alone)
            if not len(open_):
                break
            at = sa[open_]
            pair = first[open_] * (n + 1) + rank[np.minimum(at + known, n)] + 1
            order = np.argsort(pair, kind="stable")
            sa[open_], pair = at[order], pair[order]
            fresh = np.ones(len(open_), dtype=bool)
            fresh[1:] = pair[1:] != pair[:-1]
            new[open_] = fresh
            known *= 2
        return sa

    def _bound(self, low, high, word, deep: int, right: bool) -> np.ndarray:
        """First place in ``[low, high)`` whose ``deep``-th word is not below (``right``: is above) ``word``."""
        low, high = low.copy(), high.copy()
        while True:
            going = low < high
            if not going.any():
                return low
            middle = (low + high) >> 1
            at = np.minimum(self.sa[np.minimum(middle, len(self.sa) - 1)] + deep, len(self.text) - 1)
            below = self.text[at] <= word if right else self.text[at] < word
            low, high = np.where(going & below, middle + 1, low), np.where(going & ~below, middle, high)

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per suffix of the items: words of its longest match, a place of it, and the range of its window (empty: none)."""
        m = len(items.words)
        words = np.array([self.numbers.get(w, -1) for w in items.words], dtype=np.int64)
        longest, place = np.zeros(m, dtype=np.int64), np.full(m, -1, dtype=np.int64)
        begin, end = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        active = np.flatnonzero(words > 0)
        low, high = np.zeros(len(active), dtype=np.int64), np.full(len(active), len(self.sa), dtype=np.int64)
        deep = 0
        while len(active):
            word = words[active + deep]
            low = self._bound(low, high, word, deep, False)
            high = self._bound(low, high, word, deep, True)
            some = low < high
            active, low, high = active[some], low[some], high[some]
            deep += 1
            longest[active], place[active] = deep, self.sa[low]
            full = items.window[active] == deep
            begin[active[full]], end[active[full]] = low[full], high[full]
            on = items.left[active] > deep
            active, low, high = active[on], low[on], high[on]
        return longest, place, begin, end

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


def _occurrences(shard: Shard, items: Items, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and test positions of all occurrences of windows, a bounded number at a time."""
    for j in np.flatnonzero(end > begin):
        for start in range(begin[j], end[j], _AT_ONCE):
            places = shard.sa[start : min(end[j], start + _AT_ONCE)]
            yield places, np.full(len(places), j)


def _hits(shard: Shard, blocks: Blocks) -> tuple[np.ndarray, list[list[str]]]:
    """Per document: words inside windows, and the names of items with windows in it."""
    edges = np.zeros(len(shard.text) + 1, dtype=np.int64)
    names: list[set[str]] = [set() for _ in shard.sizes]
    for items in blocks:
        _, _, begin, end = shard.search(items)
        done = set()
        for places, tests in _occurrences(shard, items, begin, end):
            j = tests[0]
            item = items.names[items.owner[j]]
            for d in np.unique(shard.document(places)):
                names[d].add(item)
            # equal windows have the same range; their places are marked once
            mark = (begin[j], end[j], items.window[j], places[0])
            if mark not in done:
                done.add(mark)
                edges[places] += 1
                edges[places + items.window[j]] -= 1
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    return inside[shard.starts[1:]] - inside[shard.starts[:-1]], [sorted(n) for n in names]


def _shards(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Rows of about ``SHARD_BYTES`` of text, as batches, with their texts; null is empty."""
    held, texts, size = [], [], 0
    for batch in slices(batches):
        held.append(batch)
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        texts += [t or b"" for t in column]
        size += sum(len(t) for t in texts[-batch.num_rows :])
        if size >= SHARD_BYTES:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def _items(items: DataFrame, item_id: str, text: str) -> tuple[str, int]:
    """The test items as a table in shared storage; its folder and the words of the longest item."""
    words = F.coalesce(F.col(text), F.lit(""))
    folder = f"{scratch(items.sparkSession)}/apexframe-items-{uuid.uuid4().hex}"
    items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), words.cast("binary").alias("text")).write.parquet(folder)
    longest = items.agg(F.max(F.size(F.regexp_extract_all(words, F.lit(_WORD), 0)))).first()[0]
    return folder, longest or 0


def _blocks(folder: str) -> Blocks:
    return Blocks(folder, ["item", "text"], Items, BLOCK_BYTES)


_FOUND = "n_words long, n_hit long, items array<string>"


def _judged(folder: str, depth: int, text: str):
    """Adds the columns of ``_FOUND`` at the end of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(folder)
        for held, texts in _shards(batches, text):
            shard = Shard(texts, depth)
            n_hit, names = _hits(shard, blocks)
            start = 0
            for batch in held:
                to = start + batch.num_rows
                found = [pa.array(shard.sizes[start:to]), pa.array(n_hit[start:to]), pa.array(names[start:to], pa.list_(pa.string()))]
                fields = [*batch.schema.names, "n_words", "n_hit", "items"]
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], fields)
                start = to

    return run


def judged(docs: DataFrame, items: DataFrame, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items``.

    ``n_hit`` are the words inside any occurrence of a window of ``WINDOW`` item words (all words of a shorter item),
    ``items`` the names of the items with such an occurrence, sorted as strings. Null and empty texts have no words and
    are not hit; an item without words has no window; items without an id are called ``null``; items that repeat an id count
    as one. Repeated rows are judged alike. Texts of any length are searched whole. Other columns are ignored; no
    documents give no rows, and without items nothing is hit.
    """
    folder, depth = _items(items, item_id, item_text)
    rows = small_batches(docs).select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    # the text is dropped inside the task
    found = rows.mapInArrow(_without_text(_judged(folder, depth, "text")), T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(_FOUND).fields]))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items",
    )


def _without_text(run):
    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.select([n for n in batch.schema.names if n != "text"])

    return narrow


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of a test item, columns unchanged; one pass without a shuffle."""
    folder, depth = _items(items, item_id, item_text)
    plain = small_batches(docs)
    # names of their own, so that the found columns clash with none
    renamed = plain.toDF(*[f"c{i}" for i in range(len(plain.columns))])
    at = f"c{[c.lower() for c in plain.columns].index(text.lower())}"
    schema = T.StructType([*renamed.schema.fields, *T._parse_datatype_string(_FOUND).fields])
    return renamed.mapInArrow(_judged(folder, depth, at), schema).filter("n_hit = 0").select(*renamed.columns).toDF(*plain.columns)


_LONGEST = "item_id string, n_words long, item_start long, doc_id string, doc_start long"


def _longest(folder: str, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(folder)
        for held, texts in _shards(batches, "text"):
            shard = Shard(texts, depth)
            ids = [i for batch in held for i in batch["id"].to_pylist()]
            for items in blocks:
                longest, place, _, _ = shard.search(items)
                rows = []
                for k, name in enumerate(items.names):
                    own = slice(items.starts[k], items.starts[k + 1])
                    j = items.starts[k] + int(np.argmax(longest[own]))
                    if longest[j]:
                        d = int(shard.document(place[j]))
                        rows.append((name, int(longest[j]), int(j - items.starts[k]), ids[d], int(place[j] - shard.starts[d])))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in _LONGEST.split(", ")])

    return run


def longest_matches(docs: DataFrame, items: DataFrame, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The longest verbatim match of every item that has a word in common with the documents.

    ``item_id, n_words, item_start, doc_id, doc_start`` (ids as strings, places in words from 0). Of matches of equal
    length one is named, the same each time for the same layout of the input.
    """
    folder, depth = _items(items, item_id, item_text)
    rows = small_batches(docs).select(F.col(row_id).cast("string").alias("id"), F.col(text).alias("text"))
    best = F.max(F.struct("n_words", (-F.col("item_start")).alias("s"), "doc_id", "doc_start")).alias("best")
    found = rows.mapInArrow(_longest(folder, depth), _LONGEST).groupBy("item_id").agg(best)
    return found.select("item_id", "best.n_words", (-F.col("best.s")).alias("item_start"), "best.doc_id", "best.doc_start")
