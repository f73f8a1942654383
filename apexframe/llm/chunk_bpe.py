"""Byte-level BPE of whole documents that reuses the encoding of chunks which documents share.

Texts are cut into chunks where a rolling hash of the last 32 bytes has a given form, so equal passages are cut alike
wherever they stand. Chunks of more than one document are encoded once, by the document that owns them, and joined back
to all documents by their hash; what lies between shared chunks is encoded in place. A chunk is only taken over if its
tokens spell the very bytes that stand in the text, so equal hashes of different chunks do no harm.

The tokens at a chunk's ends depend on what follows and precedes it. So every join is repaired: a window around it, from
one sure word border to another, is encoded anew, together with a guard on either side that must come out exactly as it
was; while it does not, the window widens, at last to the whole text. A sure border is one that no word of the
splitting pattern crosses, whatever the rest of the text is: a visible ASCII character followed by ASCII white space.

For tokenizers with a byte-level splitting pattern and no normaliser, in the file format of the tokenizers library;
anything else is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import settle
from .common import slices, small_batches, texts_of

#: Fixed value: the splitting pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A chunk ends where the first CUT_BITS bits of the rolling hash are 0, so it has 2 ** CUT_BITS bytes on average.
CUT_BITS, LEAST = 10, 64
#: The rolling hash is a sum over the last bytes of their random number, shifted by their distance; 32 bits hold 32 bytes.
GEAR = np.random.default_rng(42).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; no chunk has fewer than LEAST bytes, but for the last one, and none splits a character."""
    codes = np.frombuffer(data, dtype=np.uint8)
    rolling = GEAR[codes]
    for k in (1, 2, 4, 8, 16):  # sums over 2k bytes from sums over k bytes
        rolling[k:] = rolling[k:] + (rolling[:-k] << np.uint32(k))
    ends = np.flatnonzero(rolling < 1 << (32 - CUT_BITS)) + 1
    ends = ends[ends < len(data)]
    out, last = [], 0
    for end in ends[(codes[ends] & 0xC0) != 0x80].tolist():
        if end - last >= LEAST:
            out.append(end)
            last = end
    return [*out, len(data)]


class Codec:
    """Encodes and decodes with the vocabulary of a tokenizers file."""

    def __init__(self, file: str):
        j = json.loads(file)
        split, model = j.get("pre_tokenizer") or {}, j["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and model["type"] == "BPE"
        odd = j.get("normalizer") or j.get("truncation") or j.get("padding") or any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        )
        added = j.get("added_tokens", [])
        if not plain or odd or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only byte-level BPE without a normaliser, truncation, padding or stripping tokens")
        # the byte of each letter of the vocabulary: visible Latin-1 letters stand for themselves, the rest follows from 256
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        self.special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the merges are not in the order of the ids")
        self.bytes = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        self.lengths = np.zeros(max(self.bytes) + 1, dtype=np.int64)
        for i, t in self.bytes.items():
            self.lengths[i] = len(t)
        self.kind = np.dtype("<u2" if max(self.bytes) < 1 << 16 else "<u4")
        self._bpe = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between special tokens, and the id of a special token where one stands."""
        for k, part in enumerate(self._split.split(text) if self._split else [text]):
            if part:
                yield part, self.special[part] if k % 2 else None

    def encode(self, data: bytes) -> np.ndarray:
        return np.array(self._bpe.encode_ordinary(data.decode()), dtype=self.kind)

    def spelled(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.spelled(ids).decode("utf-8", errors="replace")


@lru_cache(2)
def codec(file: str) -> Codec:
    return Codec(file)


def _borders(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, dtype=np.uint8)
    space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    return np.flatnonzero(space[1:] & (codes[:-1] > 0x20) & (codes[:-1] < 0x7F)) + 1


class _Line:
    """Tokens of the text so far, with the place in the text where each ends."""

    def __init__(self, tokens: Codec):
        self.tokens, self.parts = tokens, []  # (start, ids, ends)

    def add(self, start: int, ids: np.ndarray) -> None:
        if len(ids):
            self.parts.append((start, ids, start + np.cumsum(self.tokens.lengths[ids])))

    def cut(self, place: int) -> list[np.ndarray] | None:
        """Take off the tokens from ``place`` on, and return them; None, and nothing changes, if a token crosses it."""
        taken, k = [], len(self.parts)
        while k and self.parts[k - 1][0] >= place:
            k -= 1
            taken.append(self.parts[k][1])
        if k:
            start, ids, ends = self.parts[k - 1]
            n = int(np.searchsorted(ends, place, "left")) + 1
            if ends[min(n, len(ends)) - 1] != place:
                return None
            if n < len(ids):
                taken.append(ids[n:])
                self.parts[k - 1 :] = [(start, ids[:n], ends[:n])]
            else:
                del self.parts[k:]
        else:
            self.parts = []
        return taken[::-1]


def _span(tokens: Codec, ids: np.ndarray, ends: np.ndarray, start: int, low: int, high: int) -> np.ndarray | None:
    """The tokens that cover ``low`` to ``high`` exactly, of tokens that begin at ``start``."""
    a = 0 if low == start else int(np.searchsorted(ends, low)) + 1
    b = 0 if high == start else int(np.searchsorted(ends, high)) + 1
    if (a and (a > len(ends) or ends[a - 1] != low)) or (b and (b > len(ends) or ends[b - 1] != high)):
        return None
    return ids[a:b]


def joined(data: bytes, pieces: list[tuple[int, int, np.ndarray]], tokens: Codec) -> np.ndarray:
    """Ids of ``data`` from those of its pieces (start, end, ids), each encoded by itself, by repairing the joins."""
    if len(pieces) == 1:
        return pieces[0][2]
    borders = _borders(data)
    line = _Line(tokens)
    line.add(*pieces[0][::2])
    for start, end, ids in pieces[1:]:
        left = int(np.searchsorted(borders, start, "right")) - 1
        right = int(np.searchsorted(borders, start, "left"))
        if left == right:  # the join is a sure border
            line.add(start, ids)
            continue
        ends = start + np.cumsum(tokens.lengths[ids])
        guard = 1
        while True:
            low = int(borders[left - guard]) if left >= guard else 0
            high = int(borders[right + guard]) if right + guard < len(borders) and borders[right + guard] <= end else end
            window = tokens.encode(data[low:high])
            window_ends = low + np.cumsum(tokens.lengths[window])
            agreed = True
            old = line.cut(low)
            if old is None:
                agreed = False
            else:
                before = np.concatenate(old) if old else window[:0]
                if left >= 0 and low < borders[left]:
                    was = _span(tokens, before, low + np.cumsum(tokens.lengths[before]), low, low, int(borders[left]))
                    now = _span(tokens, window, window_ends, low, low, int(borders[left]))
                    agreed = was is not None and now is not None and np.array_equal(was, now)
                if agreed and high < end:
                    was = _span(tokens, ids, ends, start, int(borders[right]), high)
                    now = _span(tokens, window, window_ends, low, int(borders[right]), high)
                    agreed = was is not None and now is not None and np.array_equal(was, now)
            if agreed or (low == 0 and high == end):
                break
            if old is not None:
                line.add(low, before)
            guard *= 2
        if not agreed and old is None:
            line.parts = []
        line.add(low, window)
        if high < end:
            rest = int(np.searchsorted(ends, high)) + 1
            line.add(high, ids[rest:])
    return np.concatenate([p[1] for p in line.parts])


def _hash(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def encode(text: str, tokens: Codec, known: dict[int, np.ndarray]) -> np.ndarray:
    """Ids of a whole text, given those of some of its chunks by their hash."""
    out = []
    for part, special in tokens.segments(text):
        if special is not None:
            out.append(np.array([special], dtype=tokens.kind))
            continue
        data = part.encode()
        if not known:
            out.append(tokens.encode(data))
            continue
        pieces, fresh, last = [], 0, 0
        for end in cuts(data):
            ids = known.get(_hash(data[last:end]))
            if ids is not None and tokens.spelled(ids) == data[last:end]:
                if fresh < last:
                    pieces.append((fresh, last, tokens.encode(data[fresh:last])))
                pieces.append((last, end, ids))
                fresh = end
            last = end
        if fresh < last:
            pieces.append((fresh, last, tokens.encode(data[fresh:last])))
        out.append(joined(data, pieces, tokens))
    return np.concatenate(out) if out else np.zeros(0, dtype=tokens.kind)


def _chunks(text: str, tokens: Codec) -> dict[int, bytes]:
    """The chunks of a text by their hash."""
    out = {}
    for part, special in tokens.segments(text):
        if special is None:
            data, last = part.encode(), 0
            for end in cuts(data):
                out[_hash(data[last:end])] = data[last:end]
                last = end
    return out


def _hashed(file):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(file.value)
        for batch in slices(batches):
            keys, hashes = [], []
            for key, text in zip(batch["key"].to_pylist(), texts_of(batch, "text")):
                found = list(_chunks(text, tokens))
                keys += [key] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], ["key", "hash"])

    return run


def _encoded(file):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(file.value)
        for batch in slices(batches, 64):
            hashes, ids = [], []
            for own, text in zip(batch["own"].to_pylist(), texts_of(batch, "text")):
                chunks = _chunks(text, tokens)
                for h in own:
                    if h in chunks:
                        hashes.append(h)
                        ids.append(tokens.encode(chunks[h]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(ids, pa.binary())], ["hash", "ids"])

    return run


def _assembled(file):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(file.value)
        for batch in slices(batches, 64):
            rows = []
            for row_id, known, text in zip(batch["id"].to_pylist(), batch["known"].to_pylist(), texts_of(batch, "text")):
                have = {x["hash"]: np.frombuffer(x["ids"], dtype=tokens.kind) for x in known or ()}
                ids = encode(text, tokens, have)
                rows.append((row_id, len(ids), ids.astype("<u4").tobytes(), tokens.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.string()))], ["doc_id", "n_tokens", "ids", "decoded"]
            )

    return run


def chunk_encoding(docs: DataFrame, tokenizer_file: str, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit integers) and ``decoded`` text.

    The ids are those of the tokenizers library for the whole text without added tokens; special tokens that stand in a
    text are recognised. Null text is empty: no ids. Null ids and repeated rows are rows like others, an empty table gives
    none, other columns are ignored. ``tokenizer_file`` is read here and sent to the tasks; a vocabulary has a few MB.

    A chunk is shared if two rows have it. A text is shuffled once, by the hash of its row.
    """
    spark = small_batches(docs).sparkSession
    with open(tokenizer_file, encoding="utf-8") as opened:
        file = spark.sparkContext.broadcast(opened.read())
    codec(file.value)  # refuses a tokenizer it cannot do
    rows = docs.select(F.col(row_id).cast("long").alias("id"), F.xxhash64(row_id, text).alias("key"), F.col(text).alias("text"))
    uses = settle(rows.select("key", "text").mapInArrow(_hashed(file), "key long, hash long"))
    shared = uses.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("owner")).filter("n > 1")
    owned = shared.groupBy(F.col("owner").alias("key")).agg(F.collect_list("hash").alias("own"))  # at most a document's chunks
    # the id is not needed here, but with the same columns both joins share one shuffle of the texts
    encoded = rows.join(owned, "key").select("id", "own", "text").mapInArrow(_encoded(file), "hash long, ids binary")
    known = encoded.groupBy("hash").agg(F.first("ids").alias("ids"))  # rows that are repeated own the same chunks
    # a set, so that rows that are repeated do not add up
    given = uses.join(known, "hash").groupBy("key").agg(F.collect_set(F.struct("hash", "ids")).alias("known"))
    return rows.join(given, "key", "left").select("id", "text", "known").mapInArrow(
        _assembled(file), "doc_id long, n_tokens long, ids binary, decoded string"
    )


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` and the digests of ids and decoded text."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
