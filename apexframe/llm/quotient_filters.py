"""Counting quotient filters over packed n-grams of word numbers.

A key is up to four word numbers of ``bits`` bits, packed into two halves; absent words are 0. A Feistel network permutes the
keys, which spreads them evenly and can be undone. A filter sorts the permuted keys, splits each into a quotient and
its full remainder, and keeps the remainders in slots in quotient order, with one bit per quotient that occurs, one bit per
slot that ends a run of one quotient, and a counter per slot: one byte, or, where that is 255, a number in a list beside it.
Nothing is approximate: a filter gives back exactly the keys and counts that went in.

A filter holds the keys of one segment, which is a number of first bits of the permuted key. Filters of one segment are
merged by decoding, merging the sorted keys and adding up the counts of equal ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
#: Odd multipliers of the rounds; fixed values.
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _mask(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def _mixed(half: np.ndarray, factor: int, bits: int) -> np.ndarray:
    x = half * _U(factor)
    x ^= x >> _U(32)
    x *= _U(factor)
    return (x >> _U(29) ^ x) & _mask(bits)


def permute(high: np.ndarray, low: np.ndarray, half_bits: int) -> tuple[np.ndarray, np.ndarray]:
    for factor in _ROUNDS:
        high, low = low, high ^ _mixed(low, factor, half_bits)
    return high, low


def restore(high: np.ndarray, low: np.ndarray, half_bits: int) -> tuple[np.ndarray, np.ndarray]:
    for factor in reversed(_ROUNDS):
        high, low = low ^ _mixed(high, factor, half_bits), high
    return high, low


def summed(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, half_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys sorted, each once, with the sum of its counts (each row counts 1 without any)."""
    if not len(high):
        return high, low, np.zeros(0, dtype=np.int64)
    if half_bits <= 32:
        key = high << _U(half_bits) | low
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        high, low = key[new] >> _U(half_bits), key[new] & _mask(half_bits)
        n = len(key)
    else:
        # by the first 64 bits; only if keys differ in the others alone, which is rare after the permutation, by all
        first = high << _U(64 - half_bits) | low >> _U(2 * half_bits - 64)
        order = np.argsort(first, kind="stable")
        first, rest = first[order], low[order]
        if ((first[1:] == first[:-1]) & (rest[1:] != rest[:-1])).any():
            order = np.lexsort((low, high))
        high, low = high[order], low[order]
        counts = counts if counts is None else counts[order]
        n = len(high)
        new = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
        high, low = high[new], low[new]
    total = np.diff(np.append(new, n)) if counts is None else np.add.reduceat(counts, new)
    return high, low, total.astype(np.int64)


@dataclass
class Filter:
    """The encoded form; ``quotient_bits`` counts from the segment on, ``entries`` are the slots."""

    quotient_bits: int
    entries: int
    occupied: bytes
    run_ends: bytes
    remainders: bytes
    counters: bytes
    large: bytes


def _packed(values: np.ndarray, width: int) -> bytes:
    """The last ``width`` bytes of every number."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes() if width else b""


def _unpacked(data: bytes, width: int, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), dtype=np.uint8)
    if width:
        wide[:, 8 - width :] = np.frombuffer(data, dtype=np.uint8).reshape(n, width)
    return wide.view(">u8").reshape(n).astype(np.uint64)


def _widths(half_bits: int, segment_bits: int, quotient_bits: int) -> tuple[int, int]:
    """Bytes of a remainder that come from the high half, and from the low one."""
    return (half_bits - segment_bits - quotient_bits + 7) // 8, (half_bits + 7) // 8


def encode(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half_bits: int, segment_bits: int) -> Filter:
    """A filter of sorted permuted keys that share their first ``segment_bits`` bits."""
    n = len(high)
    quotient_bits = min(max(n - 1, 0).bit_length(), half_bits - segment_bits)
    rest_bits = half_bits - segment_bits - quotient_bits
    rest = high & _mask(half_bits - segment_bits)
    quotient, remainder = (rest >> _U(rest_bits)).astype(np.int64), rest & _mask(rest_bits)
    occupied = np.zeros(1 << quotient_bits, dtype=bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, dtype=bool)
    wide_high, wide_low = _widths(half_bits, segment_bits, quotient_bits)
    many = counts >= 255
    return Filter(
        quotient_bits, n, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), _packed(remainder, wide_high) + _packed(low, wide_low),
        np.where(many, 255, counts).astype(np.uint8).tobytes(), counts[many].astype("<i8").tobytes(),
    )


def decode(f: Filter, segment: int, half_bits: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted permuted keys of a filter, and their counts."""
    n = f.entries
    rest_bits = half_bits - segment_bits - f.quotient_bits
    ends = np.unpackbits(np.frombuffer(f.run_ends, dtype=np.uint8), count=n).astype(np.int64)
    run = np.cumsum(ends) - ends
    quotient = np.flatnonzero(np.unpackbits(np.frombuffer(f.occupied, dtype=np.uint8), count=1 << f.quotient_bits))[run].astype(np.uint64)
    wide_high, wide_low = _widths(half_bits, segment_bits, f.quotient_bits)
    remainder = _unpacked(f.remainders[: n * wide_high], wide_high, n)
    low = _unpacked(f.remainders[n * wide_high :], wide_low, n)
    top = _U(segment << f.quotient_bits) | quotient
    # a shift by 64 bits is not defined
    high = (top << _U(rest_bits) if rest_bits < 64 else np.zeros_like(top)) | remainder
    counts = np.frombuffer(f.counters, dtype=np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(f.large, dtype="<i8")
    return high, low, counts


def split(high: np.ndarray, low: np.ndarray, counts: np.ndarray, half_bits: int, segment_bits: int):
    """Filters of sorted permuted keys by segment: pairs of segment and filter."""
    segment = high >> _U(half_bits - segment_bits) if segment_bits else np.zeros_like(high)
    starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(high) else []
    for start, end in zip(starts, [*starts[1:], len(high)]):
        yield int(segment[start]), encode(high[start:end], low[start:end], counts[start:end], half_bits, segment_bits)
