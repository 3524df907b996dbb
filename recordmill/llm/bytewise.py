"""Array work on the UTF-8 bytes of many texts at once: words, hashes, windows.

Texts come as one byte array with offsets, in runs of about ``RUN_BYTES`` (a longer text is a run of its own), so that the
working arrays stay in cache and memory follows the longest text, not the Arrow batch. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_seeded = np.random.default_rng(20240229)
_CODE = _seeded.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_seeded.integers(1, 1 << 60)) * 8 + 5
_BACK = pow(_BASE, -1, 1 << 64)
_tables = {"power": np.ones(1, np.uint64), "back": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["power"]) < n + 1:
        size = max(n + 1, RUN_BYTES + 1)
        for name, base in (("power", _BASE), ("back", _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["power"], _tables["back"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``range_hash`` gives the hash of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    power, _ = _powers(len(data))
    np.cumsum(_CODE[data] * power[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start, end) -> np.ndarray:
    """64-bit hash of the bytes from ``start`` up to ``end``; equal bytes have equal hashes wherever they stand."""
    _, back = _powers(len(prefix) - 1)
    return mix((prefix[end] - prefix[start]) * back[start])


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls as empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive texts."""
    if not len(column):
        return
    data, offsets = as_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that aren't ASCII white space), and each text's offsets among them."""
    inside = ~SPACE[data]
    size = np.diff(offsets) > 0
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        head, tail = offsets[:-1][size], offsets[1:][size] - 1
        first[head], last[tail] = inside[head], inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text that each item belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(word_hash: np.ndarray, offsets: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive words within a text, and each text's offsets among them.

    ``short``: a text with some words, but fewer than k, gives its whole sequence as one.
    """
    n = np.diff(offsets)
    made = np.maximum(n - k + 1, 0)
    if short:
        made = np.where((n > 0) & (n < k), 1, made)
    out = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], made)
    end = np.minimum(at + k, np.repeat(offsets[1:], made))
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        here = at + i < end
        h = np.where(here, mix(h * np.uint64(_BASE) + word_hash[np.minimum(at + i, max(len(word_hash) - 1, 0))]), h) if len(at) else h
    return h, out


def first_seen(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each item is the first of its value within its owner."""
    key = value ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(len(key), bool)
    out[order] = new
    return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's items."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "u" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
