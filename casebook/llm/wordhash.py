"""64-bit hashes of the words of Arrow texts, in whole-array steps over their UTF-8 bytes.

ASCII letters are folded to lower case. A word is a run of bytes of one class, so classes may
only tell ASCII characters apart; bytes from 0x80 on belong to one side. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for word bytes: all but the given inclusive ranges, A-Z being as a-z."""
    word = np.ones(256, bool)
    for low, high in ranges:
        word[low:high + 1] = False
    word[65:91] = word[97:123]
    return word


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    step = np.uint64(0x9E3779B97F4A7C15)
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 40)) * step)


_BYTES = _numbers(256, 1)
_BYTES[65:91] = _BYTES[97:123]
_PLACES = _numbers(1 << 12, 2) | np.uint64(1)


def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes behind a column of strings or binaries and the offsets of its rows, uncopied."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64 if wide else np.int32)
    places = places[column.offset:column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_, places


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows in them; null is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return cells(pc.fill_null(column, "") if column.null_count else column)


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray):
    """Hashes of all words in order, and the number of words of each row."""
    low, high = int(offsets[0]), int(offsets[-1])
    block, rows = data[low:high], offsets - low
    if low == high:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = word[block]
    edges = rows[(rows > 0) & (rows < len(block))]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edges] = inside[edges]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    kept = np.flatnonzero(inside)
    firsts = np.searchsorted(kept, starts)
    lengths = np.diff(firsts, append=len(kept))
    places = np.arange(len(kept)) - np.repeat(firsts, lengths)
    longest = int(lengths.max())
    table = _PLACES if longest <= len(_PLACES) else _numbers(longest, 2) | np.uint64(1)
    values = _BYTES[block[kept]] * table[places]
    hashes = mixed(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, rows))


def blocks(
    column: pa.Array, word: np.ndarray, size: int = BLOCK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, hashes, words per row)`` for consecutive rows of bounded size."""
    data, offsets = texts(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, *word_hashes(data, offsets[first:end + 1], word)
        first = end
