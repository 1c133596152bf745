"""Words of whole texts as 64-bit hashes, computed for many texts at once inside a task.

Texts come as an Arrow string column. They are cut into blocks of whole texts of a few hundred kilobytes, so the
memory of a task follows the block (or the longest single text), not the batch Spark sends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 19
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
#: The first 0 to 8 bytes of eight.
_HEAD = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE, WORD, MARK = 0, 1, 2
#: Class of a byte where words are what stands between [\x20\x09-\x0D].
BY_SPACE = np.full(256, WORD, dtype=np.uint8)
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = SPACE
#: Class of a byte where words are runs of letters and digits, and runs of other marks count as words of their own.
BY_KIND = np.full(256, MARK, dtype=np.uint8)
BY_KIND[[0x20, *range(0x00, 0x0E)]] = SPACE
BY_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = WORD


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a 64-bit value over all 64."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def run_hashes(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes, eight bytes a step; what lies beyond the first 64 bytes is hashed in one piece."""
    padded = np.concatenate([letters, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(letters) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = (end - start).astype(np.uint64) * _MIX2
    rows, at = np.arange(len(start)), start
    for _ in range(8):
        left = end[rows] - at
        part = out[rows] ^ (eight[at] & _HEAD[np.minimum(left, 8)])
        part *= _MIX1
        out[rows] = part ^ (part >> np.uint64(29))
        more = left > 8
        rows, at = rows[more], at[more] + 8
        if not len(rows):
            break
    for i, begin in zip(rows, at):
        out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(letters[begin : end[i]]))
    return mix(out)


@dataclass
class Words:
    """Words of ``n`` texts: ``hash``, byte range and class of each; those of text ``i`` are ``first[i]:first[i + 1]``."""

    n: int
    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(self.n), self.counts())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1] or bytes(8), dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    return (np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.empty(0, np.uint8)), offsets


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES, block_rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of groups of whole texts."""
    if not len(column):
        return
    data, offsets = buffers(column)
    row, n = 0, len(column)
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), row + block_rows, n)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def words_of(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = BY_SPACE, lower: bool = True) -> Words:
    """Runs of one class other than white space, hashed with A-Z in lower case."""
    n, size = len(offsets) - 1, len(data)
    kind = classes[data]
    breaks = np.zeros(size + 1, dtype=bool)
    breaks[0] = breaks[size] = True
    breaks[offsets] = True
    breaks[1:size] |= kind[1:] != kind[:-1]
    edges = np.flatnonzero(breaks)
    start, end = edges[:-1], edges[1:]
    if size:
        held = kind[start] != SPACE
        start, end = start[held], end[held]
    hashed = run_hashes(LOWER[data] if lower else data, start, end)
    return Words(n, data, offsets, hashed, start, end, kind[start] if size else start.astype(np.uint8), np.searchsorted(start, offsets))


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words that begin at each word, and whether they all belong to its text."""
    total = len(words.hash)
    out = np.zeros(total, dtype=np.uint64)
    for k in range(size):
        held = out[: max(total - k, 0)]  # each step mixes what stands so far, so that the order of words counts
        held ^= words.hash[k:]
        held *= _MIX1
        held ^= held >> np.uint64(29)
    last = np.repeat(words.first[1:], words.counts())
    return mix(out), np.arange(total) + size <= last


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in rising order, one text after the other, and where each text begins.

    A text with fewer than ``size`` words has its whole sequence as one shingle, one without words has none.
    """
    hashed, whole = grams(words, size)
    count = words.counts()
    kept, text = hashed[whole], words.text_of()[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = np.array([_sequence(words.hash[words.first[i] : words.first[i + 1]]) for i in short], dtype=np.uint64)
        kept, text = np.concatenate([kept, own]), np.concatenate([text, short])
    order = np.lexsort((kept, text))
    kept, text = kept[order], text[order]
    new = np.ones(len(kept), dtype=bool)
    new[1:] = (kept[1:] != kept[:-1]) | (text[1:] != text[:-1])
    kept, text = kept[new], text[new]
    return kept, np.searchsorted(text, np.arange(words.n + 1))


def _sequence(hashes: np.ndarray) -> np.uint64:
    out = np.full(1, len(hashes), dtype=np.uint64)
    for h in hashes:
        out = mix((out ^ h) * _MIX2)
    return out[0]
