"""Word shingles of whole Arrow text batches as 64-bit hashes, computed with numpy.

Texts are never turned into Python strings: words are found in the UTF-8 bytes of the batch. A word
hash is a sum of its bytes times fixed pseudo-random weights by position, a shingle hash mixes the
hashes of its words, so equal shingles always meet and unequal ones do with odds of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes worked on at once; temporary arrays take some forty times as much.
PIECE_BYTES = 1 << 18

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_weights = np.zeros(0, dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit over all others."""
    x = values + _GOLDEN
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _position_weights(length: int) -> np.ndarray:
    global _weights
    if len(_weights) < length:
        _weights = mix(np.arange(max(256, length), dtype=np.uint64)) | np.uint64(1)
    return _weights


def _words(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts that lie end to end, and the words before each text."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(starts_at), dtype=np.int64)
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = starts_at[starts_at < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, starts_at)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), before
    letters = np.flatnonzero(inside)
    at = np.searchsorted(letters, starts)
    lengths = np.diff(at, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(at, lengths)
    weighted = _position_weights(int(lengths.max()))[place]
    weighted *= _LOWER[data[letters]]
    sums = np.add.reduceat(weighted, at)
    return mix(sums + lengths.astype(np.uint64) * _GOLDEN), before


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text that is longer than a piece, cut only at separators."""
    found, at = [], 0
    zero = np.zeros(1, dtype=np.int64)
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data) and not _SEPARATOR[data[end - 1]]:
            gap = np.flatnonzero(_SEPARATOR[data[end : end + PIECE_BYTES]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + PIECE_BYTES, len(data))
        found.append(_words(data[at:end], zero)[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words that begin at each word; fewer than that give one shingle."""
    take = min(width, len(words))
    if not take:
        return words
    size = len(words) - take + 1
    total = np.full(size, np.uint64(take), dtype=np.uint64)
    for k in range(take):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total ^= words[k : k + size]
        total = mix(total)
    return total


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and where each text begins and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text in turn the sorted distinct shingle hashes; none for a text without words."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        if offsets[row + 1] - offsets[row] > PIECE_BYTES:
            words = _long_words(data[offsets[row] : offsets[row + 1]])
            yield np.unique(_shingles(words, width))
            row += 1
            continue
        end = int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1
        end = max(row + 1, min(end, rows))
        words, before = _words(
            data[offsets[row] : offsets[end]], offsets[row:end] - offsets[row]
        )
        bounds = np.append(before, len(words))
        full = _shingles(words, width) if len(words) >= width else words
        for k in range(end - row):
            lo, hi = int(bounds[k]), int(bounds[k + 1])
            if hi - lo >= width:
                yield np.unique(full[lo : hi - width + 1])
            else:
                yield np.unique(_shingles(words[lo:hi], width))
        row = end


def set_fingerprint(hashes: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set of hashes; equal sets have equal ones."""
    total = np.full(1, len(hashes), dtype=np.uint64) * _GOLDEN
    if len(hashes):
        total ^= np.add.reduce(mix(hashes ^ np.uint64(0xA5A5F00DC0FFEE11)))
    return int(mix(total).view(np.int64)[0])
