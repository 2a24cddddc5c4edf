"""Array kernels over the UTF-8 buffers of Arrow string columns: words, their hashes, shingles.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; these bytes never occur inside a multi-byte
character, so runs of bytes are runs of characters. Letters A-Z are lower-cased before hashing, nothing else.
Hashes have 64 bits; codes() tells words apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WS = np.zeros(256, dtype=bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text, or of one row."""
    _, at = utf8(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def runs(data: np.ndarray, at: np.ndarray, kind: np.ndarray = ~WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte length and row of each maximal run of bytes of a kind (256 booleans): of each word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) - starts + 1, np.searchsorted(at, starts, "right") - 1


def pick(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of stretches one after another, and their offsets."""
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - ends + lengths, lengths) + np.arange(int(lengths.sum()), dtype=np.int64)], np.concatenate([[0], ends]).astype(np.int64)


def codes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number from 0 for each stretch of bytes, equal only where the bytes are equal, and the distinct stretches."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    picked, offsets = pick(data, starts, lengths)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(picked)])
    found = column.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct whole numbers ascending, and which of them each is. Only the distinct ones are sorted."""
    found = pa.array(x).dictionary_encode()
    values = found.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(values)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], rank[found.indices.to_numpy()]


def _hash_block(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lower: bool) -> np.ndarray:
    """Every eight bytes are mixed with a key of their place before they are added up, so no sum of bytes cancels out."""
    low = int(starts.min())
    held = data[low : int((starts + lengths).max())]
    padded = np.concatenate([LOWER[held] if lower else held, np.zeros(8, np.uint8)])
    each = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from each place
    blocks = (lengths + 7) >> 3
    begins = np.cumsum(blocks) - blocks
    within = np.arange(int(blocks.sum()), dtype=np.int64) - np.repeat(begins, blocks)
    value = each[np.repeat(starts - low, blocks) + 8 * within]
    left = np.repeat(lengths, blocks) - 8 * within
    value &= np.uint64(2**64 - 1) >> ((8 - np.minimum(left, 8)).astype(np.uint64) << np.uint64(3))
    keys = mix(np.arange(int(blocks.max()), dtype=np.uint64), 7)
    return mix(np.add.reduceat(mix(mix(value, 5) + keys[within], 6), begins) ^ mix(lengths.astype(np.uint64), 8))


def hash_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lower: bool = True, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each run of bytes; runs have a byte at least. Some `most` bytes are at work at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    edges = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(most, int(ends[-1]), most)), [len(starts)]]))
    return np.concatenate([_hash_block(data, starts[a:b], lengths[a:b], lower) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of 64-bit numbers, all first bytes first: high ones are mostly equal and compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    starts, lengths, rows = runs(data, at)
    return hash_runs(data, starts, lengths), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row as (hashes, row offsets), hashes ascending within a row. A row with words but
    fewer than size has its whole sequence as one shingle; a row without words has none."""
    counts = np.bincount(rows, minlength=n_rows)
    total = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for j in range(size):
        total += hashes[j : j + len(total)] * powers(size + 1)[j]
    whole = rows[: len(total)] == rows[size - 1 : size - 1 + len(total)]
    key, row = [mix(total[whole], 1)], [rows[: len(total)][whole]]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        a, b = np.searchsorted(rows, [r, r + 1])
        value = (hashes[a:b] * powers(size + 1)[: b - a]).sum(keepdims=True)
        key.append(mix(value, 2 + int(b - a)))
        row.append(np.array([r], rows.dtype))
    key, row = np.concatenate(key), np.concatenate(row)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    return key, np.searchsorted(row, np.arange(n_rows + 1))
