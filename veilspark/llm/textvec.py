"""Whole-batch text primitives in numpy.

An Arrow string column is already one byte buffer plus offsets.  These helpers work on
that buffer for many documents at once: they find words, hash them and combine the hashes
into n-grams with a fixed number of vector passes, so no Python code runs per word.
A batch is cut into chunks of about ``CHUNK`` bytes, which bounds the memory of a worker
whatever the batch size; one text longer than that is a chunk of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 0x2545F4914F6CDD1D
#: bytes of the longest range that is hashed in vector rounds
LONG = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def lut(keep) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    table = np.zeros(256, bool)
    table[[b for b in range(256) if keep(b)]] = True
    return table


#: bytes between white space (space, tab, newline, vertical tab, form feed, return)
NOT_SPACE = lut(lambda b: b not in (9, 10, 11, 12, 13, 32))
#: digits, a-z and every byte of a non-ASCII character; input is lower-cased first
ALNUM = lut(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: A-Z to a-z, all other bytes as they are
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string (or binary) column; null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        return string_column(column.cast(pa.large_string()))
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column: first row, last row (exclusive), bytes, offsets from 0."""
    data, offsets = string_column(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of kept bytes within a row, and for each row the first word's number."""
    inside = keep[data]
    begin, stop = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[edge] = inside[edge]
        edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        stop[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes wherever they stand.

    Eight bytes a round, each round mixed without any linear relation between bytes and hash; ranges
    of more than ``LONG`` bytes take BLAKE2b.
    """
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(size.astype(U64) + U64(_SEED))
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        block = blocks[starts[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]
        out[live] = mix(out[live] ^ block) + mix(block * U64(_BASE) + U64(at + 1))
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk in order, and for each row the first word's number."""
    starts, ends, first = words(data, offsets, keep)
    return span_hash(data, starts, ends), first


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive words from each position; the last n - 1 positions have none."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    out = np.zeros(size, U64)
    for k in range(n):
        out *= U64(0xD6E8FEB86659FD93)
        out += hashes[k : k + size]
    return mix(out)


def row_numbers(first: np.ndarray) -> np.ndarray:
    """Row of each word, from the rows' first word numbers."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; it depends on that row's values alone, to the last bit."""
    out, some = np.zeros(len(first) - 1), np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.add.reduceat(np.asarray(values, np.float64), first[:-1][some])
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each row, sorted in the row, and each row's first.

    A row with fewer words than n has one shingle of all its words; one without words has none.
    """
    rows, counts = len(first) - 1, np.diff(first)
    grams = ngrams(hashes, n)
    row = row_numbers(first)[: len(grams)]
    whole = np.arange(len(grams)) + n <= first[1:][row] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < n))
    values = [grams[whole]]
    owner = [row[whole]]
    for k in range(1, n):
        of = short[counts[short] == k]
        if len(of):
            key = np.full(len(of), 0x51ED270B + k, U64)
            for j in range(k):
                key = key * U64(0xD6E8FEB86659FD93) + hashes[first[of] + j]
            values.append(mix(key))
            owner.append(of)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(owner, kind="stable") if len(short) else slice(None)
    values, owner = values[order], owner[order]
    at = np.searchsorted(owner, np.arange(rows + 1)).tolist()
    for a, b in zip(at[:-1], at[1:]):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(rows + 1))


def word_keys(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> list[bytes | None]:
    """A 128-bit BLAKE2b digest of each row's words joined by blanks; None for a row without words."""
    starts, ends, first = words(data, offsets, keep)
    if not len(starts):
        return [None] * (len(offsets) - 1)
    kept = keep[data]
    last = np.zeros(len(ends), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    gaps = ends[~last]
    kept[gaps] = True
    text = data.copy()
    text[gaps] = 32
    at = np.concatenate(([0], np.cumsum(kept)))[offsets].tolist()
    text = text[kept].tobytes()
    return [hashlib.blake2b(text[a:b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:])]
