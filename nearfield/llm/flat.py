"""Flat views of Arrow text columns: many texts as one byte array, cut at document ends.

Every Python stage of this subpackage walks its Arrow batches in slices of about half a megabyte of
text (one document at least, however long), so memory is bounded by a slice and never by a
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x).astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x += U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = (mix(np.arange(256)) | U64(1), mix(np.arange(256) + 1000) | U64(1))
_BASES = (U64(0x2545F4914F6CDD1D), U64(0x9E6C63D0876A9A4B))
_POWERS = [np.ones(1, U64), np.ones(1, U64)]
_INVERSES = [np.ones(1, U64), np.ones(1, U64)]


def _inverse(a: U64) -> U64:
    """Of an odd number modulo 2^64."""
    return U64(pow(int(a), -1, 1 << 64))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_POWERS[which]) < n:
        for table, base in ((_POWERS, _BASES[which]), (_INVERSES, _inverse(_BASES[which]))):
            have = table[which]
            step = U64(pow(int(base), len(have), 1 << 64))
            table[which] = np.concatenate([have, have * step])
    return _POWERS[which][:n], _INVERSES[which][:n]


class Fingerprints:
    """64-bit fingerprints of any byte ranges of an array, after one pass over it.

    A polynomial over random byte values modulo 2^64; two instances with different `which` give
    128 bits. Equal ranges get equal fingerprints wherever they stand.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data) + 1
        powers, self.inverses = _powers(n, which)
        self.sums = np.zeros(n, U64)
        np.cumsum(BYTE_VALUES[which][data] * powers[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverses[starts]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in the bytes) of a text column; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def members(pattern_bytes: str) -> np.ndarray:
    """A table of 256 flags from a bytes character class such as r"[^\\x20\\x09-\\x0D]"."""
    import re

    test = re.compile(pattern_bytes.encode("latin-1"))
    return np.array([bool(test.match(bytes([i]))) for i in range(256)])


#: The classes of the word definitions, as flags of bytes: bytes over 0x7F belong to words in both.
NOT_SPACE = members(r"[^\x20\x09-\x0D]")
ALNUM = members(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of maximal runs of member bytes; the words of document i are first[i]:first[i + 1]."""
    inside = member[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each word, from the words' first indices by document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags over consecutive ranges."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def runs_of(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index, document) of the windows of so many consecutive words that lie in one document."""
    n = first[-1]
    doc = owners(first)
    at = np.arange(max(0, n - length + 1))
    keep = doc[: len(at)] == doc[length - 1 :][: len(at)]
    return at[keep], doc[: len(at)][keep]


def window_hashes(word_hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(at), U64)
    for i in range(length):
        out = mix(out ^ word_hashes[at + i])
    return out


def gathered(data: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces data[offsets[i]:offsets[i + 1]] of an index, one after another, and where each ends (from 0)."""
    sizes = offsets[index + 1] - offsets[index]
    ends = np.zeros(len(index) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    at = np.arange(ends[-1]) + np.repeat(offsets[index] - ends[:-1], sizes)
    return data[at], ends


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
