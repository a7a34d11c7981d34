"""Bitmaps of bounded size that tell tasks which rows can matter before a shuffle.

A bitmap lets every row of its set through, and some others by chance, which the join that follows drops.
Its size follows the set up to a bound; beyond, it lets more through, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .flat import U64, mix

CHUNK = 1 << 16


def slots(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    return mix(a.astype(U64) ^ mix(b)) % U64(8 * size)


def _places(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = slots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slot // (8 * CHUNK)).astype(np.int32)), pa.array((slot % (8 * CHUNK)).astype(np.int32))], names=["chunk", "bit"])

    return run


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bitmaps: dict[int, np.ndarray] = {}
    for batch in batches:
        chunk, bit = (batch.column(i).to_numpy() for i in (0, 1))
        for c in np.unique(chunk).tolist():
            own = bitmaps.setdefault(c, np.zeros(CHUNK, np.uint8))
            at = bit[chunk == c]
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(bitmaps), pa.int32()), pa.array([x.tobytes() for x in bitmaps.values()], pa.binary())], names=["chunk", "bytes"])


def bitmap_of(pairs: DataFrame, most_bytes: int = 8 << 20) -> np.ndarray:
    """Of a table of two long columns: a byte for each row, up to the bound. The driver gets the bitmap alone, in chunks."""
    size, count = CHUNK, pairs.count()
    while size < most_bytes and size < count:
        size *= 2
    chunks = pairs.mapInArrow(_places(size), "chunk int, bit int").repartition("chunk").mapInArrow(_filled, "chunk int, bytes binary")
    bitmap = np.zeros(size, np.uint8)
    for chunk, bytes_ in chunks.toLocalIterator():
        bitmap[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(bytes_, np.uint8)
    return bitmap


def maybe_in(bitmap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    slot = slots(a, b, len(bitmap))
    return ((bitmap[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1).astype(bool)
