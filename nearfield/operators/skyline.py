"""Rows that no other row dominates, for any number of goals that are to be large.

First every task keeps the front of the points that it reads, by key, and passes on just that. The fronts are dealt by ranges of keys, thinned again and packed into blocks with their
least and largest corner, so that a key of few points has one block, or two at a seam; of a key of many points a pair of blocks meets only where a point of the second can dominate one of the first, and gives
the points of the first that it dominates. What is left of the fronts, joined with the rows, is the result. Keys are many to a task or many tasks to a key; no task need see all
points of a key, and what is shuffled are fronts, and for the last join the rows.

Defined results: equal optima all stay; rows with a null or NaN goal are left out; a null key is a key of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

BLOCK = 1024
#: Points that a task holds before it thins them, and half of which it passes on then.
MOST_HELD = 200_000
#: Points of a key up to which those of all keys are compared at once, in order.
FEW = 256


def dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points have one of the others at least as good in all goals and better in one."""
    out = np.zeros(len(points), bool)
    for i in range(0, len(points), 256):
        some = points[i : i + 256, None]
        out[i : i + 256] = ((by[None] >= some).all(2) & (by[None] > some).any(2)).any(1)
    return out


def front(points: np.ndarray) -> np.ndarray:
    """The different points that none dominates."""
    points = np.unique(points, axis=0)[::-1]  # what comes later can't dominate what came before
    kept = points[:0]
    for i in range(0, len(points), 256):
        some = points[i : i + 256]
        some = some[~dominated(some, kept)]
        kept = np.concatenate([kept, some[~dominated(some, some)]])
    return kept


def thinned(own: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different points that none of the same key (own, a number) dominates, and their keys."""
    order = np.lexsort((*(-points.T[::-1]), own))  # what comes later in a key can't dominate what came before
    own, points = own[order], points[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (points[1:] != points[:-1]).any(1)
    own, points = own[new], points[new]
    firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    sizes = np.diff(firsts, append=len(own))
    place, few = np.arange(len(own)) - np.repeat(firsts, sizes), np.repeat(sizes <= FEW, sizes)
    kept, open_ = few.copy(), np.flatnonzero(few)
    others = [np.ascontiguousarray(c) for c in points.T[1:]]
    for step in range(1, min(FEW, sizes.max(initial=0))):  # each with the one so many places before it
        open_ = open_[place[open_] >= step]
        beaten = np.ones(len(open_), bool)
        for c in others:
            beaten &= c[open_ - step] >= c[open_]
        kept[open_[beaten]] = False
        open_ = open_[~beaten]
    parts = [(own[kept], points[kept])]
    for i in np.flatnonzero(sizes > FEW):
        many = front(points[firsts[i] : firsts[i] + sizes[i]])
        parts.append((np.full(len(many), own[firsts[i]]), many))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _batch(keys: pa.Array, points: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, *(pa.array(c) for c in points.T)], names=["_key", *(f"_g{i}" for i in range(points.shape[1]))])


def _fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def front_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        names = batch.column(0).dictionary_encode()
        own, points = thinned(names.indices.to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1))
        return _batch(names.dictionary.take(pa.array(own)), points)

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= MOST_HELD:
            held = [front_of(held)]
            if 2 * (n := held[0].num_rows) > MOST_HELD:
                yield held[0]
                held, n = [], 0
    if held:
        yield front_of(held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        own, points = names.indices.to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        spans = [(i, min(i + BLOCK, end)) for begin, end in zip(cuts, cuts[1:], strict=False) for i in range(begin, end, BLOCK)]
        some = [points[i:j] for i, j in spans]
        values = names.dictionary.take(pa.array(own[[i for i, _ in spans]])), [p.tobytes() for p in some], [p.min(0).tolist() for p in some], [p.max(0).tolist() for p in some]
        yield pa.RecordBatch.from_arrays([values[0], pa.array(values[1], pa.binary()), *(pa.array(v, pa.list_(pa.float64())) for v in values[2:])], names=["_key", "points", "low", "high"])


def _beaten(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                points = np.frombuffer(a).reshape(-1, n)
                points = points[dominated(points, np.frombuffer(b).reshape(-1, n))]
                yield _batch(pa.array([key] * len(points), pa.string()), points)

    return run


def skyline(rows: DataFrame, keys: list[str], goals: list[str]) -> DataFrame:
    """The rows that no row of the same keys dominates: none is at least as good in all goals and better in one."""
    if not goals:
        raise ValueError("a goal is needed")
    n = len(goals)
    names = [f"_g{i}" for i in range(n)]
    schema = ", ".join(["_key string", *(f"{g} double" for g in names)])
    value = lambda g: F.col(f"`{g}`").cast("double") + F.lit(0.0)  # noqa: E731  no negative zero
    key = F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys))) if keys else F.lit("")
    known = rows.where(reduce(lambda a, b: a & b, (F.col(f"`{g}`").isNotNull() & ~F.isnan(value(g)) for g in goals)))
    points = known.select(key.alias("_key"), *(value(g).alias(x) for g, x in zip(goals, names, strict=True)))
    scratch = Scratch(rows.sparkSession)
    own = scratch.put(points.mapInArrow(_fronts, schema))
    fronts = scratch.put(own.repartitionByRange("_key", *names).sortWithinPartitions("_key", *names).mapInArrow(_fronts, schema))
    scratch.drop(own)
    packed = fronts.sortWithinPartitions("_key", *names).mapInArrow(_blocks, "_key string, points binary, low array<double>, high array<double>")
    blocks = scratch.put(packed.withColumn("block", F.monotonically_increasing_id()))
    a, b = blocks.alias("a"), blocks.alias("b")
    can = F.forall(F.zip_with("a.low", "b.high", lambda x, y: y >= x), lambda ok: ok) & (F.col("a._key") == F.col("b._key")) & (F.col("a.block") != F.col("b.block"))
    pairs = a.join(b, can).select("a._key", F.col("a.points"), F.col("b.points"))
    beaten = pairs.toDF("_key", "p", "q").mapInArrow(_beaten(n), schema).distinct()
    left = fronts.join(beaten, ["_key", *names], "left_anti")
    found = known.withColumns({"_key": key} | {x: value(g) for g, x in zip(goals, names, strict=True)})
    return found.join(left, ["_key", *names], "left_semi").select(*(F.col(f"`{c}`") for c in rows.columns))
