"""Exact neighbours that skip: blocks of near vectors with a centre and a radius, left out where the triangle inequality rules them out.

Items are dealt to cells around centres of a bounded sample and packed by cell, those that a task has at once halved along the widest side down to blocks; each block knows the mean of its vectors and the
distance of the farthest. A first pass compares each query with its own cell alone, which bounds the distance of
its k-th neighbour. Queries are packed by cell too, with a centre, a radius and the largest bound among them, and a second pass joins
just those pairs of blocks for which distance of centres - both radii <= bound. No block that could hold a neighbour is left out, so the rows
are those of `exact.knn`; what is saved depends on how clustered the vectors are.

For l2sq the geometry is that of the roots; for cosine that of unit vectors, where distance d is a chord of sqrt(2 d).
Defined results: as in `exact.knn`; a query with fewer than k items in its cell has no bound and skips nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cells
from .exact import ITEM_BLOCK, MOST_BROADCAST, QUERY_BLOCK, _nearest, matrix, near_by_block, ranked
from .storage import Scratch

#: Ranked distances are rounded to six digits, so a bound may be too small by half of the last.
SLACK = 1e-6


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x


def _tight(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the rows in blocks of at most `size`: halved along the widest side, so that a block's radius is far below that of all."""
    parts, out = [np.arange(len(x))], []
    while parts:
        at = parts.pop()
        if len(at) <= size:
            out.append(at)
            continue
        half = size * (-(-len(at) // size) // 2)
        order = np.argpartition(x[at, np.ptp(x[at], axis=0).argmax()], half)
        parts += [at[order[half:]], at[order[:half]]]
    return out


def _balls(rows: DataFrame, key: str, metric: str, size: int) -> DataFrame:
    """Blocks of one cell each of rows (key, vector, _cell, _bound): dim, ids, vectors, centre, radius and the largest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                whole = matrix(batch.column(1).slice(begin, end - begin)).astype(float)
                for at in _tight(_unit(whole, metric), size):
                    part, x = batch.take(pa.array(begin + at)), whole[at]
                    own = _unit(x, metric)
                    centre = own.mean(0)
                    radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
                    values = [x.shape[1]], [part.column(0).to_numpy().tobytes()], [x.tobytes()], [centre.tolist()], [radius], [float(part.column(3).to_numpy().max())]
                    kinds = pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64()
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["dim", "ids", "vectors", "centre", "radius", "bound"])

    rows = rows.select(F.col(key).cast("long"), "vector", "_cell", F.col("_bound").cast("double")).sortWithinPartitions("_cell")
    return rows.mapInArrow(run, "dim int, ids binary, vectors binary, centre array<double>, radius double, bound double")


def _near_enough() -> Column:
    """Of a block of items and one of queries (q_...): whether an item may be as near to a query as the bound. Slightly generous, as sums are rounded."""
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "q_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda c, x: c + x))
    return apart <= (F.col("radius") + F.col("q_radius") + F.col("q_bound")) * (1 + 1e-9) + 1e-9


def blocks(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", n_cells: int = 64, item_block: int = ITEM_BLOCK, query_block: int = QUERY_BLOCK, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Blocks of items, and blocks of queries with a bound of their k-th distances from the first pass."""
    if metric not in ("cosine", "l2sq"):
        raise ValueError(f"the triangle inequality isn't known to hold for {metric}")
    scratch = Scratch(items.sparkSession)
    known = lambda df, key: df.where(F.col(key).isNotNull() & F.col("vector").isNotNull()).select(F.col(key).cast("long").alias(key), "vector")
    centres = cells.centroids(items, n_cells, metric, seed=seed)
    celled = scratch.put(cells.with_cells(known(items, "id"), centres, metric=metric, name="_cell").repartition("_cell", F.pmod(F.xxhash64("id"), F.lit(16))))
    asked = scratch.put(cells.with_cells(known(queries, "query_id"), centres, metric=metric, name="_cell"))
    own = ranked(near_by_block(celled, asked, k, metric, F.col("_cell")), k).where(F.col("rank") == k).select("query_id", "distance")
    reach = F.sqrt((2 if metric == "cosine" else 1) * (F.col("distance") + SLACK))
    bounded = asked.join(own.distinct(), "query_id", "left").select("query_id", "vector", "_cell", F.coalesce(reach, F.lit(float("inf"))).alias("_bound"))
    n = asked.count()
    few = bounded.repartition(max(1, -(-n // query_block)), "_cell") if n > query_block else bounded.coalesce(1)
    return _balls(celled.withColumn("_bound", F.lit(0.0)), "id", metric, item_block), _balls(few, "query_id", metric, query_block).toDF("q_dim", "q_ids", "q_vectors", "q_centre", "q_radius", "q_bound")


def knn(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", n_cells: int = 64, item_block: int = ITEM_BLOCK, query_block: int = QUERY_BLOCK, seed: int = 7) -> DataFrame:
    """query_id, id, distance and rank, as `exact.knn` gives them."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    own, asked = blocks(items, queries, k, metric, n_cells, item_block, query_block, seed)
    n, dim = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    asked = F.broadcast(asked) if n * (8 * (dim or 0) + 16) <= MOST_BROADCAST else asked
    pairs = own.join(asked, _near_enough()).select("dim", "ids", "vectors", "q_dim", "q_ids", "q_vectors")
    return ranked(pairs.mapInArrow(_nearest(metric, k, 6, False), "query_id long, id long, distance double"), k)


def pairs_kept(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", n_cells: int = 64, item_block: int = ITEM_BLOCK, query_block: int = QUERY_BLOCK, seed: int = 7) -> DataFrame:
    """pairs, of an item and a query, and kept, those in pairs of blocks that `knn` joins."""
    own, asked = blocks(items, queries, k, metric, n_cells, item_block, query_block, seed)
    heads = own.select("centre", "radius", F.length("ids").alias("n")), asked.select("q_centre", "q_radius", "q_bound", F.length("q_ids").alias("m"))
    pair = F.col("n").cast("long") * F.col("m") / 64  # of eight bytes an id
    return heads[0].join(F.broadcast(heads[1]) if queries.count() * 64 <= MOST_BROADCAST else heads[1], F.lit(True)).agg(
        F.coalesce(F.sum(pair), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum(F.when(_near_enough(), pair)), F.lit(0)).cast("long").alias("kept")
    )
