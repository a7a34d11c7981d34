"""Approximate nearest neighbours by cells: items dealt to their nearest centroids, queries joined with their nearest cells.

Centroids come from a few rounds of k-means on a bounded sample of items (`most_sampled` rows, those of the least
hashes of their ids); all items are assigned to cells in tasks, by the broadcast centroids, of which there are
`n_cells`. A search finds the `probes` nearest centroids of each query, joins on the cell, and takes exact products of blocks
there (`near_by_block`), so its work is in line with the cells that are probed, not with the items. With as many probes as cells it is exact.

Defined results: rows without id or vector aren't found; equal distances rank by id; repeated rows are found as often as
they are there; an empty table gives no cells and no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import distances, matrix, near_by_block, ranked


def sampled(items: DataFrame, most: int, metric: str = "cosine", seed: int = 7) -> np.ndarray:
    """At most so many vectors, of length one for cosine: those of the least hashes of their ids."""
    rows = items.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.vector for r in rows], float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric.startswith("cosine") else x


def clustered(x: np.ndarray, n: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of at most n clusters of the rows, by k-means."""
    if not len(x):
        return x
    centres = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = distances("l2sq", x, centres).argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def centroids(items: DataFrame, n_cells: int, metric: str = "cosine", most_sampled: int = 20_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Of a bounded sample, by k-means; for cosine on vectors of length one."""
    return clustered(sampled(items, most_sampled, metric, seed), n_cells, rounds, seed)


def with_cells(rows: DataFrame, centres: np.ndarray, nearest: int = 1, metric: str = "cosine", name: str = "cell", apart: str | None = None) -> DataFrame:
    """All columns and the cell, a row for each of the nearest cells, of rows with a vector.

    name: of the added column, which the rows must not have. apart: of a further one, if wanted: the distance of the vector (for cosine of length one) from the centre.
    """
    if name in rows.columns:
        raise ValueError(f"the rows have a column {name}: give another name")
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    nearest = min(nearest, len(centres))
    at = rows.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                x = matrix(part.column(at)).astype(float)
                if metric.startswith("cosine"):
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                d = distances("l2sq", x, shared.value)
                cells = np.argsort(d, axis=1, kind="stable")[:, :nearest]
                again = pa.array(np.repeat(np.arange(len(x)), nearest))
                more = [pa.array(cells.ravel()), *([pa.array(np.sqrt(np.take_along_axis(d, cells, 1)).ravel())] if apart else [])]
                yield pa.RecordBatch.from_arrays([*(c.take(again) for c in part.columns), *more], names=[*part.schema.names, name, *([apart] if apart else [])])

    known = rows.where("vector IS NOT NULL")
    if not len(centres):
        none = known.where("false").withColumn(name, F.lit(0).cast("long"))
        return none.withColumn(apart, F.lit(0.0)) if apart else none
    return known.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` long", *([f"`{apart}` double"] if apart else [])]))


def search(celled: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, metric: str = "cosine", where: str | None = None) -> DataFrame:
    """query_id, id, distance and rank of the k nearest found in each query's nearest cells. celled: what `with_cells` gives of the items, best written partitioned by cell."""
    if k < 1 or probes < 1:
        raise ValueError("k and probes must be 1 or more")
    asked = with_cells(queries.select("query_id", "vector"), centres, probes, metric)
    items = celled.where("id IS NOT NULL") if where is None else celled.where("id IS NOT NULL").where(where)
    return ranked(near_by_block(items, asked, k, metric, F.col("cell")), k)
