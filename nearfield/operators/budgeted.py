"""Search of a stored index within a budget: the best so far when time is up, and a proof when it is exact.

Cells are searched in waves, each query's nearest first. After each wave a query is done when no cell that it hasn't seen can hold a
nearer item: the cell's centre is farther than its radius and the k-th distance so far. Waves end when all queries are done, no cell
is left, or time is up; a wave that runs then is cancelled, and what came before it stays.

Defined results: with no time at all nothing is searched; without a deadline the rows are those of `exact.knn`.
"""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cells
from .cell_index import CellIndex, in_cells
from .exact import near_by_block, ranked
from .storage import Scratch

#: Ranked distances are rounded to six digits.
SLACK = 1e-6


def _ahead(index: CellIndex, queries: DataFrame) -> DataFrame:
    """query_id, _cell, at (its place among the query's cells, nearest first) and least, a bound below the distances of its items."""
    radii: dict[int, float] = {}
    for part in index.parts.values():
        for cell, radius in part["radii"].items():
            radii[int(cell)] = max(radius, radii.get(int(cell), 0.0))
    pairs = cells.with_cells(queries.select("query_id", "vector"), index.centres, len(index.centres), index.metric, "_cell", "_apart").select("query_id", "_cell", "_apart")
    radius = F.try_element_at(F.create_map(*(F.lit(x) for cr in radii.items() for x in cr)), F.col("_cell")) if radii else F.lit(None).cast("double")
    gap = F.greatest(F.lit(0.0), F.col("_apart") - radius)
    least = gap * gap / (1 if index.metric == "l2sq" else 2)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_apart", "_cell")) - 1
    return pairs.withColumn("least", least).where("least IS NOT NULL").withColumn("at", place).drop("_apart")  # a cell without radius has no items


def search(index: CellIndex, queries: DataFrame, k: int, deadline_s: float | None = None, wave: int = 1, most_waves: int | None = None, where: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, distance, rank) of the best found, and of each query query_id, cells (searched) and exact.

    wave: cells of a query in the first wave; each next wave has twice as many. deadline_s: seconds from the call on.
    """
    if k < 1 or wave < 1:
        raise ValueError("k and wave must be 1 or more")
    spark = index.spark
    context, ends = spark.sparkContext, None if deadline_s is None else time.monotonic() + deadline_s
    scratch = Scratch(spark)
    known = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "vector").dropDuplicates(["query_id"])
    best = spark.createDataFrame([], "query_id long, id long, distance double, rank long")
    status = known.select("query_id", F.lit(0).cast("long").alias("cells"), F.lit(False).alias("exact"))
    begin, size, n = 0, wave, 0
    ahead = None
    while begin < max(1, len(index.centres)) and (most_waves is None or n < most_waves) and (ends is None or time.monotonic() < ends):
        tag = f"wave-{uuid.uuid4().hex}"
        timer = threading.Timer(max(0.0, ends - time.monotonic()), context.cancelJobsWithTag, [tag]) if ends is not None else None
        context.addJobTag(tag)
        if timer:
            timer.start()
        try:
            if ahead is None:
                ahead = scratch.put(_ahead(index, known))
                open_ = known
            now = ahead.where((F.col("at") >= begin) & (F.col("at") < begin + size)).join(open_, "query_id").select("query_id", "vector", "_cell")
            found = near_by_block(in_cells(index, now, where), now, k, index.metric, F.col("_cell"))
            merged = scratch.put(ranked(best.drop("rank").union(found), k))
            farthest = merged.where(F.col("rank") == k).groupBy("query_id").agg(F.max("distance").alias("far"))
            rest = ahead.where(F.col("at") >= begin + size).groupBy("query_id").agg(F.min("least").alias("least"))
            sure = F.coalesce(F.col("least") > F.col("far") + SLACK, F.col("least").isNull())
            seen = ahead.where(F.col("at") < begin + size).groupBy("query_id").agg(F.count("*").alias("seen"))
            step = status.join(rest, "query_id", "left").join(farthest, "query_id", "left").join(seen, "query_id", "left")
            step = step.select("query_id", F.when(F.col("exact"), F.col("cells")).otherwise(F.coalesce("seen", F.lit(0))).alias("cells"), (F.col("exact") | sure).alias("exact"))
            fresh = scratch.put(step)
            left = known.join(fresh.where("NOT exact").select("query_id"), "query_id", "left_semi")
            more = not left.isEmpty()
        except Exception:
            if ends is None or time.monotonic() < ends:
                raise
            break  # cancelled: what came before it stays
        finally:
            context.removeJobTag(tag)
            if timer:
                timer.cancel()
        scratch.drop(best, status)
        best, status, open_ = merged, fresh, left
        begin, size, n = begin + size, 2 * size, n + 1
        if not more:
            break
    return best, status
