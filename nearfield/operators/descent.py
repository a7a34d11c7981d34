"""A graph of nearest neighbours without comparing all pairs: neighbours of neighbours are compared, round by round.

Every node starts with the nearest of a few random groups of `GROUP` nodes. In a round each node has its `pool` edges and at most as many
reversed ones (a reservoir by hash, so that a node with many of them gives no task more); all pairs of these that a fresh edge brought
together are compared in a task, and a pair goes on only if it is nearer than the farthest that an end of it holds by now.
Edges are merged by node. Rounds settle when few edges change. So a round makes at most n * 2 * pool rows of neighbours with
vectors, and n * (2 * pool) ** 2 comparisons, in line with n.

Where vectors have little structure, settled edges miss many neighbours. So a bounded sample of nodes is compared with all, and while edges
hold less than `wanted` of its neighbours, nodes are dealt anew, `DEALS` times at once, by random planes into leaves of about `LEAF` nodes (larger ones
are split by hash), which are compared each in a task, and a round spreads what was found. Such a deal too is in line with n; how many there
are depends on the vectors.

Defined results: rows without id or vector are no nodes; of repeated ids one row counts; equal distances rank by id; a node of fewer than k others has edges
to those that it met; an edge of the same distance as the farthest goes on if its id is smaller. An approximate graph: `descent_recall` in the tests and queries holds it against the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exact import candidates, distances, knn, matrix, near_by_block
from .storage import Scratch

GROUP = 64
#: Nodes of a leaf (up to twice as many), and the most deals of a round.
LEAF, DEALS = 512, 16
#: Nodes that are compared with all to tell how many of their neighbours were found, and by whose vectors planes are drawn.
SAMPLE = 1000


def _start(nodes: DataFrame, n: int, pool: int, metric: str, times: int, seed: int) -> DataFrame:
    groups = max(1, n // GROUP)
    parts = []
    for t in range(times):
        dealt = nodes.withColumn("_g", F.pmod(F.xxhash64(F.lit(seed + t), "id"), F.lit(groups))).repartition("_g")
        parts.append(near_by_block(dealt, dealt.withColumnRenamed("id", "query_id"), pool, metric, F.col("_g"), skip_self=True))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance").withColumn("fresh", F.lit(True))


def _best(edges: DataFrame, pool: int) -> DataFrame:
    """Each pair once, an edge that was there before not as a fresh one; the nearest of each node."""
    once = edges.groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return once.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= pool).select("src", "dst", "distance", "fresh", "pos")


def _sampled(nodes: DataFrame, seed: int) -> DataFrame:
    return nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE)


def _leaves(nodes: DataFrame, n: int, sample: np.ndarray, metric: str, times: int, seed: int) -> DataFrame:
    """node and id of each node's leaves, one of each deal: the sides of planes that it is on, of which each cuts the sample in two."""
    depth = max(0, min(20, (n // LEAF).bit_length() - 1))
    draw = np.random.default_rng(seed)
    one, other = (sample[draw.integers(len(sample), size=times * depth)] for _ in range(2))
    normals = one - other + 1e-9 * draw.normal(size=one.shape)
    cuts = np.median(sample @ normals.T, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _directions(matrix(batch.column(1)).astype(float), metric)
            sides = (x @ normals.T > cuts).reshape(len(x), times, depth)
            leaf = (np.arange(times) << depth) + (sides << np.arange(depth)).sum(2)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), times))], names=["leaf", "id"])

    dealt = nodes.select("id", "vector").mapInArrow(run, "leaf long, id long")
    sizes = dealt.groupBy("leaf").agg(F.count("*").alias("n"))
    parts = F.when(F.col("n") > 2 * LEAF, F.ceil(F.col("n") / LEAF)).otherwise(1)
    return dealt.join(sizes, "leaf").select((F.col("leaf") * (1 << 24) + F.pmod(F.xxhash64(F.lit(seed), "id"), parts)).alias("node"), "id")


def _directions(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x


def _compared(metric: str, pool: int):
    """(src, dst, distance) of the pairs of each node's neighbours that one fresh edge or more brings together and that are nearer than an end's farthest."""

    def pairs(node: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
        ids, fresh, far, last = (node.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 4, 5))
        x = matrix(node.column(3)).astype(float)
        if fresh.all():
            a, b, d = candidates(metric, x, x, far, pool, 6, (ids, ids))
        else:
            table = np.round(distances(metric, x, x), 6) + 0.0
            a, b = np.nonzero((fresh[:, None] | fresh[None]) & (ids[:, None] != ids[None]) & (table <= far[:, None]))
            d = table[a, b]
        good = (d < far[a]) | ((d == far[a]) & (ids[b] < last[a]))
        return [ids[a[good]], ids[b[good]], d[good]]

    def batch_of(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(3)], names=["src", "dst", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the rows of the last node so far
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]).combine_chunks() if kept is not None else table
            batch = table.to_batches()[0]
            node = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist()]
            parts = [pairs(batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
            if parts:
                yield batch_of(parts)
            kept = pa.Table.from_batches([batch.slice(cuts[-1])])
        if kept is not None and kept.num_rows:
            yield batch_of([pairs(kept.to_batches()[0])])

    return run


def knn_graph(items: DataFrame, k: int, metric: str = "cosine", pool: int | None = None, most_rounds: int = 12, stop: float = 0.001, starts: int = 2, seed: int = 7, wanted: float = 0.93) -> tuple[DataFrame, list[dict]]:
    """Edges (layer, src, pos, dst, distance) to about k nearest others of each item (id, vector), and of each round the rows of neighbours, compared pairs that went on, changed edges, and the share of the sample's neighbours that edges hold, where it was counted.

    pool: edges held in the rounds, twice k or more; vectors without structure need more. stop: the share of edges that changes in the last round
    before the sample is looked at, which is after most_rounds at the latest. wanted: the share of its neighbours to be found.
    """
    pool = max(2 * k, 20) if pool is None else pool
    if k < 1 or pool < k or not 0 <= wanted < 1:
        raise ValueError("k must be 1 or more, pool k or more, wanted below 1")
    scratch = Scratch(items.sparkSession)
    nodes = scratch.put(items.where("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vector").dropDuplicates(["id"]))
    n = nodes.count()
    edges = scratch.put(_best(_start(nodes, n, pool, metric, starts, seed), pool))
    history, truth, sample, deal, dealt = [], None, None, False, False
    for number in count():
        if deal:
            around = _leaves(nodes, n, sample, metric, max(1, min(DEALS, 2 * pool, n // (2 * LEAF))), seed + number).withColumn("fresh", F.lit(True))
        else:
            order = Window.partitionBy("dst").orderBy(F.desc("fresh"), F.xxhash64(F.lit(number), "src"))
            reverse = edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= pool).select(F.col("dst").alias("node"), F.col("src").alias("id"), "fresh")
            around = edges.select(F.col("src").alias("node"), F.col("dst").alias("id"), "fresh").union(reverse).groupBy("node", "id").agg(F.max("fresh").alias("fresh"))
        farthest = edges.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= pool, F.max(F.struct("distance", "dst"))).alias("far"))
        known = nodes.join(farthest, "id", "left").select("id", "vector", F.coalesce("far.distance", F.lit(float("inf"))).alias("far"), F.coalesce("far.dst", F.lit(0)).alias("last"))
        around = scratch.put(around)
        near = around.join(known, "id").select("node", "id", "fresh", "vector", "far", "last").repartition("node").sortWithinPartitions("node")
        found = scratch.put(near.mapInArrow(_compared(metric, pool), "src long, dst long, distance double").groupBy("src", "dst").agg(F.min("distance").alias("distance")))
        merged = scratch.put(_best(edges.select("src", "dst", "distance", F.lit(False).alias("fresh")).union(found.withColumn("fresh", F.lit(True))), pool))
        changed = merged.where("fresh").count()
        history.append({"round": number, "neighbours": around.count(), "found": found.count(), "changed": changed})
        scratch.drop(edges, found, around)
        edges = merged
        few = changed <= stop * pool * n
        if not (few or dealt or deal or number + 1 >= most_rounds):
            continue
        if truth is None:
            asked = scratch.put(_sampled(nodes, seed))
            truth = scratch.put(knn(nodes, asked.withColumnRenamed("id", "query_id"), k, metric, skip_self=True).select(F.col("query_id").alias("src"), F.col("id").alias("dst")))
        hits = truth.join(edges.where(F.col("pos") <= k).select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
        r = hits.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
        history[-1]["recall"] = r["hits"] / r["n"] if r["n"] else 1.0
        if history[-1]["recall"] >= wanted:
            break
        if sample is None:
            sample = _directions(np.array([r["vector"] for r in asked.select("vector").collect()], float), metric)  # SAMPLE rows
        deal, dealt = few or not deal, True
    out = edges.where(F.col("pos") <= k).select(F.lit(0).cast("long").alias("layer"), "src", F.col("pos").cast("long").alias("pos"), "dst", "distance")
    scratch.clear(edges)
    return out, history
