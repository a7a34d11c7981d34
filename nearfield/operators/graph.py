"""Proximity graphs as tables of directed edges (layer, src, pos, dst, distance), and what is done with them.

Defined results: edges with a null end or distance rank last and reach nothing; of equal distances the smaller id
comes first; repeated edges count once where a function says so; empty tables give empty results.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact import knn
from .storage import Scratch, durable


def assign_ids(items: DataFrame, order: str, start: int = 0) -> DataFrame:
    """Adds item_id, dense from start on in the given order; equal values in any order.

    Rows are dealt by ranges once, equal values too, and written with the number of their part, as a second deal may cut the ranges elsewhere;
    counts by part give each its first number, so that no task sees more than its part.
    """
    spark, scratch = items.sparkSession, Scratch(items.sparkSession)
    rows = items.select(F.struct(*(F.col(f"`{c}`") for c in items.columns)).alias("row"), F.col(f"`{order}`").alias("by"), F.monotonically_increasing_id().alias("tie"))
    parts = scratch.put(rows.repartitionByRange("by", "tie").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    firsts, so_far = [], start
    for part in sorted(sizes):
        firsts.append((part, so_far))
        so_far += sizes[part]
    within = Window.partitionBy("part").orderBy("by", "tie")
    numbered = parts.withColumn("n", F.row_number().over(within)).join(F.broadcast(spark.createDataFrame(firsts, "part int, first long")), "part")
    return numbered.select(*(F.col(f"row.`{c}`").alias(c) for c in items.columns), (F.col("first") + F.col("n") - 1).cast("long").alias("item_id"))


def append_ids(numbered: DataFrame | None, batch: DataFrame, order: str) -> DataFrame:
    """The rows of a table with dense item_id from 0 on and those of a batch, which go on where these end. The batch alone is written."""
    start = numbered.count() if numbered is not None else 0
    fresh = durable(assign_ids(batch, order, start))
    return fresh if numbered is None else numbered.unionByName(fresh)


def drawn(item_id: Column, seed: int = 12345) -> Column:
    """A number in (0, 1) from a hash of an id: the draw of its layer."""
    return (((F.pmod(item_id, F.lit(1 << 31)) * 2654435761 + seed) % (1 << 32) + F.lit(0.5)) / float(1 << 32)).cast("double")


def level(item_id: Column, m: int, seed: int = 12345) -> Column:
    """A node's top layer: floor(-ln(u) / ln(m)) of what was drawn for it, at most 31."""
    return F.least(F.floor(-F.log(drawn(item_id, seed)) / F.log(F.lit(float(m)))), F.lit(31)).cast("long")


def entry_point(nodes: DataFrame) -> DataFrame:
    """The node of the highest level, of equal ones the first."""
    return nodes.agg(F.max_by("id", F.struct(F.col("level"), -F.col("id"))).alias("entry_id"), F.max("level").alias("max_level"))


def knn_graph(items: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Each item's k nearest others as edges of layer 0."""
    found = knn(items, items.select(F.col("id").alias("query_id"), "vector"), k, metric, skip_self=True)
    return found.select(F.lit(0).cast("long").alias("layer"), F.col("query_id").alias("src"), F.col("rank").alias("pos"), F.col("id").alias("dst"), "distance")


def nearest_edges(edges: DataFrame, cap: int) -> DataFrame:
    """Of each node's candidate edges the nearest, without loops; positions anew."""
    order = Window.partitionBy("layer", "src").orderBy("distance", "dst")
    return edges.where("src <> dst").withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= cap).select("layer", "src", "pos", "dst", "distance")


def capped(edges: DataFrame, cap: int) -> DataFrame:
    """Edges and their reversals, each once, cut to the nearest of each node."""
    both = edges.select("layer", "src", "dst", "distance").union(edges.select("layer", F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
    return nearest_edges(both.distinct(), cap)


def extended(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates (src, dst) and the neighbours of theirs, each once."""
    further = candidates.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"))
    return candidates.select("src", "dst").union(further).where("src <> dst").distinct()


def two_hop(edges: DataFrame, passing: DataFrame) -> DataFrame:
    """(src, dst) two edges apart, where dst passes: what a search under a filter sees through nodes that fail."""
    step = edges.select(F.col("src").alias("mid"), F.col("dst").alias("last"))
    pairs = edges.select("src", F.col("dst").alias("mid")).join(step, "mid").where("src <> last").select("src", F.col("last").alias("dst")).distinct()
    return pairs.join(passing.select(F.col("id").alias("dst")), "dst", "left_semi")


def reachable(edges: DataFrame, start: DataFrame, most_hops: int | None = None, checkpoint_every: int = 8) -> DataFrame:
    """node and depth of all that can be reached from the start nodes (id), breadth first, or of those within so many hops."""
    scratch = Scratch(edges.sparkSession)
    seen = scratch.put(start.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("depth")))
    frontier, parts = seen, [seen]
    for hop in count(1) if most_hops is None else range(1, most_hops + 1):
        out = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = scratch.put(out.join(seen, "node", "left_anti").select("node", F.lit(hop).cast("long").alias("depth")))
        if frontier.isEmpty():
            scratch.drop(frontier)
            break
        parts.append(frontier)
        seen = seen.union(frontier)
        if hop % checkpoint_every == 0:  # one table instead of those of each hop
            seen = scratch.put(seen)
            scratch.drop(*parts[:-1])
            parts = [seen, frontier]
    return seen


def printed(edges: DataFrame) -> DataFrame:
    """layer, src and line, such as `(3) -> {5, 9}`, with neighbours in order of position."""
    lists = edges.groupBy("layer", "src").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("l"))
    names = F.array_join(F.transform("l", lambda x: x["dst"].cast("string")), ", ")
    return lists.select("layer", "src", F.concat(F.lit("("), F.col("src").cast("string"), F.lit(") -> {"), names, F.lit("}")).alias("line"))


def walked(edges: DataFrame, start: DataFrame, checkpoint_every: int = 8) -> DataFrame:
    """node, depth and path of all that can be reached from the start nodes (id), in each layer that has edges.

    path: the place of the start node, then the positions of the edges by which a walk breadth first comes to the node, so depth and path are the
    order in which its queue holds the nodes.
    """
    scratch = Scratch(edges.sparkSession)
    first = start.select("id").distinct().withColumn("place", F.row_number().over(Window.orderBy("id")))  # of the start nodes alone
    layers = edges.select("layer").distinct()  # about log n / log m of them
    seen = scratch.put(layers.crossJoin(F.broadcast(first)).select("layer", F.col("id").alias("node"), F.lit(0).cast("long").alias("depth"), F.array(F.col("place").cast("long")).alias("path")))
    frontier = seen
    for hop in count(1):
        step = frontier.join(edges.select("layer", F.col("src").alias("node"), "pos", "dst"), ["layer", "node"])
        out = step.groupBy("layer", F.col("dst").alias("node")).agg(F.min(F.array_append("path", F.col("pos").cast("long"))).alias("path"))
        frontier = scratch.put(out.join(seen.select("layer", "node"), ["layer", "node"], "left_anti").select("layer", "node", F.lit(hop).cast("long").alias("depth"), "path"))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
        if hop % checkpoint_every == 0:
            seen = scratch.put(seen)


def printed_reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """layer, depth, path, src and line: for each layer from the top the line `[LEVEL n]`, then the nodes that a walk from the start nodes (id) reaches, in the order of its queue.

    A node without edges of its own in a layer has no line there.
    """
    lines = printed(edges)
    body = walked(edges, start).withColumnRenamed("node", "src").join(lines, ["layer", "src"]).select("layer", "depth", "path", "src", "line")
    heads = edges.select("layer").distinct().select("layer", F.lit(-1).cast("long").alias("depth"), F.array().cast("array<long>").alias("path"), F.lit(None).cast("long").alias("src"), F.concat(F.lit("[LEVEL "), F.col("layer").cast("string"), F.lit("]")).alias("line"))
    return heads.union(body).orderBy(F.col("layer").desc(), "depth", "path")


def layer_of(edges: DataFrame, layer: int) -> DataFrame:
    return edges.where(F.col("layer") == layer)


def to_csr(edges: DataFrame) -> DataFrame:
    """One row for each node and layer: its neighbours as an array in order of position. A node's degree is bounded by the index."""
    lists = F.array_sort(F.collect_list(F.struct("pos", "dst", "distance")))
    return edges.groupBy("layer", "src").agg(lists.alias("neighbours"))


def from_csr(csr: DataFrame) -> DataFrame:
    return csr.select("layer", "src", F.explode("neighbours").alias("n")).select("layer", "src", "n.pos", "n.dst", "n.distance")


def needs_compaction(counts: DataFrame, least_rows: int = 1000, least_share: float = 0.1) -> DataFrame:
    """Whether delta rows exceed both a number and a share of all rows (n_total, n_delta)."""
    return counts.select("*", ((F.col("n_delta") > least_rows) & (F.col("n_delta") > least_share * F.col("n_total"))).alias("needs_compaction"))


def items_not_in_graph(items: DataFrame, nodes: DataFrame) -> DataFrame:
    return items.join(nodes.select("id"), "id", "left_anti")
