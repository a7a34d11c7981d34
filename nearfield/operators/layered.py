"""Layered proximity graphs, built and searched as Spark jobs over tables of nodes, edges and vectors.

A node's top layer is drawn from its id; the top of the graph is the highest layer that two nodes reach. In every layer the candidates of a node are its near neighbours among the layer's nodes (all pairs in blocks
up to `MOST_EXACT` nodes, or of any number if `exact` is asked for, else beyond by `descent`); a heuristic picks the links, links are made both ways, and each node is cut to its degree
by the heuristic again. `add` takes a batch: its nodes find candidates in the graph by the search below, all at once, and among themselves;
of the graph only nodes that gain links are cut anew.

A search walks all queries at once. In the layers above the lowest it goes to the nearest node; in the lowest it keeps a beam:
each round joins the unexpanded nodes that are nearer than a query's `ef`-th best with the lists of links, drops what is in the beam, joins the vectors as bytes, computes distances in
Arrow batches and keeps what is still in the beam, until no query has anything to expand. So a round is a join of frontier, edges and items, and the rounds are about as
many as there are hops. A search without a width, or whose beam holds all nodes, visits what can be reached whatever the query is, so that is walked once, along links in both directions. Under a filter nodes that fail are walked but not found; an index that is made for filtering
looks through them instead, at neighbours of neighbours that pass.

Defined results: rows without id or vector aren't indexed; of repeated ids one row counts; equal distances rank by id; an empty table has an index
without nodes and no results; what can't be reached isn't found.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import METRICS, rounded
from nearfield.plans.params import MOST_LEVEL, IndexParams

from . import commits, descent
from .exact import MOST_BROADCAST, apart, distances, knn, matrix, ranked, values
from .graph import drawn, reachable
from .storage import Scratch, durable

FORMAT = 4
#: Nodes of a layer up to which all pairs are compared: in blocks that is less work than rounds of `descent`, which shuffle a hundred vectors a node each.
MOST_EXACT = 1 << 20
#: Beams that are at least so wide are held against the number of nodes.
WIDE = 4096
EDGE = "layer long, src long, pos long, dst long, distance double"
#: Nodes of a new node's beam that a round opens: with many at once most of them turn out not to be near.
OPENED = 16
#: Components of vectors that the heuristic looks at at a time.
MOST_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Layered:
    """items (id, vector, ...), nodes (id, level), edges (EDGE) and the entry, as they were when built or loaded."""

    spark: SparkSession
    items: DataFrame
    nodes: DataFrame
    edges: DataFrame
    entry: int | None
    top: int
    params: IndexParams
    base: tuple[str, int] | None = None  # the folder and version that it was loaded from


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each value of the first column, which they are sorted by."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept is not None:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
        kept = batch.slice(cuts[-1])
    if kept is not None:
        yield kept


def diverse(d: np.ndarray, between: np.ndarray, cap: int, keep_pruned: bool) -> np.ndarray:
    """Places of links by node, -1 where there are no more: of its candidates (a row of d, in order of their distances, infinite after the last) those nearer to it than to any that was kept before; then the nearest of the others, if they are to fill up.

    between: distances of the candidates of each node, a matrix a node.
    """
    n, most = d.shape
    kept, some, taken = np.zeros((n, most), bool), np.isfinite(d), np.zeros(n, np.int64)
    for i in range(most):
        kept[:, i] = some[:, i] & (taken < cap) & ~(kept[:, :i] & (between[:, i, :i] < d[:, i, None])).any(1)
        taken += kept[:, i]
    order = np.argsort(np.where(kept, 0, np.where(some & keep_pruned, 1, 2)), axis=1, kind="stable")[:, :cap]
    return np.where(np.take_along_axis(kept | (some & keep_pruned), order, 1), order, -1)


def compressed(ids: list[int], around: list[list[int]], cap: int, mb: int) -> list[int]:
    """The `mb` nearest, then those that no neighbour list of one kept after them covers, until kept and covered ones are as many as the cap."""
    kept, covered = list(range(min(mb, len(ids)))), set()
    for i in range(mb, len(ids)):
        if len(kept) + len(covered) >= cap:
            break
        if ids[i] not in covered:
            kept.append(i)
            covered.update(around[i])
    return kept[:cap]


def _links(src: np.ndarray, pos: np.ndarray, dst: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(pos), pa.array(dst), pa.array(distance)], names=["src", "pos", "dst", "distance"])


def _covering(params: IndexParams, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in groups(batches):
            ids, d = node.column(1).to_numpy(), node.column(2).to_numpy()
            order = compressed(ids.tolist(), [x or [] for x in node.column(3).to_pylist()], cap, params.mb)
            yield _links(np.full(len(order), node.column(0)[0].as_py()), np.arange(1, len(order) + 1), ids[order], d[order])

    return run


def _picked(params: IndexParams, cap: int, kind: type):
    """Links of nodes by `diverse`, many nodes at a time: their candidates are padded to the most that one of them has."""

    def some(batch: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        src, ids, d = (batch.column(i).to_numpy()[cuts[0] : cuts[-1]] for i in range(3))
        x = floats(batch.column(3).slice(cuts[0], cuts[-1] - cuts[0]), kind)
        node, place = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), np.arange(len(src)) - np.repeat(cuts[:-1] - cuts[0], np.diff(cuts))
        shape = len(cuts) - 1, place.max() + 1
        vectors, apart_, at = np.zeros((*shape, x.shape[1])), np.full(shape, np.inf), np.zeros(shape, np.int64)
        vectors[node, place], apart_[node, place], at[node, place] = x, d, np.arange(len(src))
        between = np.round(_among(params.metric, vectors), 6)
        order = diverse(apart_, between, cap, params.keep_pruned)
        row, pos = np.nonzero(order >= 0)
        rows = at[row, order[row, pos]]
        return _links(src[rows], pos + 1, ids[rows], d[rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the rows of the last node so far
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy()
            cuts = np.array([0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)])
            yield from parts(batch, cuts[:-1])
            left = batch.slice(cuts[-2])
        if left is not None:
            yield from parts(left, np.array([0, left.num_rows]))

    def parts(batch: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(cuts) > 1:
            most = np.diff(cuts).max()
            step = max(1, MOST_AT_ONCE // int(most * max(most, values(batch.column(3))[1][1] - values(batch.column(3))[1][0])))
            for first in range(0, len(cuts) - 1, step):
                yield some(batch, cuts[first : first + step + 1])

    return run


def _among(metric: str, x: np.ndarray) -> np.ndarray:
    """Distances of all pairs of each matrix, as `distances` gives them of one."""
    if metric == "l1":
        return np.stack([distances(metric, m, m) for m in x])
    dot = x @ x.transpose(0, 2, 1)
    if metric == "inner_product":
        return -dot
    if metric == "cosine_units":
        return 1 - dot
    own = np.einsum("ijk,ijk->ij", x, x)
    if metric == "l2sq":
        return np.maximum(own[:, :, None] + own[:, None] - 2 * dot, 0)
    norms = np.sqrt(own[:, :, None] * own[:, None])
    return np.where(norms == 0, 1.0, 1 - dot / np.where(norms == 0, 1, norms))


def kind_of(rows: DataFrame) -> type:
    """In what precision `in_bytes` has vectors."""
    return np.float32 if dict(rows.dtypes)["vector"] == "array<float>" else np.float64


def in_bytes(rows: DataFrame, name: str) -> DataFrame:
    """(id, name): vectors of rows as the bytes of their components, which Spark passes to tasks and back as they are."""
    kind, old = kind_of(rows), rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ascontiguousarray(matrix(batch.column(1)).astype(kind))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.itemsize * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])], names=[old, name])

    return rows.where("vector IS NOT NULL").select(F.col(old).cast("long").alias(old), "vector").mapInArrow(run, f"{old} long, {name} binary")


def floats(column: pa.Array, kind: type) -> np.ndarray:
    """Vectors that `in_bytes` has packed."""
    data, at = values(column)
    if (np.diff(at) != at[1] - at[0]).any():
        raise ValueError("vectors differ in length")
    return data[at[0] : at[-1]].view(kind).reshape(len(column), -1)


def select(candidates: DataFrame, items: DataFrame, cap: int, params: IndexParams, layer: int = 0, edges: DataFrame | None = None) -> DataFrame:
    """(src, pos, dst, distance): the links of each node among its candidates (src, dst, distance), by the heuristic of the parameters.

    At most `ef_construction` candidates of a node are looked at, the nearest. expand_best adds the neighbours of candidates that `edges` (or else the candidates) have.
    """
    once = candidates.where("src <> dst").groupBy("src", "dst").agg(F.min("distance").alias("distance"))
    known = edges if edges is not None else _nearest(once, params.m)
    if params.expand_best and params.heuristic != "simple":
        further = once.select("src", F.col("dst").alias("mid")).join(known.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").where("src <> dst").distinct()
        fresh = further.join(once, ["src", "dst"], "left_anti")
        once = once.union(_apart(fresh, items, params.metric))
    compress = params.optimize_for_filtering and params.gamma > 1 and layer == 0
    if not compress and params.heuristic in ("simple", "first"):
        return _nearest(once, cap if params.heuristic == "simple" or params.keep_pruned else 1)
    near = _nearest(once, max(cap, params.ef_construction))
    if compress:
        around = known.groupBy(F.col("src").alias("dst")).agg(F.collect_list("dst").alias("more"))  # a node's degree is bounded
        rows = near.join(around, "dst", "left").select("src", "dst", "distance", "more")
    else:
        rows = near.join(in_bytes(items.select(F.col("id").alias("dst"), "vector"), "v"), "dst").select("src", "dst", "distance", "v")
    dealt = rows.repartition("src").sortWithinPartitions("src", "distance", "dst")
    return dealt.mapInArrow(_covering(params, cap) if compress else _picked(params, cap, kind_of(items)), "src long, pos long, dst long, distance double")


def _nearest(pairs: DataFrame, cap: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return pairs.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= cap).select("src", "pos", "dst", "distance")


def _apart(pairs: DataFrame, items: DataFrame, metric: str) -> DataFrame:
    """(src, dst, distance) of pairs of nodes."""
    both = pairs.join(items.select(F.col("id").alias("src"), F.col("vector").alias("_u")), "src").join(items.select(F.col("id").alias("dst"), F.col("vector").alias("_v")), "dst")
    return both.select("src", "dst", rounded(METRICS[metric](F.col("_u"), F.col("_v"))).alias("distance"))


def _near(nodes: DataFrame, n: int, k: int, metric: str, exact: bool = False) -> DataFrame:
    """(src, dst, distance) of each node's near others."""
    if exact or n <= MOST_EXACT:
        found = knn(nodes, nodes.withColumnRenamed("id", "query_id"), k, metric, skip_self=True)
        return found.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance")
    return descent.knn_graph(nodes, k, metric, pool=k)[0].select("src", "dst", "distance")


def empty(spark: SparkSession, params: IndexParams, schema: str = "id long, vector array<float>") -> Layered:
    return Layered(spark, spark.createDataFrame([], schema), spark.createDataFrame([], "id long, level long"), spark.createDataFrame([], EDGE), None, -1, params)


def build(items: DataFrame, params: IndexParams | None = None, progress: Callable[[int, int], None] | None = None, exact: bool = False) -> Layered:
    """An index of items (id, vector, ...). progress(done, all) hears of each layer that is done. exact: all pairs are compared, however many nodes there are."""
    params = params or IndexParams()
    kinds = ", ".join(f"`{f.name}` {'long' if f.name == 'id' else f.dataType.simpleString()}" for f in items.schema)
    return add(empty(items.sparkSession, params, kinds), items, progress, exact)


def add(index: Layered, items: DataFrame, progress: Callable[[int, int], None] | None = None, exact: bool = False) -> Layered:
    """The index with the items that it doesn't have; the one given stays as it is."""
    params, spark, scratch = index.params, index.spark, Scratch(index.spark)
    own = items.where("id IS NOT NULL AND vector IS NOT NULL").withColumn("id", F.col("id").cast("long")).dropDuplicates(["id"])
    fresh = scratch.put(own.join(index.items.select("id"), "id", "left_anti").select(*index.items.columns))
    level = F.least(F.floor(-F.log(drawn(F.col("id"), params.seed)) * params.decay), F.lit(MOST_LEVEL)).cast("long")
    nodes = scratch.put(fresh.select("id", level.alias("level")))
    sizes = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row a level
    if not sizes:
        return index
    everything = durable(index.items.unionByName(fresh))
    all_nodes = durable(index.nodes.union(nodes))
    reach = {r["level"]: r["n"] for r in all_nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row a level
    reach = {layer: sum(c for lv, c in reach.items() if lv >= layer) for layer in range(max(reach) + 1)}
    top = max((layer for layer, n in reach.items() if n > 1), default=0)  # a layer of one node leads nowhere
    most = min(params.ef_construction, max(4 * params.degree(0), 64))
    found = None
    if index.entry is not None:  # the zoom: what each new node sees of the graph, by layer
        found = scratch.put(_zoomed(index, fresh.join(nodes, "id").select(F.col("id").alias("query_id"), "vector", "level"), most))
    layers = []
    for layer in range(top, -1, -1):
        held = index.edges.where(F.col("layer") == layer).select("src", "pos", "dst", "distance")
        opened = layer > index.top  # old nodes of a layer that opens now have no links there either
        n = reach[layer] if opened else sum(c for lv, c in sizes.items() if lv >= layer)
        if n:
            here = (everything if opened else fresh).join((all_nodes if opened else nodes).where(F.col("level") >= layer), "id", "left_semi").select("id", "vector")
            candidates = _near(here, n, most, params.metric, exact) if n > 1 else spark.createDataFrame([], "src long, dst long, distance double")
            if found is not None:
                candidates = candidates.union(found.where(F.col("layer") == layer).select("src", "dst", "distance"))
            cap = params.degree(layer)
            linked = scratch.put(select(candidates, everything, cap, params, layer, held if index.entry is not None else None))
            pairs = linked.select("src", "dst", "distance")
            both = pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).union(held.select("src", "dst", "distance")).distinct()
            changed = pairs.select(F.col("src").alias("n")).union(pairs.select(F.col("dst").alias("n"))).distinct()
            mine = both.join(changed.withColumnRenamed("n", "src"), "src", "left_semi")
            over = mine.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("src")
            cut = select(mine.join(over, "src", "left_semi"), everything, cap, params, layer, held.union(linked))
            rest = mine.join(over, "src", "left_anti")
            held = held.join(changed.withColumnRenamed("n", "src"), "src", "left_anti").union(cut).union(_nearest(rest, cap))
        layers.append(scratch.put(held.select(F.lit(layer).cast("long").alias("layer"), "src", "pos", "dst", "distance")))
        if progress:
            progress(len(layers), top + 1)
    edges = layers[0]
    for part in layers[1:]:
        edges = edges.union(part)
    edges = durable(edges)
    scratch.clear()
    entry = index.entry
    if entry is None or top > index.top:
        entry = all_nodes.where(F.col("level") >= top).agg(F.min("id")).first()[0]
    return Layered(spark, everything, all_nodes, edges, entry, top, params, index.base)


def _zoomed(index: Layered, new: DataFrame, most: int) -> DataFrame:
    """(layer, src, dst, distance): of the graph's nodes those near each new node (query_id, vector, level), in the layers up to its own."""
    scratch, parts = Scratch(index.spark), []
    state, packed = scratch.put(_first(index, new)), _packed(index, new, scratch)
    for layer in range(index.top, -1, -1):
        edges = index.edges.where(F.col("layer") == layer)
        state, _, _ = _beam(index, edges, packed, state, most, None, lambda w: F.when(F.col("level") >= layer, F.lit(w)).otherwise(F.lit(1)), OPENED)  # noqa: B023
        best = ranked(state.select("query_id", "id", "distance"), most).join(new.select("query_id", "level"), "query_id").where(F.col("level") >= layer)
        parts.append(best.select(F.lit(layer).cast("long").alias("layer"), F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance"))
        state = scratch.put(_nearest_of(state))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return durable(out)


def _nearest_of(state: DataFrame) -> DataFrame:
    """Of a layer's beams the nearest node of each, from which the next layer is entered."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return state.withColumn("r", F.row_number().over(order)).where("r = 1").select("query_id", "id", "distance", F.lit(False).alias("expanded"), F.lit(True).alias("ok"))


@dataclass(frozen=True)
class Packed:
    """Vectors of items (id, v) and of queries (query_id, q, and the level if they have it) in bytes, in what precision, and the bytes of all."""

    items: DataFrame
    queries: DataFrame
    kinds: tuple[type, type]
    sizes: tuple[int, int]


def _packed(index: Layered, queries: DataFrame, scratch: Scratch) -> Packed:
    own = index.items.select("id", "vector")
    asked = in_bytes(queries.select("query_id", "vector"), "q")
    if "level" in queries.columns:
        asked = asked.join(queries.select("query_id", "level"), "query_id")
    kinds, counts = (kind_of(own), kind_of(queries)), [x.agg(F.count("*"), F.max(F.size("vector"))).first() for x in (own, queries)]
    return Packed(scratch.put(in_bytes(own, "v")), scratch.put(asked), kinds, tuple(n * (np.dtype(kind).itemsize * (dim or 0) + 16) for (n, dim), kind in zip(counts, kinds, strict=True)))


def _first(index: Layered, queries: DataFrame) -> DataFrame:
    start = index.items.where(F.col("id") == F.lit(index.entry)).select("id", F.col("vector").alias("_v"))  # one row
    d = rounded(METRICS[index.params.metric](F.col("vector"), F.col("_v")))
    return queries.select("query_id", "vector").crossJoin(F.broadcast(start)).select("query_id", "id", d.alias("distance"), F.lit(False).alias("expanded"), F.lit(True).alias("ok"))


def _steps(edges: DataFrame, open_: DataFrame, params: IndexParams, layer: int, through: bool) -> DataFrame:
    """(query_id, id) that the nodes to expand lead to. edges (src, pos, dst, ok); through: look through nodes that fail the filter."""
    direct = open_.select("query_id", F.col("id").alias("src")).join(edges, "src")
    if not through:
        return direct.select("query_id", F.col("dst").alias("id"))
    none = F.lit(0).cast("long").alias("pos2")
    if layer:
        seen, most = direct.where("ok").select("query_id", "src", "pos", none, "dst"), params.m
    else:
        near = direct.where("ok" if params.gamma == 1 else f"ok AND pos <= {params.mb}").select("query_id", "src", "pos", none, "dst")
        via = direct.where("NOT ok" if params.gamma == 1 else f"pos > {params.mb}").select("query_id", F.col("src").alias("_src"), F.col("pos").alias("_pos"), F.col("dst").alias("src"))
        behind = via.join(edges.where("ok"), "src").select("query_id", F.col("_src").alias("src"), F.col("_pos").alias("pos"), F.col("pos").alias("pos2"), "dst")
        seen, most = near.union(behind), 2 * params.m
    order = Window.partitionBy("query_id", "src").orderBy("pos", "pos2", "dst")
    once = seen.groupBy("query_id", "src", "dst").agg(F.min(F.struct("pos", "pos2")).alias("p")).select("query_id", "src", "p.pos", "p.pos2", "dst")
    some = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    stuck = direct.join(some.select("query_id", "src").distinct(), ["query_id", "src"], "left_anti")  # where nothing passes the walk goes on
    return some.select("query_id", F.col("dst").alias("id")).union(stuck.select("query_id", F.col("dst").alias("id")))


def _measured(metric: str, kinds: tuple[type, type]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, q = (floats(batch.column(i), kind) for i, kind in zip((2, 3), kinds, strict=True))
                if q.shape != v.shape:
                    raise ValueError("vectors differ in length")
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.round(apart(metric, q, v), 6) + 0.0)], names=["query_id", "id", "distance"])

    return run


def _held(state: DataFrame, levels: DataFrame | None, width: Column, most_open: int) -> DataFrame:
    """Of visited nodes those as near as a query's width-th that passes (what is farther is never opened again), and whether they are opened next: the nearest that weren't yet."""
    state = state if levels is None else state.join(levels, "query_id")
    passing = Window.partitionBy("query_id", "ok").orderBy("distance", "id")
    waiting = Window.partitionBy("query_id", "expanded").orderBy("distance", "id")
    last = F.max(F.when(F.col("ok") & (F.col("r") == width), F.col("distance"))).over(Window.partitionBy("query_id"))
    near = state.repartition("query_id").withColumn("r", F.row_number().over(passing)).withColumn("bound", last).where("bound IS NULL OR distance <= bound")
    opened = ~F.col("expanded") & (F.row_number().over(waiting) <= most_open)
    return near.withColumn("opened", opened).select("query_id", "id", "distance", "expanded", "ok", "opened")


def _visits(tables: list[DataFrame]) -> DataFrame:
    """How many nodes each query met (query_id, n)."""
    return reduce(DataFrame.union, (t.select("query_id", "id") for t in tables)).distinct().groupBy("query_id").agg(F.count("*").alias("n"))


def _beam(index: Layered, edges: DataFrame, packed: Packed, state: DataFrame, width: int, passing: DataFrame | None, wide=None, most_open: int | None = None, layer: int = 0, most_visited: int | None = None, ends: float | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Where a walk from the nodes of a state (query_id, id, distance, expanded, ok) ends: the nodes of each query's beam, how many it visited (query_id, n), and the rounds that it took.

    A round writes the nodes that it comes to, of those in no beam, and the beams. What fell out of a beam is too far to come back, so a round needn't read all that was visited.
    """
    params, scratch = index.params, Scratch(index.spark)
    most_open = most_open or max(width, 16)
    width_of, levels = (wide(width), packed.queries.select("query_id", "level")) if wide else (F.lit(width), None)
    through = passing is not None and params.optimize_for_filtering
    met = None if passing is None else scratch.put(passing.select("id").distinct().withColumn("p", F.lit(True)))
    if through:
        links = scratch.put(edges.join(met.withColumnRenamed("id", "dst"), "dst", "left").select("src", "pos", "dst", F.coalesce("p", F.lit(False)).alias("ok")))
    else:
        links = scratch.put(edges.groupBy("src").agg(F.collect_list("dst").alias("dsts")))  # a node's degree is bounded
    items, asked = (F.broadcast(x) if size <= MOST_BROADCAST else x for x, size in zip((packed.items, packed.queries.select("query_id", "q")), packed.sizes, strict=True))
    visited, beam, rounds = [scratch.put(state.select("query_id", "id"))], scratch.put(_held(state, levels, width_of, most_open)), 0
    while ends is None or time.monotonic() < ends:
        open_ = beam.where("opened").select("query_id", "id")
        if most_visited is not None:
            open_ = open_.join(_visits(visited).where(F.col("n") < most_visited), "query_id", "left_semi")
        if open_.isEmpty():
            break
        rounds += 1
        steps = _steps(links, open_, params, layer, True) if through else open_.withColumnRenamed("id", "src").join(links, "src").select("query_id", F.explode("dsts").alias("id"))
        new = steps.repartition("query_id").distinct().join(beam.select("query_id", "id"), ["query_id", "id"], "left_anti")
        came = new.join(items, "id").join(asked, "query_id").select("query_id", "id", "v", "q").mapInArrow(_measured(params.metric, packed.kinds), "query_id long, id long, distance double")
        came = scratch.put(came.withColumn("ok", F.lit(True)) if met is None else came.join(met, "id", "left").select("query_id", "id", "distance", F.coalesce("p", F.lit(False)).alias("ok")))
        now = beam.withColumn("expanded", F.col("expanded") | F.col("opened")).select("query_id", "id", "distance", "expanded", "ok")
        before, beam = beam, scratch.put(_held(now.union(came.select("query_id", "id", "distance", F.lit(False).alias("expanded"), "ok")), levels, width_of, most_open))
        scratch.drop(before)
        visited.append(came)
    counts = scratch.put(_visits(visited))
    scratch.clear(beam, counts)
    return beam.drop("opened"), counts, rounds


def search(index: Layered, queries: DataFrame, k: int, ef: int | None = 50, passing: DataFrame | None = None, most_visited: int | None = None, deadline_s: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, distance, rank) of the k nearest found, and of each query visited, the nodes whose distances were computed, and rounds.

    ef: the width of the beam; without it, or if all nodes go into a beam of `WIDE` or more, all that the entry leads to is taken. passing: the ids that a result may have. most_visited and deadline_s end a search early, with the best so far.
    """
    if k < 1 or ef is not None and ef < 1:
        raise ValueError("k and ef must be 1 or more")
    spark, scratch = index.spark, Scratch(index.spark)
    known = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "vector").dropDuplicates(["query_id"])
    if index.entry is None:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank long"), known.select("query_id", F.lit(0).cast("long").alias("visited"), F.lit(0).cast("long").alias("rounds"))
    if ef is None or max(k, ef) >= WIDE:
        n = index.nodes.count()
        if most_visited is None and deadline_s is None and not (passing is not None and index.params.optimize_for_filtering) and (ef is None or max(k, ef) >= n):
            return _all_reached(index, known, k, passing)
        ef = n if ef is None else ef
    ends = None if deadline_s is None else time.monotonic() + deadline_s
    state, packed, total, visited = scratch.put(_first(index, known)), _packed(index, known, scratch), 0, []
    for layer in range(index.top, -1, -1):
        width = max(k, ef) if layer == 0 else 1
        if layer == 0 and passing is not None:  # whether the entry itself passes
            state = scratch.put(state.drop("ok").join(passing.select("id", F.lit(True).alias("p")).dropDuplicates(["id"]), "id", "left").select("query_id", "id", "distance", "expanded", F.coalesce("p", F.lit(False)).alias("ok")))
        edges = index.edges.where(F.col("layer") == layer)
        above = layer > 0 and not index.params.optimize_for_filtering  # plain filters don't steer the way down
        state, counts, rounds = _beam(index, edges, packed, state, width, None if above else passing, layer=layer, most_visited=most_visited, ends=ends)
        total += rounds
        visited.append(counts)
        if layer:
            state = scratch.put(_nearest_of(state))
    stats = reduce(DataFrame.union, visited).groupBy("query_id").agg((F.sum("n") - (len(visited) - 1)).alias("visited")).withColumn("rounds", F.lit(total).cast("long"))  # where a layer ends the next begins
    return ranked(state.where("ok").select("query_id", "id", "distance"), k), stats


def _all_reached(index: Layered, queries: DataFrame, k: int, passing: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """As `search`, by a beam that holds all nodes: what it visits doesn't depend on the query, so one walk finds all that the entry leads to, and all queries are compared with that in blocks.

    The walk takes links in both directions, so it also comes to nodes whose own links stayed while those to them were cut.
    """
    links = index.edges.select("src", "dst")
    walk = durable(reachable(durable(links.union(links.select("dst", "src")).distinct()), index.nodes.where(F.col("id") == F.lit(index.entry)).select("id")))
    visited, rounds = walk.agg(F.count("*"), F.max("depth")).first()
    met = index.items.join(walk.select(F.col("node").alias("id")), "id", "left_semi")
    if passing is not None:
        met = met.join(passing.select("id"), "id", "left_semi")
    return knn(met, queries, k, index.params.metric), queries.select("query_id", F.lit(visited).cast("long").alias("visited"), F.lit(rounds + 1).cast("long").alias("rounds"))


def save(index: Layered, path: str) -> int:
    """Writes the tables as the next version of a folder, and gives its number.

    An index that was loaded from the folder is saved only if no other version came after: else `commits.Conflict`. One from elsewhere replaces what is there.
    """
    name = uuid.uuid4().hex
    for kind in ("items", "nodes", "edges"):
        getattr(index, kind).write.parquet(f"{path}/parts/{name}/{kind}")
    facts = {"entry": index.entry, "top": index.top, "n": index.nodes.count(), "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.items.schema)}

    def change(now: dict) -> dict:
        if index.base and index.base[0] == path and index.base[1] != now["version"]:
            raise commits.Conflict(f"{path} is at version {now['version']}, the index comes from {index.base[1]}")
        return {"add": {name: facts}, "remove": list(now["parts"]), "params": {"format": FORMAT, "graph": index.params.to_json()}}

    return commits.commit(index.spark, path, change)["version"]


def grow(spark: SparkSession, path: str, items: DataFrame, most_tries: int = 20) -> int:
    """Adds the items that a stored index doesn't have, and gives the version that has them all.

    A writer that finds a newer version when it commits adds its items to that one; items that are there already, as of a batch that
    comes again, change nothing. What lost writers wrote goes with `commits.vacuum`.
    """
    for _ in range(most_tries):
        now = load(spark, path)
        more = add(now, items)
        if more is now:
            return now.base[1]
        try:
            return save(more, path)
        except commits.Conflict:
            continue
    raise commits.Conflict(f"{path}: {most_tries} versions were taken by others")


def load(spark: SparkSession, path: str, version: int | None = None, metric: str | None = None) -> Layered:
    """The index as it is now, or was at a version; refuses another format or metric, and tables that lack nodes."""
    state = commits.state(spark, path, version)
    if state["params"].get("format") != FORMAT:
        raise ValueError("not an index of this format")
    params = IndexParams.from_json(state["params"]["graph"])
    if metric and metric != params.metric:
        raise ValueError(f"the index was built for {params.metric}")
    (name, facts), = state["parts"].items()
    read = lambda kind, schema: spark.read.schema(schema).parquet(f"{path}/parts/{name}/{kind}")
    index = Layered(spark, read("items", facts["schema"]), read("nodes", "id long, level long"), read("edges", EDGE), facts["entry"], facts["top"], params, (path, state["version"]))
    if index.nodes.count() != facts["n"]:
        raise ValueError("the index lacks nodes that its version counts")
    return index


def for_width(index: Layered, **changes) -> Layered:
    """The same graph with other parameters of a search."""
    return replace(index, params=replace(index.params, **changes))
