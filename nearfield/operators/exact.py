"""Exact nearest neighbours: a set of queries against all items, in blocks.

Items and queries are packed into blocks of vectors; each pair of blocks is one matrix product in a
task, which keeps each query's k nearest of all its blocks and passes these on. A window merges them. Predicates are
columns, evaluated by Spark before vectors are packed, so they reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import Metric, rounded

ITEM_BLOCK = 4096
QUERY_BLOCK = 1024
#: Query blocks are broadcast up to so many bytes; beyond, Spark pairs the blocks without broadcasting.
MOST_BROADCAST = 64 << 20
#: Neighbours that a task holds, of 16 bytes each; beyond, it passes them on and begins anew.
MOST_HELD = 1 << 22
#: Rows of items and of queries in a task, where neither side is broadcast.
ITEM_PART, QUERY_PART = 1 << 16, 1 << 14
#: Queries whose products with a block of items are made and looked through at a time, so that these stay in the cache.
TILE = 256


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of all queries (rows) to all items, in double precision."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    if metric == "l2sq":
        out = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T)
        return np.maximum(out, 0)
    if metric == "l1":
        return np.stack([np.abs(x - v).sum(1) for v in q]) if len(q) else np.zeros((0, len(x)))
    dot = q @ x.T
    if metric == "inner_product":
        return -dot
    if metric == "cosine_units":
        return 1 - dot
    norms = np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)[None])
    return np.where(norms == 0, 1.0, 1 - dot / np.where(norms == 0, 1, norms))


def apart(metric: str, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distances of each row to the same row of the other, in double precision."""
    s, t = s.astype(np.float64), t.astype(np.float64)
    if metric == "l2sq":
        return ((s - t) ** 2).sum(1)
    if metric == "l1":
        return np.abs(s - t).sum(1)
    dot = np.einsum("ij,ij->i", s, t)
    if metric == "cosine":
        norms = np.sqrt(np.einsum("ij,ij->i", s, s) * np.einsum("ij,ij->i", t, t))
        dot = np.where(norms == 0, 0.0, dot / np.where(norms == 0, 1, norms))
    return -dot if metric == "inner_product" else 1 - dot


def matrix(vectors: pa.Array, dim: int | None = None) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any() or np.isnan(flat.astype(float)).any():
        raise ValueError("vectors differ in length or have missing components")
    return flat.reshape(len(sizes), -1).astype(np.float32 if flat.dtype == np.float32 else np.float64)


def _packed(rows: int, single: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(2)
            names = group.to_pylist() if group.null_count < len(group) else []
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                for first in range(begin, end, rows):
                    part = batch.slice(first, min(rows, end - first))
                    x = matrix(part.column(1)).astype(np.float32 if single and part.column(1).type.value_type == pa.float32() else np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), part.column(2).slice(0, 1)], names=["dim", "ids", "vectors", "g"])

    return run


def packed(rows: DataFrame, rows_a_block: int, grouped: bool = False, single: bool = False) -> DataFrame:
    """Blocks of (dim, ids, vectors, g), each of one group, of rows (id, vector, group as string); rows without id or vector are left out.

    single: floats stay floats; else vectors are doubles.
    """
    rows = rows.toDF("id", "vector", "g").where("id IS NOT NULL AND vector IS NOT NULL")
    return (rows.sortWithinPartitions("g") if grouped else rows).mapInArrow(_packed(rows_a_block, single), "dim int, ids binary, vectors binary, g string")


class Best:
    """The k nearest so far of each query that a task meets; what is nearer than the k-th is put off and merged now and then."""

    def __init__(self, k: int):
        self.k = k
        self.clear()

    def clear(self) -> None:
        self.ids, self.slots, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # ids in order, and their rows of the tables below
        self.distances, self.items = np.zeros((0, self.k)), np.zeros((0, self.k), np.int64)
        self.waiting, self.n_waiting = [], 0

    def slots_of(self, queries: np.ndarray) -> np.ndarray:
        fresh = np.setdiff1d(queries, self.ids)
        if len(fresh):
            if self.n + len(fresh) > len(self.distances):
                more = max(self.n, len(fresh))
                self.distances = np.concatenate([self.distances[: self.n], np.full((more, self.k), np.inf)])
                self.items = np.concatenate([self.items[: self.n], np.zeros((more, self.k), np.int64)])
            at = np.searchsorted(self.ids, fresh)
            self.ids, self.slots = np.insert(self.ids, at, fresh), np.insert(self.slots, at, np.arange(self.n, self.n + len(fresh)))
            self.n += len(fresh)
        return self.slots[np.searchsorted(self.ids, queries)]

    def add(self, slots: np.ndarray, distances: np.ndarray, items: np.ndarray) -> None:
        self.waiting.append((slots, distances, items))
        self.n_waiting += len(slots)
        if 2 * self.n_waiting >= self.n * self.k:
            self.merge()

    def merge(self) -> None:
        if not self.n_waiting:
            return
        slots, distances, items = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        rows = np.unique(slots)
        slots = np.concatenate([np.repeat(rows, self.k), slots])
        distances, items = np.concatenate([self.distances[rows].ravel(), distances]), np.concatenate([self.items[rows].ravel(), items])
        order = np.lexsort((items, distances, slots))
        slots, distances, items = slots[order], distances[order], items[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        kept = place < self.k
        self.distances[slots[kept], place[kept]], self.items[slots[kept], place[kept]] = distances[kept], items[kept]
        self.waiting, self.n_waiting = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        """query_id, id and distance of all that is held; then nothing is held."""
        self.merge()
        for first in range(0, self.n, QUERY_BLOCK):
            part = slice(first, min(self.n, first + QUERY_BLOCK))
            row, place = np.nonzero(np.isfinite(self.distances[self.slots[part]]))
            at = self.slots[part][row]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[part][row]), pa.array(self.items[at, place]), pa.array(self.distances[at, place])], names=["query_id", "id", "distance"])
        self.clear()


def _likeness(metric: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in single precision whose products rank neighbours, and the lengths that bound the products' errors."""
    norms = np.sqrt((x * x).sum(1))
    if metric == "cosine":
        return (x / np.where(norms == 0, 1, norms)[:, None]).astype(np.float32), (norms > 0).astype(float)
    return x.astype(np.float32), norms


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    """The k-th least of each row; infinite where there are fewer."""
    return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def _true(cells: np.ndarray) -> np.ndarray:
    """Places of the few true cells, eight of which are looked at as one."""
    cells = cells.ravel()
    whole = cells.size & ~7
    places = (np.flatnonzero(cells[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([places[cells[places]], whole + np.flatnonzero(cells[whole:])])


def candidates(metric: str, q: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int, digits: int, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and rounded distances of pairs among which are each query's k nearest that are as near as its bound.

    Products in single precision tell pairs that may be near enough, by a margin of more than their error; distances are those of
    double precision. same: ids of queries and items, of which equal ones are no pairs.
    """
    (u, a), (w, b) = _likeness(metric, q), _likeness(metric, x)
    longest = b.max(initial=0)
    scale = (a + longest) ** 2 if metric == "l2sq" else a * longest
    known = metric in ("cosine", "cosine_units", "inner_product", "l2sq") and np.isfinite(scale).all() and scale.max(initial=0) < 1e30
    margin = (x.shape[1] + 8) * 2.0**-22 * scale + 10.0**-digits if known else np.zeros(len(q))
    start, factor = {"l2sq": (a * a, 2.0), "inner_product": (0.0, 1.0)}.get(metric, (1.0, 1.0)) if known else (0.0, 1.0)
    cut, away, half = (bound - start) / factor + margin, -u, (b * b / 2).astype(np.float32)
    hits = []
    for first in range(0, len(q), TILE):
        part = slice(first, first + TILE)
        if known:
            near = away[part] @ w.T
            if metric == "l2sq":
                near += half
        else:
            near = np.round(distances(metric, q[part], x), digits) + 0.0
            near[np.isnan(near)] = np.inf
        limit = cut[part]
        if (open_ := np.flatnonzero(np.isinf(bound[part]))).size:
            if same is not None and (own := open_[np.isin(same[0][part][open_], same[1])]).size:
                some = near[own]
                some[same[0][part][own, None] == same[1][None]] = np.inf
                near[own] = some
            limit[open_] = _kth(near[open_], k) + 2 * margin[part][open_]
        if known:
            limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        row, column = np.divmod(_true(near <= limit[:, None]), max(1, len(x)))
        usable = np.isfinite(near[row, column])
        if same is not None:
            usable &= same[0][part][row] != same[1][column]
        hits.append((row[usable] + first, column[usable], near[row[usable], column[usable]]))
    row, column, near = (np.concatenate(h) for h in zip(*hits, strict=True)) if hits else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    if not known:
        return row, column, near
    found = np.empty(len(row))
    for first in range(0, len(row), 1 << 16):
        part = slice(first, first + (1 << 16))
        found[part] = apart(metric, q[row[part]], x[column[part]])
    return row, column, np.round(found, digits) + 0.0


def values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binaries, and where each value begins and the last one ends."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1]


def runs(columns: list[pa.Array], n: int) -> list[tuple[int, int]]:
    """First and last of the rows (one after it) that have the same in these columns, one after another."""
    new = np.ones(n, bool)
    for i in range(1, n):
        new[i] = False
        for data, at in columns:
            if at[i + 1] - at[i] != at[i] - at[i - 1] or not np.array_equal(data[at[i] : at[i + 1]], data[at[i - 1] : at[i]]):
                new[i] = True
                break
    firsts = np.flatnonzero(new).tolist()
    return list(zip(firsts, [*firsts[1:], n], strict=True))


def _floats(data: np.ndarray, n: int, dim: int) -> np.ndarray:
    """n vectors in the precision that they were packed in."""
    return data.view(np.float64 if data.size == 8 * n * dim else np.float32).reshape(n, dim)


def _nearest(metric: str, k: int, digits: int, skip_self: bool):
    """Of pairs of blocks each query's k nearest in all that a task has of one group, as far as MOST_HELD allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, group = Best(k), None
        for batch in batches:
            cell = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            if not (cell["dim"].equals(cell["q_dim"])):
                raise ValueError("vectors differ in length")
            dims = cell["dim"].to_numpy()
            names = cell["g"].to_pylist() if "g" in cell else None
            ids, vectors, q_ids, q_vectors = (values(cell[n]) for n in ("ids", "vectors", "q_ids", "q_vectors"))
            for begin, end in runs([ids, vectors], batch.num_rows):
                dim = int(dims[begin])
                own = ids[0][ids[1][begin] : ids[1][begin + 1]].view(np.int64)
                x = _floats(vectors[0][vectors[1][begin] : vectors[1][begin + 1]], len(own), dim).astype(float)
                queries = q_ids[0][q_ids[1][begin] : q_ids[1][end]].view(np.int64)
                q = _floats(q_vectors[0][q_vectors[1][begin] : q_vectors[1][end]], len(queries), dim)
                if (names and names[begin] != group) or best.n * k > MOST_HELD:
                    yield from best.rows()
                    group = names[begin] if names else None
                for first in range(0, len(queries), QUERY_BLOCK):
                    part = queries[first : first + QUERY_BLOCK]
                    slots = best.slots_of(part)
                    row, column, d = candidates(metric, q[first : first + QUERY_BLOCK].astype(float), x, best.distances[slots, k - 1], k, digits, (part, own) if skip_self else None)
                    best.add(slots[row], d, own[column])
        yield from best.rows()

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance and rank of the k nearest of each query, equal distances by id."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def near_by_block(items: DataFrame, queries: DataFrame, k: int, metric: str, group: Column | None = None, same: bool = True, skip_self: bool = False, digits: int = 6, item_group: Column | None = None, watch: Observation | str | None = None) -> DataFrame:
    """query_id, id and distance of each query's k nearest in every block of items of one group.

    With `same`, queries meet the items of their group alone: blocks are joined on it, so other groups' blocks aren't
    touched. Query blocks are broadcast only if they are few and small. watch: see `watched`.
    """
    none = F.lit(None).cast("string")
    own = none if group is None else group.cast("string")
    n, dim = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    single = dict(items.dtypes)["vector"] == dict(queries.dtypes)["vector"] == "array<float>"
    joined = group is not None and same
    few = n * (8 * (dim or 0) + 16) <= MOST_BROADCAST and (joined or items.isStreaming or n <= QUERY_PART)
    asked = queries.select(F.col("query_id").cast("long"), "vector", own if joined else none)
    rows = items.select(F.col("id").cast("long"), "vector", own if item_group is None else item_group.cast("string"))
    if few or joined or items.isStreaming:
        asked = asked.coalesce(max(1, -(-n // QUERY_BLOCK)))
    else:  # parts of a size, so that tasks are alike and pass on k rows a query and part of items, not a block
        m, parts = items.count(), -(-n // QUERY_PART)
        asked = asked.repartition(parts)
        rows = rows.repartition(max(1, -(-m // ITEM_PART), min(-(-m // ITEM_BLOCK), -(-2 * items.sparkSession.sparkContext.defaultParallelism // parts))))
    blocks = packed(rows, ITEM_BLOCK, group is not None or item_group is not None, single)
    asked = packed(asked, QUERY_BLOCK, joined, single).toDF("q_dim", "q_ids", "q_vectors", "g")
    asked = F.broadcast(asked) if few else asked if joined or items.isStreaming else asked.hint("shuffle_replicate_nl")
    pairs = blocks.join(asked, "g") if joined else blocks.crossJoin(asked.drop("g"))
    return watched(pairs, watch).mapInArrow(_nearest(metric, k, digits, skip_self), "query_id long, id long, distance double")


def watched(pairs: DataFrame, watch: Observation | str | None) -> DataFrame:
    """Pairs of blocks that count themselves as they pass, if somebody listens: block_pairs, and distances, of an item and a query.

    watch: an Observation of one search, or the name of the metrics in a stream's progress. Without it nothing is added to the plan.
    """
    if watch is None:
        return pairs
    n = F.length("ids").cast("long") * F.length("q_ids") / 64  # of eight bytes an id
    return pairs.observe(watch, F.count(F.lit(1)).alias("block_pairs"), F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("distances"))


def knn(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", where: Column | str | None = None, same: str | None = None, skip_self: bool = False, digits: int = 6, watch: Observation | str | None = None) -> DataFrame:
    """query_id, id, distance and rank of the k nearest items (id, vector, ...) of each query (query_id, vector, ...).

    where: a condition on items. watch: see `watched`. same: a column that items and query must share; a null matches nothing. Distances are
    rounded before ranking. Rows without id or vector neither ask nor are found. Fewer than k rows where fewer items pass; none for an empty table; vectors of zeros have cosine distance 1.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    if where is not None:
        items = items.where(where)
    if same:
        items, queries = items.where(F.col(same).isNotNull()), queries.where(F.col(same).isNotNull())
    return ranked(near_by_block(items, queries, k, metric, F.col(same) if same else None, skip_self=skip_self, digits=digits, watch=watch), k)


def knn_by(items: DataFrame, queries: DataFrame, k: int, metric: Metric, where: Column | str | None = None) -> DataFrame:
    """Like `knn` with any expression of two vectors as metric; for metrics that aren't built in. where may name columns of both sides."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    pairs = items.withColumnRenamed("vector", "_item").join(queries.withColumnRenamed("vector", "_query"), F.expr(where) if isinstance(where, str) else F.lit(True) if where is None else where)
    return ranked(pairs.select("query_id", "id", rounded(metric(F.col("_query"), F.col("_item"))).alias("distance")), k)


def post_filtered(found: DataFrame, condition: Column | str) -> DataFrame:
    """Neighbours that pass a condition after the search: often fewer than k."""
    return found.where(condition)


def best(found: DataFrame) -> DataFrame:
    """The nearest neighbour of each query."""
    return found.groupBy("query_id").agg(F.min(F.struct("distance", "id")).alias("b")).select("query_id", F.col("b.id").alias("id"), F.col("b.distance").alias("distance"))


def get_item(items: DataFrame, item_id: int) -> DataFrame:
    return items.where(F.col("id") == item_id)


def list_items(items: DataFrame) -> DataFrame:
    return items.orderBy("id")
