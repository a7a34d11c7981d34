"""Exact neighbours under conditions of query and item, and by any metric of two matrices, in blocks.

A condition is an expression of columns of both sides, `query("q_label") < item("label")` for one, joined by `&`, `|` and `~`.
Items and queries are packed into blocks with the columns that it names. A block carries the least and the largest value of each
column and a bitmap of its values' hashes; from these a Spark condition on pairs of blocks tells which can hold
a matching pair at all, so the join leaves the others out. In a task the condition becomes a mask over all pairs of a block of
queries and one of items, and a matrix of distances is ranked under it.

Sorted items make tight bounds: rows are sorted within their partitions by the columns that the condition names, or dealt by ranges of
`cluster_by` first, which is worth its shuffle where conditions are narrow.

Defined results: a comparison with a null matches nothing, nor does its negation, as in SQL; the rest as in `exact.knn`.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact import ITEM_BLOCK, MOST_BROADCAST, MOST_HELD, QUERY_BLOCK, Best, _kth, _true, distances, matrix, ranked

Metric = str | Callable[[np.ndarray, np.ndarray], np.ndarray]
ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "%": np.fmod}  # the sign of a remainder is that of the dividend, as in SQL
#: Types of columns in conditions.
KINDS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "string")
COMPARISONS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


def _bit(value) -> int:
    """Of 64, by the value alone."""
    return zlib.crc32(str(float(value)).encode() if isinstance(value, (int, float, np.number)) else str(value).encode()) % 64


class Expression:
    """A value or a condition; `args` are expressions, but for columns (side, name) and literals."""

    __hash__ = object.__hash__

    def __init__(self, op: str, *args):
        self.op, self.args = op, args

    def __add__(self, other):
        return Expression("+", self, _of(other))

    def __sub__(self, other):
        return Expression("-", self, _of(other))

    def __mul__(self, other):
        return Expression("*", self, _of(other))

    def __mod__(self, other):
        return Expression("%", self, _of(other))

    def __lt__(self, other):
        return Expression("<", self, _of(other))

    def __le__(self, other):
        return Expression("<=", self, _of(other))

    def __gt__(self, other):
        return Expression(">", self, _of(other))

    def __ge__(self, other):
        return Expression(">=", self, _of(other))

    def __eq__(self, other):
        return Expression("==", self, _of(other))

    def __ne__(self, other):
        return Expression("!=", self, _of(other))

    def __and__(self, other):
        return Expression("and", self, other)

    def __or__(self, other):
        return Expression("or", self, other)

    def __invert__(self):
        return Expression("not", self)

    def columns(self) -> set[tuple[str, str]]:
        if self.op == "column":
            return {self.args}
        return set().union(*(a.columns() for a in self.args if isinstance(a, Expression)))

    def value(self, known: dict) -> tuple[np.ndarray, np.ndarray]:
        """Values, and where they aren't null, by columns that are shaped to meet each other."""
        if self.op == "column":
            return known[self.args]
        if self.op == "literal":
            return np.asarray(self.args[0]), np.asarray(self.args[0] is not None)
        (a, x), (b, y) = (e.value(known) for e in self.args)
        return ARITHMETIC[self.op](a, b), x & y

    def holds(self, known: dict) -> tuple[np.ndarray, np.ndarray]:
        """Where the condition is true, and where it is false."""
        if self.op == "not":
            yes, no = self.args[0].holds(known)
            return no, yes
        if self.op in ("and", "or"):
            (a, x), (b, y) = (e.holds(known) for e in self.args)
            return (a & b, x | y) if self.op == "and" else (a | b, x & y)
        (a, x), (b, y) = (e.value(known) for e in self.args)
        yes, sure = COMPARISONS[self.op](a, b), x & y
        return yes & sure, ~yes & sure

    def range(self) -> tuple[Column, Column]:
        """The least and the largest that the value can be in a pair of blocks; null where that isn't known."""
        if self.op == "column":
            return F.col(f"{self.args[0]}_low_{self.args[1]}"), F.col(f"{self.args[0]}_high_{self.args[1]}")
        if self.op == "literal":
            v = self.args[0]
            low, high = _ends(v, v) if isinstance(v, (int, float)) else (None, None)
            return F.lit(low).cast("double"), F.lit(high).cast("double")
        (a, b), (c, d) = (e.range() for e in self.args)
        if self.op == "+":
            return a + c, b + d
        if self.op == "-":
            return a - d, b - c
        if self.op == "*":
            ends = [a * c, a * d, b * c, b * d]
            return F.least(*ends), F.greatest(*ends)
        whole = (a >= 0) & (c == d) & (c > 0)  # remainders of one divisor
        same = F.floor(a / c) == F.floor(b / c)
        return F.when(whole & same, a % c).when(whole, 0.0), F.when(whole & same, b % c).when(whole, c)

    def _bits(self) -> Column | None:
        if self.op == "column":
            return F.col(f"{self.args[0]}_bits_{self.args[1]}")
        return F.lit(_signed(1 << _bit(self.args[0]))) if self.op == "literal" else None

    def possible(self, wanted: bool = True) -> Column:
        """Whether some pair of two blocks can make the condition true (or false)."""
        if self.op == "not":
            return self.args[0].possible(not wanted)
        if self.op in ("and", "or"):
            a, b = (e.possible(wanted) for e in self.args)
            return a & b if (self.op == "and") == wanted else a | b
        op = self.op if wanted else {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}[self.op]
        (a, b), (c, d) = (e.range() for e in self.args)
        known = {"<": a < d, "<=": a <= d, ">": b > c, ">=": b >= c, "==": (a <= d) & (c <= b), "!=": ~((a == b) & (c == d) & (a == c))}[op]
        out = F.coalesce(known, F.lit(True))
        x, y = (e._bits() for e in self.args)
        return out & (x.bitwiseAND(y) != 0) if op == "==" and x is not None and y is not None else out


def _ends(low, high) -> tuple[float, float]:
    """Bounds as doubles, which don't hold every integer beyond 2 ** 53: there a little wider."""
    return tuple(float(x) if abs(x) <= 1 << 53 else float(np.nextafter(float(x), side)) for x, side in ((low, -np.inf), (high, np.inf)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _of(value) -> Expression:
    return value if isinstance(value, Expression) else Expression("literal", value)


def item(name: str) -> Expression:
    return Expression("column", "item", name)


def query(name: str) -> Expression:
    return Expression("column", "query", name)


def _array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, some value where they are null, and where they aren't."""
    known = column.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array([x or "" for x in column.to_pylist()], dtype=str), known
    values = column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False)
    return values.astype(np.float64) if values.dtype.kind == "f" else values, known


def _zone(column: pa.Array) -> tuple[float | None, float | None, int]:
    values, known = _array(column)
    values = values[known]
    numbers = values.dtype.kind in "iufb" and len(values) and not (values.dtype.kind == "f" and np.isnan(values).any())
    bits = 0
    for v in np.unique(values).tolist():
        bits |= 1 << _bit(v)
    return (*_ends(values.min().item(), values.max().item()), _signed(bits)) if numbers else (None, None, _signed(bits))


def _packed(side: str, rows: DataFrame, names: list[str], size: int, most: int = 0) -> DataFrame:
    """Blocks of rows (id, vector, columns): ids, vectors, each column as an array, its bounds and its bitmap.

    most: blocks of `size` rows, one after another, that have the same bounds and bitmaps meet the same blocks, so they become one of up to so many rows.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    if odd := [n for n in names if kinds[n].simpleString() not in KINDS]:
        raise ValueError(f"{', '.join(odd)}: conditions know numbers, strings and booleans; cast it to one of them")
    ends = [f"{side}_{end}_{n}" for n in names for end in ("values", "low", "high", "bits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []  # first row, one after the last, bounds and bitmaps
            for first in range(0, batch.num_rows, size):
                end = min(first + size, batch.num_rows)
                zones = [_zone(column.slice(first, end - first)) for column in batch.columns[2:]]
                if pieces and pieces[-1][2] == zones and end - pieces[-1][0] <= most:
                    pieces[-1] = pieces[-1][0], end, zones
                else:
                    pieces.append((first, end, zones))
            for first, end, zones in pieces:
                part = batch.slice(first, end - first)
                x = matrix(part.column(1)).astype(float)
                out = [pa.array([x.shape[1]], pa.int32()), pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())]
                for column, (low, high, bits) in zip(part.columns[2:], zones, strict=True):
                    out += [pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), pa.array([low], pa.float64()), pa.array([high], pa.float64()), pa.array([bits], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=[f"{side}_dim", f"{side}_ids", f"{side}_vectors", *ends])

    fields = [f"{side}_dim int", f"{side}_ids binary", f"{side}_vectors binary"]
    for n in names:
        fields += [f"`{side}_values_{n}` array<{kinds[n].simpleString()}>", f"`{side}_low_{n}` double", f"`{side}_high_{n}` double", f"`{side}_bits_{n}` long"]
    return rows.mapInArrow(run, ", ".join(fields))


def _blocks(side: str, rows: DataFrame, key: str, condition: Expression | None, size: int, cluster_by: str | None = None, most: int = 0) -> DataFrame:
    names = sorted(n for s, n in condition.columns() if s == side) if condition is not None else []
    rows = rows.where(F.col(key).isNotNull() & F.col("vector").isNotNull()).select(F.col(key).cast("long").alias("_id"), "vector", *names)
    if cluster_by:
        rows = rows.repartitionByRange(cluster_by)
    order = [*([cluster_by] if cluster_by else []), *(n for n in names if n != cluster_by)]
    return _packed(side, rows.sortWithinPartitions(*order, "_id") if order else rows, names, size, most)


def block_pairs(items: DataFrame, queries: DataFrame, where: Expression | None = None, cluster_by: str | None = None, item_block: int = ITEM_BLOCK, query_block: int = QUERY_BLOCK, merged: bool = False) -> tuple[DataFrame, DataFrame, Column]:
    """Blocks of items, blocks of queries, and the condition on which a pair of them can hold a match. merged: see `_packed`."""
    n = queries.count()
    few = queries.coalesce(max(1, -(-n // query_block)))
    most = (ITEM_BLOCK, QUERY_BLOCK) if merged else (0, 0)
    return _blocks("item", items, "id", where, item_block, cluster_by, most[0]), _blocks("query", few, "query_id", where, query_block, most=most[1]), F.lit(True) if where is None else where.possible()


def _nearest(metric: Metric, k: int, digits: int, where: Expression | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            cell = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                dims = cell["item_dim"][r].as_py(), cell["query_dim"][r].as_py()
                if dims[0] != dims[1]:
                    raise ValueError("vectors differ in length")
                ids, queries = (np.frombuffer(cell[n][r].as_py(), np.int64) for n in ("item_ids", "query_ids"))
                x, q = np.frombuffer(cell["item_vectors"][r].as_py()).reshape(len(ids), -1), np.frombuffer(cell["query_vectors"][r].as_py()).reshape(len(queries), -1)
                d = np.array(metric(q, x) if callable(metric) else distances(metric, q, x), float)
                if d.shape != (len(q), len(x)):
                    raise ValueError("a metric gives a row for each query and a column for each item")
                d = np.round(d, digits) + 0.0
                if where is not None:
                    known = {}
                    for side, name in where.columns():
                        own = cell[f"{side}_values_{name}"]
                        values = own.slice(r, 1).flatten()
                        known[side, name] = tuple(v[None] if side == "item" else v[:, None] for v in _array(values))
                    d[~np.broadcast_to(where.holds(known)[0], d.shape)] = np.inf
                d[~np.isfinite(d)] = np.inf
                if best.n * k > MOST_HELD:
                    yield from best.rows()
                slots = best.slots_of(queries)
                limit = best.distances[slots, k - 1]
                if (open_ := np.flatnonzero(np.isinf(limit))).size:
                    limit[open_] = _kth(d[open_], k)
                row, column = np.divmod(_true(d <= limit[:, None]), len(ids))
                real = np.isfinite(d[row, column])
                row, column = row[real], column[real]
                best.add(slots[row], d[row, column], ids[column])
        yield from best.rows()

    return run


def knn(items: DataFrame, queries: DataFrame, k: int, metric: Metric = "cosine", where: Expression | None = None, cluster_by: str | None = None, digits: int = 6, item_block: int = ITEM_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, distance and rank of the k nearest items (id, vector, ...) that match each query (query_id, vector, ...).

    metric: a name, or a function of a matrix of queries and one of items that gives the matrix of distances; NaN matches nothing.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    blocks, asked, possible = block_pairs(items, queries, where, cluster_by, item_block, query_block, merged=True)
    n, dim = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = 8 * (dim or 0) + 16 * (1 + (len(where.columns()) if where is not None else 0))
    pairs = blocks.join(F.broadcast(asked) if n * width <= MOST_BROADCAST else asked, possible)
    return ranked(pairs.mapInArrow(_nearest(metric, k, digits, where), "query_id long, id long, distance double"), k)


def pairs_kept(items: DataFrame, queries: DataFrame, where: Expression, cluster_by: str | None = None, item_block: int = ITEM_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """pairs, of all blocks, and kept, of those that can hold a match."""
    blocks, asked, possible = block_pairs(items, queries, where, cluster_by, item_block, query_block)
    heads = [df.drop(*(c for c in df.columns if c.endswith(("_ids", "_vectors")) or "_values_" in c)) for df in (blocks, asked)]
    heads = [h.groupBy(*(F.col(f"`{c}`") for c in h.columns)).agg(F.count("*").alias(n)) for h, n in zip(heads, ("_blocks", "_asked"), strict=True)]  # those of the same bounds at once
    pairs = F.col("_blocks") * F.col("_asked")
    return heads[0].join(heads[1], F.lit(True)).agg(F.coalesce(F.sum(pairs), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum(F.when(possible, pairs)), F.lit(0)).cast("long").alias("kept"))
