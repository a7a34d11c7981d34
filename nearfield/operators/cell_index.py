"""A stored index for approximate search: items in files by cell, with centroids, codes of a few bytes, and versions.

`create` finds centroids (and codebooks) on a bounded sample once and saves them in the index's parameters. Every batch of items is
dealt to cells by them and written partitioned by cell, each cell to as many files as its rows ask for, so a large cell is
many tasks. A search joins the items with the cells that its queries probe, at most as many as there are: Spark prunes the
files of all other cells (dynamic partition pruning), so what is read falls with the probes. `append` adds a batch without
clustering anew; batches, compaction and concurrent writers go through the log of `commits`.

With codebooks (product quantisation: the vector cut in pieces, each the number of its nearest of up to 256 centres) a search
reads codes first: a query's distances to all centres of a piece make a table, the sum of whose entries ranks the items; the best
`rerank` of a query are joined with the vectors by cell and id, and ranked exactly. So few vectors are read, whatever is probed.

Defined results: rows without id or vector aren't kept; equal distances rank by id; repeated ids of one batch are kept and found as
often; an append leaves out ids that the index has, unless told not to; an empty table makes an index without results. Columns of items are kept, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import cells, commits
from .exact import MOST_BROADCAST, QUERY_BLOCK, distances, matrix, near_by_block, packed, ranked, watched

FORMAT = 3
#: Rows of a cell in one file.
ROWS_A_FILE = 200_000
CODE_BLOCK = 16_384


@dataclass(frozen=True)
class CellIndex:
    """A version of an index, as loaded: what it holds stays as it is."""

    spark: SparkSession
    path: str
    version: int
    params: dict
    parts: dict
    centres: np.ndarray
    codebooks: list[np.ndarray]

    @property
    def metric(self) -> str:
        return self.params["metric"]

    @property
    def n_items(self) -> int:
        return sum(p["n"] for p in self.parts.values())

    @property
    def n_files(self) -> int:
        return sum(p["files"] for p in self.parts.values())

    def files(self) -> DataFrame:
        """The items as they are stored: with _part and _cell (the partition columns), and _code where there are codebooks."""
        folders = [f"{self.path}/items/{name}" for name in sorted(self.parts)]
        reader = self.spark.read.schema(self.params["schema"]).option("basePath", f"{self.path}/items")
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], self.params["schema"])

    def rows(self) -> DataFrame:
        return self.files().drop("_part")

    def items(self) -> DataFrame:
        return self.rows().drop("_cell", "_code")


def codebooks_of(sample: np.ndarray, pieces: int, centres: int = 256, rounds: int = 12, seed: int = 7) -> list[np.ndarray]:
    """For each piece of the vectors its centres, by k-means."""
    return [cells.clustered(part, centres, rounds, seed) for part in np.array_split(sample, pieces, axis=1)] if len(sample) else []


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric.startswith("cosine") else x


def coded(x: np.ndarray, codebooks: list[np.ndarray]) -> np.ndarray:
    """A byte for each vector and piece."""
    parts = np.array_split(x, len(codebooks), axis=1)
    return np.stack([distances("l2sq", part, book).argmin(1) for part, book in zip(parts, codebooks, strict=True)], axis=1).astype(np.uint8)


def _with_codes(rows: DataFrame, codebooks: list[np.ndarray], metric: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)
    at = rows.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                codes = coded(_unit(matrix(part.column(at)).astype(float), metric), shared.value)
                column = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "_code"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_code binary"]))


def _written(items: DataFrame, path: str, params: dict, rows_a_file: int) -> tuple[str, dict]:
    """The name and facts of a part with the items: written, but not yet committed."""
    name = f"_part={uuid.uuid4().hex}"
    centres = np.array(params["centres"])
    known = items.where("id IS NOT NULL AND vector IS NOT NULL")
    celled = cells.with_cells(known, centres, metric=params["metric"], name="_cell", apart="_apart")
    facts = celled.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_apart").alias("radius")).collect()  # a row a cell
    sizes, celled = {r["_cell"]: r["n"] for r in facts}, celled.drop("_apart")
    salts = {c: -(-n // rows_a_file) for c, n in sizes.items()}
    if params["codebooks"]:
        celled = _with_codes(celled, [np.array(b) for b in params["codebooks"]], params["metric"])
    large = [F.lit(x) for c, s in salts.items() if s > 1 for x in (c, s)]
    files = F.coalesce(F.try_element_at(F.create_map(*large), F.col("_cell")), F.lit(1)) if large else F.lit(1)
    dealt = celled.repartition(max(1, min(sum(salts.values()), 10_000)), "_cell", F.pmod(F.xxhash64("id"), files))
    dealt.sortWithinPartitions("_cell", "id").write.partitionBy("_cell").parquet(f"{path}/items/{name}")
    spark = items.sparkSession
    store, _ = commits._store(spark, path)
    found = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/items/{name}/*/*.parquet"))
    return name, {"n": sum(sizes.values()), "files": len(found or []), "radii": {str(r["_cell"]): r["radius"] for r in facts}}


def create(items: DataFrame, path: str, n_cells: int = 16, metric: str = "cosine", pieces: int = 0, centres: np.ndarray | None = None, most_sampled: int = 20_000, rows_a_file: int = ROWS_A_FILE, seed: int = 7) -> CellIndex:
    """Makes an index of items (id, vector, ...). centres: instead of those found by k-means on a sample. pieces: of the codes; 0 for none."""
    if metric not in ("cosine", "cosine_units", "l2sq"):
        raise ValueError(f"no cells for {metric}")
    if taken := [c for c in items.columns if c in ("_cell", "_code", "_part", "_apart")]:
        raise ValueError(f"{', '.join(taken)}: names of the index's own columns")
    spark = items.sparkSession
    items = items.withColumns({"id": F.col("id").cast("long")})
    if commits.state(spark, path)["version"]:
        raise ValueError(f"{path} has an index already")
    sample = cells.sampled(items, most_sampled, metric, seed) if centres is None or pieces else np.zeros((0, 0))
    centres = cells.clustered(sample, n_cells, 10, seed) if centres is None else _unit(np.asarray(centres, float), metric)
    books = codebooks_of(sample, pieces, seed=seed) if pieces else []
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), *(["_code binary"] if books else []), "_part string", "_cell long"]
    params = {"format": FORMAT, "metric": metric, "pieces": pieces, "centres": centres.tolist(), "codebooks": [b.tolist() for b in books], "schema": ", ".join(fields)}
    name, facts = _written(items, path, params, rows_a_file)

    def first(now: dict) -> dict:
        if now["version"]:
            raise commits.Conflict(f"{path} has an index by now")
        return {"params": params, "add": {name: facts | {"batch": 0}}}

    return _loaded(spark, path, commits.commit(spark, path, first))


def _loaded(spark: SparkSession, path: str, state: dict) -> CellIndex:
    params = state["params"]
    if params.get("format") != FORMAT:
        raise ValueError("not an index of this format")
    return CellIndex(spark, path, state["version"], params, state["parts"], np.array(params["centres"]), [np.array(b) for b in params["codebooks"]])


def load(spark: SparkSession, path: str, version: int | None = None, metric: str | None = None) -> CellIndex:
    """The index as it is now, or was at a version; refuses another format or metric."""
    index = _loaded(spark, path, commits.state(spark, path, version))
    if metric and metric != index.metric:
        raise ValueError(f"the index was made for {index.metric}")
    return index


def append(spark: SparkSession, path: str, items: DataFrame, batch: int | None = None, skip_known: bool = True, compact_when: tuple[int, float] | None = None, rows_a_file: int = ROWS_A_FILE) -> CellIndex:
    """Adds a batch by the stored centroids, as a new version. A batch with a number replaces the one of that number, so a replay changes nothing.

    skip_known: leave out ids that other batches have; of those only the ids are read. compact_when: (rows, share) beyond which
    what was appended since the last compaction is merged (see `needs_compaction`).
    """
    index = load(spark, path)
    if batch is not None and any(batch <= p.get("through", -1) for p in index.parts.values()):
        return index  # a replay of what was merged since
    if not len(index.centres):
        raise ValueError("the index was made without items, so it has no cells: make it anew")
    others = {k: v for k, v in index.parts.items() if batch is None or v["batch"] != batch}
    fields = [f.name for f in index.items().schema]
    items = items.withColumns({"id": F.col("id").cast("long")}).select(*fields)
    if skip_known and others:
        items = items.join(CellIndex(spark, path, index.version, index.params, others, index.centres, index.codebooks).rows().select("id"), "id", "left_anti").select(*fields)
    name, facts = _written(items, path, index.params, rows_a_file)

    def add(now: dict) -> dict:
        number = max((max(p["batch"], p.get("through", 0)) for p in now["parts"].values()), default=0) + 1 if batch is None else batch
        return {"add": {name: facts | {"batch": number}}, "remove": [k for k, p in now["parts"].items() if p["batch"] == number]}

    index = _loaded(spark, path, commits.commit(spark, path, add))
    return compact(spark, path, rows_a_file) if compact_when and needs_compaction(index, *compact_when) else index


def needs_compaction(index: CellIndex, least_rows: int = 1000, least_share: float = 0.1) -> bool:
    """Whether the rows outside the largest part exceed both a number and a share of all."""
    delta = index.n_items - max((p["n"] for p in index.parts.values()), default=0)
    return delta > least_rows and delta > least_share * index.n_items


def compact(spark: SparkSession, path: str, rows_a_file: int = ROWS_A_FILE) -> CellIndex:
    """Merges the parts of the newest version into one, which knows the batches that it holds; parts that others append meanwhile stay beside it."""
    index = load(spark, path)
    name, facts = _written(index.items(), path, index.params, rows_a_file)

    def merge(now: dict) -> dict:
        if missing := set(index.parts) - set(now["parts"]):
            commits._store(spark, path)[0].delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/items/{name}"), True)
            raise commits.Conflict(f"{len(missing)} of the merged parts were replaced meanwhile")
        through = max(max(p["batch"], p.get("through", 0)) for p in index.parts.values())
        return {"add": {name: facts | {"batch": -1, "through": through}}, "remove": list(index.parts)}

    return _loaded(spark, path, commits.commit(spark, path, merge)) if index.parts else index


def vacuum(spark: SparkSession, path: str, keep_versions: int = 1, older_than_s: float = 86_400) -> list[str]:
    return commits.vacuum(spark, path, "items", keep_versions, older_than_s)


def probed(index: CellIndex, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, vector and _cell, a row for each of the nearest cells of each query."""
    return cells.with_cells(queries.select("query_id", "vector"), index.centres, probes, index.metric, name="_cell")


def in_cells(index: CellIndex, asked: DataFrame, where: Column | str | None = None) -> DataFrame:
    """The items of the probed cells that pass a condition; files of other cells aren't opened."""
    rows = index.rows().join(_wanted(asked), "_cell", "left_semi")
    return rows if where is None else rows.where(where)


def _wanted(asked: DataFrame) -> DataFrame:
    """The cells asked for, no more rows than there are cells. The condition holds for all: it is what makes Spark prune files by them."""
    return F.broadcast(asked.where("_cell >= 0").select("_cell").distinct())


def search(index: CellIndex, queries: DataFrame, k: int, probes: int, where: Column | str | None = None, rerank: int = 0, watch: Observation | str | None = None) -> DataFrame:
    """query_id, id, distance and rank of the k nearest found in each query's nearest cells, among items that pass a condition.

    rerank: instead of all vectors of those cells, compare codes, and then the vectors of so many items a query. watch: see `exact.watched`.
    """
    if k < 1 or probes < 1 or rerank and rerank < k:
        raise ValueError("k and probes must be 1 or more, rerank k or more")
    if rerank and not index.params["pieces"]:
        raise ValueError("the index has no codes")
    asked = probed(index, queries, probes)
    rows = in_cells(index, asked, where)
    if not rerank or not index.codebooks:  # none were found in an empty table
        return ranked(near_by_block(rows, asked, k, index.metric, F.col("_cell"), watch=watch), k)
    return reranked(index, queries, candidates(index, asked, rows, rerank, watch), k)


def _code_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            for first in range(begin, end, CODE_BLOCK):
                part = batch.slice(first, min(CODE_BLOCK, end - first))
                codes = b"".join(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([codes], pa.binary()), pa.array([int(cell[first])])], names=["ids", "codes", "_cell"])


def candidates(index: CellIndex, asked: DataFrame, rows: DataFrame, most: int, watch: Observation | str | None = None) -> DataFrame:
    """query_id, id and _cell of the nearest items of each query by their codes. Of the items id, code and what the condition names are read."""
    spark, metric = index.spark, index.metric
    books = spark.sparkContext.broadcast(index.codebooks)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, queries = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                q = _unit(np.frombuffer(r["q_vectors"]).reshape(len(queries), -1), metric)
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
                d = np.zeros((len(queries), len(ids)))
                for j, (part, book) in enumerate(zip(np.array_split(q, len(books.value), axis=1), books.value, strict=True)):
                    d += distances("l2sq", part, book)[:, codes[:, j]]
                order = np.argsort(d, axis=1, kind="stable")[:, :most]
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, n)), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel()), pa.array(np.full(order.size, r["_cell"]))], names=["query_id", "id", "distance", "_cell"])

    blocks = rows.select("id", "_code", "_cell").sortWithinPartitions("_cell").mapInArrow(_code_blocks, "ids binary, codes binary, _cell long")
    n, dim = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    few = asked.select("query_id", "vector", F.col("_cell").cast("string")).coalesce(max(1, -(-n // QUERY_BLOCK)))
    blocked = packed(few, QUERY_BLOCK, True).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("g").cast("long").alias("_cell"))
    blocked = F.broadcast(blocked) if n * (8 * (dim or 0) + 16) <= MOST_BROADCAST else blocked
    found = watched(blocks.join(blocked, "_cell").select("ids", "codes", "q_ids", "q_vectors", "_cell"), watch).mapInArrow(near, "query_id long, id long, distance double, _cell long")
    nearest = ranked(found.select("query_id", F.struct("id", "_cell").alias("id"), "distance"), most)
    return nearest.select("query_id", "id.id", "id._cell")


def reranked(index: CellIndex, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k nearest of the candidates by their vectors, which are joined by cell and id: files of cells without candidates aren't opened."""
    from nearfield.functions.vectors import METRICS, rounded

    pairs = found.distinct().join(queries.select("query_id", F.col("vector").alias("_query")), "query_id")
    vectors = index.rows().select("id", "vector", "_cell").join(_wanted(found), "_cell", "left_semi")
    both = pairs.join(vectors, ["_cell", "id"])
    return ranked(both.select("query_id", "id", rounded(METRICS[index.metric](F.col("_query"), F.col("vector"))).alias("distance")), k)


def reads(index: CellIndex, queries: DataFrame, probes: int) -> DataFrame:
    """probes, and how many of the index's cells, files and rows a search with them reads."""
    stored = index.files().select("_cell", F.col("_metadata.file_path").alias("file")) if index.parts else index.files().select("_cell", F.lit("").alias("file"))
    rows = stored.join(_wanted(probed(index, queries, probes)), "_cell", "left_semi")
    read = rows.agg(F.countDistinct("_cell").alias("cells_read"), F.countDistinct("file").alias("files_read"), F.count("*").alias("rows_read"))
    return read.select(F.lit(probes).cast("long").alias("probes"), "*", F.lit(index.n_files).cast("long").alias("files"), F.lit(index.n_items).cast("long").alias("rows"))
