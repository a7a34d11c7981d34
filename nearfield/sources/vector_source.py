"""Vector files as data sources of Spark: `spark.read.format("fvecs")`, `"ivecs"` and `"truth"`, and `df.write` with the same names.

.fvecs and .ivecs are records of one length, a dimension and so many components; a scan cuts the files of a path or folder into byte ranges
of about `RANGE_BYTES`, small files several to a range, and a task reads the records that begin in its ranges, as Arrow batches. Planning lists
files and runs no job. A truth file is the number of queries, then each one's count and ids: a file is one task, and the
queries of a folder's files are numbered through in order of their names.

Tasks write files under a temporary folder of the job; commit moves those of the tasks that succeeded into place, abort removes all, so a
retried or failed task leaves nothing. Overwriting removes the old files at the commit.

Paths are local or URIs of stores that Arrow's file systems reach. Defined results: an empty file has no records; one that isn't whole records of its
first one's dimension is an error, as are a missing path, null vectors and vectors of different lengths in one file.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 64 << 20
READ_BYTES = 8 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, length) of a file, or of the files in a folder, without those whose names begin with _ or a dot."""
    store, at = _store(path)
    found = store.get_file_info(at)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == pafs.FileType.File:
        return [(found.path, found.size)]
    inside = store.get_file_info(pafs.FileSelector(at))
    return sorted((f.path, f.size) for f in inside if f.type == pafs.FileType.File and f.base_name[0] not in "_.")


@dataclass
class Ranges(InputPartition):
    """(file, length, begin, end) of the bytes of a task; of a truth file, the number of its first query instead."""

    parts: list[tuple[str, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, range_bytes: int):
        self.path, self.kind, self.range_bytes = path, kind, range_bytes

    def partitions(self) -> list[InputPartition]:
        out, open_, size = [], [], 0
        for name, length in _files(self.path):
            for begin in range(0, length, self.range_bytes):
                end = min(begin + self.range_bytes, length)
                if open_ and size + end - begin > self.range_bytes:
                    out.append(Ranges(open_))
                    open_, size = [], 0
                open_.append((name, length, begin, end))
                size += end - begin
        return [*out, Ranges(open_)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for name, length, begin, end in partition.parts:
            with store.open_input_file(name) as f:
                dim = int(np.frombuffer(f.read_at(4, 0), "<i4")[0]) if length >= 4 else 0
                width = 4 + 4 * dim
                if dim < 1 or length % width:
                    raise ValueError(f"{name}: not whole records of {dim} components")
                at, last = -(-begin // width), -(-end // width)
                while at < last:
                    n = min(last - at, max(1, READ_BYTES // width))
                    table = np.frombuffer(f.read_at(n * width, at * width), "<i4").reshape(n, dim + 1)
                    if (table[:, 0] != dim).any():
                        raise ValueError(f"{name}: records differ in dimension")
                    flat = np.ascontiguousarray(table[:, 1:]).ravel()
                    values = pa.array(flat.view("<f4") if self.kind == "fvecs" else flat)
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), values)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), vectors], names=["file", "pos", "vector"])
                    at += n


class _TruthReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, _ = _store(self.path)
        out, first = [], 0
        for name, length in _files(self.path):
            if length:
                with store.open_input_file(name) as f:
                    n = int(np.frombuffer(f.read_at(4, 0), "<i4")[0])
                out.append(Ranges([(name, length, first, first + n)]))
                first += n
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for name, _, first, end in partition.parts:
            with store.open_input_stream(name, buffer_size=READ_BYTES) as f:
                f.read(4)
                queries, lists, size = [], [], 0
                for query in range(first, end):
                    head = f.read(4)
                    n = int(np.frombuffer(head, "<i4")[0]) if len(head) == 4 else -1
                    body = f.read(4 * n) if n >= 0 else b""
                    if n < 0 or len(body) != 4 * n:
                        raise ValueError(f"{name}: ends before its queries do")
                    queries.append(query)
                    lists.append(np.frombuffer(body, "<i4"))
                    size += len(body) + 8
                    if size > READ_BYTES:
                        yield _lists(queries, lists)
                        queries, lists, size = [], [], 0
                if f.read(1):
                    raise ValueError(f"{name}: goes on after its queries")
                if queries:
                    yield _lists(queries, lists)


def _lists(queries: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists), pa.int32()))], names=["query_id", "ids"])


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    records: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite
        self.temporary = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = _store(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex[:8]}.{'bin' if self.kind == 'truth' else self.kind}"
        folder = posixpath.join(at, self.temporary)
        store.create_dir(folder, recursive=True)
        n, dim, bodies = 0, None, []
        with store.open_output_stream(posixpath.join(folder, name)) as out:
            for batch in iterator:
                column = batch.column(batch.schema.get_field_index("ids" if self.kind == "truth" else "vector"))
                if not len(column):
                    continue
                sizes = np.diff(column.offsets.to_numpy())
                flat = column.flatten()
                if column.null_count or flat.null_count:
                    raise ValueError("vectors and their components can't be null")
                values = flat.to_numpy().astype("<f4" if self.kind == "fvecs" else "<i4")
                if self.kind != "truth":
                    dim = int(sizes[0]) if dim is None else dim
                    if (sizes != dim).any() or not dim:
                        raise ValueError("vectors of one file have one length, of 1 or more")
                    table = np.empty((len(sizes), dim + 1), "<i4")
                    table[:, 0], table[:, 1:] = dim, values.view("<i4").reshape(len(sizes), dim)
                    out.write(table.tobytes())
                else:
                    starts = np.cumsum(sizes) - sizes
                    bodies.append(np.insert(values, starts, sizes).astype("<i4").tobytes())
                n += len(sizes)
            if self.kind == "truth" and n:  # the count of a file's queries stands first
                out.write(np.int32(n).tobytes() + b"".join(bodies))
        return Written(name if n else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        old = [name for name, _ in _files(self.path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                store.move(posixpath.join(at, self.temporary, m.name), posixpath.join(at, m.name))
        for name in old:
            store.delete_file(name)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _store(self.path)
        folder = posixpath.join(at, self.temporary)
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


class Fvecs(DataSource):
    """file, pos (of the record in its file) and vector. Written from a column `vector` of numbers."""

    kind, component = "fvecs", "float"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return f"file string, pos long, vector array<{self.component}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.kind, int(self.options.get("rangebytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.kind, overwrite)


class Ivecs(Fvecs):
    kind, component = "ivecs", "int"


class Truth(DataSource):
    """query_id (from 0) and ids, in ascending distance. Written from a column `ids`, in the order of the rows; see `vector_files.write_truth`."""

    kind = "truth"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return "query_id long, ids array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _TruthReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.kind, overwrite)


def register(spark: SparkSession) -> None:
    for source in (Fvecs, Ivecs, Truth):
        spark.dataSource.register(source)
