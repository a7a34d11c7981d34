"""Indexes that grow with a stream, and streams of queries against an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators import cell_index, layered


def append_stream(items: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Adds each micro-batch of a stream of (id, vector) to a stored graph; a replayed batch changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            layered.grow(batch.sparkSession, path, batch)

    writer = items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def search_stream(queries: DataFrame, path: str, checkpoint: str, out: str, k: int, ef: int = 50) -> StreamingQuery:
    """Answers each micro-batch of a stream of (query_id, vector) from the version that the graph has then."""

    def answer(batch: DataFrame, number: int) -> None:
        found, _ = layered.search(layered.load(batch.sparkSession, path), batch, k, ef)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to_cells(items: DataFrame, path: str, checkpoint: str, compact_when: tuple[int, float] | None = (100_000, 0.1), once: bool = True) -> StreamingQuery:
    """Appends each micro-batch of a stream of items to a stored cell index; a replayed batch replaces itself, and many appended rows are merged."""

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            cell_index.append(batch.sparkSession, path, batch, number + 1, compact_when=compact_when)

    writer = items.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def search_cells(queries: DataFrame, path: str, checkpoint: str, out: str, k: int, probes: int, rerank: int = 0) -> StreamingQuery:
    """Answers each micro-batch of a stream of (query_id, vector) from the version that the cell index has then."""

    def answer(batch: DataFrame, number: int) -> None:
        found = cell_index.search(cell_index.load(batch.sparkSession, path), batch, k, probes, rerank=rerank)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
