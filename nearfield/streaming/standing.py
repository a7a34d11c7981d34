"""Standing queries: the nearest items of each query so far, kept up as items arrive.

Each micro-batch of items is packed into blocks, compared with the standing queries, and only a query's k nearest of a block go on to its
state, which holds the k nearest of all batches: bounded by k, in the state store, and restored from the checkpoint. A query whose answer
changes gives all of it anew under the next revision.

Defined results: as `exact.knn` on all items that arrived, each counted as often as it came; items without id or vector and queries without
vector are left out. The state store must be RocksDB (`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from nearfield.operators.exact import near_by_block

ANSWER = "query_id long, revision long, id long, distance double, rank long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Nearest(StatefulProcessor):
    """By query: revision, and the ids and distances of the nearest so far."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "revision long, ids array<long>, distances array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        revision, ids, distances = self.best.get() if self.best.exists() else (0, [], [])
        best = sorted(zip(distances, ids, strict=True))
        held = list(best)
        for some in rows:
            best = sorted([*best, *zip(some["distance"].tolist(), some["id"].tolist(), strict=True)])[: self.k]
        if best != held:
            self.best.update((revision + 1, [i for _, i in best], [d for d, _ in best]))
            n = len(best)
            yield pd.DataFrame({"query_id": [key[0]] * n, "revision": [revision + 1] * n, "id": [i for _, i in best], "distance": [d for d, _ in best], "rank": range(1, n + 1)})

    def close(self) -> None:
        pass


def answers(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """A stream of changed answers (query_id, revision, id, distance, rank) to queries (query_id, vector), from a stream of items (id, vector)."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    near = near_by_block(items, queries, k, metric)
    return near.groupBy("query_id").transformWithStateInPandas(_Nearest(k), ANSWER, "Update", "None")


def keep(items: DataFrame, queries: DataFrame, k: int, out: str, checkpoint: str, metric: str = "cosine") -> StreamingQuery:
    """Takes what has arrived since the last run and appends changed answers to a folder; a batch that is repeated overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    use_rocksdb(items.sparkSession)
    return answers(items, queries, k, metric).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """query_id, id, distance and rank: the latest answer of each query."""
    rows = spark.read.schema(f"{ANSWER}, batch long").parquet(out)
    latest = rows.groupBy("query_id").agg(F.max("revision").alias("revision"))
    return rows.join(latest, ["query_id", "revision"]).select("query_id", "id", "distance", "rank")
