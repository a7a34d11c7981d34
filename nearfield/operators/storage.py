"""Tables that outlive the executors that made them, in one folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the context or else of the session's spark.checkpoint.dir.

    Where neither is set, a folder of our own on a local master only, as in tests: on a cluster no
    machine's own folder would do, so that is an error.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Intermediate tables of one computation, as compressed Parquet, deleted once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame) -> DataFrame:
        """The rows written and read again, so that a lost executor costs no recomputing and plans stay short."""
        path = fresh_path(self.spark, "table")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, _ = self.paths.pop(id(table), (None, None))
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def clear(self, *kept: DataFrame) -> None:
        """Drops all tables but those to keep."""
        self.drop(*(t for k, (_, t) in list(self.paths.items()) if k not in {id(x) for x in kept}))


def durable(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there."""
    return Scratch(df.sparkSession).put(df)
