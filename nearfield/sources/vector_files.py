"""Vector files: .fvecs, .ivecs and ground-truth files by `vector_source`, tab-separated text, and vectors from hashes.

Parquet is the format to keep vectors in. What is defined for odd files stands with the sources.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vector_source


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    vector_source.register(spark)
    return spark.read.format(kind).load(path)


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """file, pos (of the record in its file) and vector, of a file or of the files of a folder."""
    return _read(spark, path, "fvecs")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "ivecs")


def write_fvecs(items: DataFrame, path: str, mode: str = "append") -> None:
    """The column vector, a file for each task."""
    vector_source.register(items.sparkSession)
    items.select(F.col("vector").cast("array<float>").alias("vector")).write.format("fvecs").mode(_mode(mode)).save(path)


def write_ivecs(items: DataFrame, path: str, mode: str = "append") -> None:
    vector_source.register(items.sparkSession)
    items.select(F.col("vector").cast("array<int>").alias("vector")).write.format("ivecs").mode(_mode(mode)).save(path)


def _mode(mode: str) -> str:
    """Sources in Python know these two."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    return mode


def write_truth(lists: DataFrame, path: str, mode: str = "append") -> None:
    """The column ids in order of query_id: a file for each range of it, whose names are in the same order."""
    vector_source.register(lists.sparkSession)
    ordered = lists.repartitionByRange("query_id").sortWithinPartitions("query_id")
    ordered.select(F.col("ids").cast("array<int>").alias("ids")).write.format("truth").mode(_mode(mode)).save(path)


def encode_vecs(vectors: list, dtype: str = "<f4") -> bytes:
    """The bytes of a .fvecs (or with "<i4" an .ivecs) file."""
    return b"".join(np.int32(len(v)).tobytes() + np.asarray(v, dtype).tobytes() for v in vectors)


def encode_truth(lists: list[list[int]]) -> bytes:
    """The bytes of a ground-truth file: the number of queries, then each list's length and ids."""
    return np.int32(len(lists)).tobytes() + encode_vecs(lists, "<i4")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """query_id, from 0 through all files in order of their names, and ids, in ascending distance."""
    return _read(spark, path, "truth")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """vector, one for each line of tab-separated numbers."""
    return spark.read.text(path).where("value <> ''").select(F.transform(F.split("value", "\t"), lambda x: x.cast("float")).alias("vector"))


def write_tsv(items: DataFrame, path: str) -> None:
    items.select(F.array_join(F.col("vector").cast("array<string>"), "\t").alias("value")).write.mode("overwrite").text(path)


def random_unit_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """id and vector: uniform components from a hash of id and place, then to length one."""
    u = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 24)) / float(1 << 24))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda c, x: c + x * x))
    return spark.range(n).withColumn("u", u).select("id", F.transform("u", lambda x: (x / norm).cast("float")).alias("vector"))
