"""How operators of this subpackage read tables, pick bounded samples and cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.storage import Scratch, durable

__all__ = ["Scratch", "durable", "keyed", "packed", "sampled", "table", "unpacked", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most so many rows, the same ones however the table is partitioned: those with the least hashes of their keys."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(most)


def packed(docs: DataFrame) -> DataFrame:
    """text, and all other columns as the struct _row, so that no name clashes with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"), "text")


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from packed rows."""
    return rows.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def written(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again, so that a lost executor costs no recomputing."""
    return durable(df)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, a digest of both that no other pair of them has: where two share 64 bits, the text's digest takes their place."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "text").alias("other"))
    shared = rows.groupBy("key").agg(F.min("other").alias("l"), F.max("other").alias("h")).where("l < h")
    clashes = [r.key for r in shared.select("key").collect()]  # about n * n / 2 ** 65 of n rows
    return rows.select("doc_id", "text", (F.when(F.col("key").isin(*clashes), F.col("other")).otherwise(F.col("key")) if clashes else F.col("key")).alias("key"))
