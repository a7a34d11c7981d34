"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Stages take and return the columns of documents, whatever they are besides doc_id and text; the last
returns token ids. Each handles null and empty texts, repeated rows, missing identifiers and empty
tables as the operator that it calls does (see there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, decontamination, jaccard_join, pii, quality_rules
from nearfield.llm.tables import Scratch, packed, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality_rules.accepted(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: word 5-gram sets at a similarity of 0.8 or more."""
    return jaccard_join.representatives(docs, part=80, whole=100, n=5)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words of a benchmark item in a row."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by their kind; n_chars follows the text."""
    masked = pii.masked(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast(masked.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source where they exist, the ids of the text, their number, and whether they decode to the text."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packed(docs).select("_row", "text", F.sha2("text", 256).alias("_digest"))
    both = bpe.coded(rows, path, ["_row", "_digest"])
    kept = [F.col(f"_row.{c}").alias(c) for c in ("doc_id", "lang", "source") if c in docs.columns]
    return both.select(*kept, "ids", F.size("ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.coalesce("_digest", F.sha2(F.lit(""), 256))).alias("decodes"))


STAGES = [
    ("quality rules", good_documents),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", uncontaminated),
    ("pii", without_personal_data),
    ("bpe", token_ids),
]
#: None of the first, fourth and fifth stages can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for _, stage in STAGES:
        before, docs = docs, scratch.put(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
