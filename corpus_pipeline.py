"""From raw documents to packed training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns the columns of documents; the last returns the packed pieces. Between stages the
rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrachron.llm import decontam, neardup, packing, queries, secrets, toxicity
from terrachron.plans.tables import drop, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; labels of the held-out fold are never learnt.

    Null and empty texts stay, repeated rows share their fate, further columns are handed on, no rows give no rows.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays.

    Rows with the same doc_id and text share their fate; another text under the same
    doc_id has its own. Null doc_ids, null and empty texts stay; further columns are handed on; no rows give no rows.
    """
    found = neardup.near_duplicates(docs)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left_anti")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go; null and empty texts stay, an empty benchmark takes nothing.

    Repeated rows share their fate, further columns are handed on, no rows give no rows.
    """
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in a text becomes [SECRET], and n_chars follows. Null texts stay null.

    Repeated rows each stay and are changed alike, further columns are handed on, no rows give no rows.
    """
    return secrets.redacted(docs, queries.repo(), queries.owner())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces with their places in sequences of 2048 tokens; null and empty texts are one piece of one token.

    Repeated rows have pieces of their own, further columns end here, no rows give no rows.
    """
    return packing.pack(packing.token_pieces(docs, queries.TOKENIZER, queries.RANKS))


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL expresses neither the models nor the tokens; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        drop(before)  # what the stage before wrote; documents stay
    return docs
