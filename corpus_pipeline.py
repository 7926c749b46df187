"""The corpus pipeline: toxicity, near-duplicates, decontamination, source mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's result to the shared folder as
Parquet and reads it again as the next one's input. All but the last return the columns of documents. Nulls, empty texts,
repeated rows, empty tables and extra columns are treated as the operators' texts say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, simhash, source_mix, token_planes, toxicity
from inkwell.tables import stored, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the factorisation machine, fitted on all labels, scores toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays: SimHash fingerprints
    and pivot tables link them, verified on the shingles, and an exact join finds those too far apart for fingerprints."""
    return simhash.keep_one(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item within its error budget."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their target weights; a document is there as often as it is taken."""
    return source_mix.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids in bit planes; doc_id, start, n_tokens and ids_crc32 are read back."""
    return token_planes.read_shards(token_planes.write_shards(docs))


STAGES = [("toxicity", toxic_out), ("near-dedup", near_dedup), ("decontamination", benchmark_out), ("mixing", mix_sources), ("tokens", token_output)]

#: Models and fingerprints can't be put in SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
