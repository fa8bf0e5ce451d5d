"""A training-corpus pipeline of five of the operators in ``scriptorium.llm``.

Each stage takes all rows its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes every stage's rows below ``spark.checkpoint.dir`` and
reads them back, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontaminate, exact_dedup, jaccard_join, quality, sentencepiece_sampler
from scriptorium.llm.common import save


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, of all their characters, rejects go."""
    return quality.quality_filter(docs, _table(spark, sf_dir, "labels"), every=True)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of every document left, and whether they decode to its text."""
    out = sentencepiece_sampler.encode(docs, check=True)
    return out.withColumnRenamed("_id", "doc_id").select("doc_id", "n_tokens", "ids", "lossless")


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("encode", encode_stage),
]

#: SQL cannot express the language model, the near duplicates and the sampled pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
