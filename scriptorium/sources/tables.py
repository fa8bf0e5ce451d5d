"""Readers for the parquet tables the engine runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan over all cores when it came out in fewer partitions.

    A planning-time check (no job). Large inputs already arrive in many
    partitions and pass through untouched; a small file with one row group
    would otherwise run CPU-heavy text work in a single task.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def article_runs_from_documents(documents: DataFrame) -> DataFrame:
    """Map the ``documents`` table onto article text runs.

    ``pmcid = 'PMC' || doc_id``, ``corpus_id = doc_id``; the title is line 1,
    the abstract line 2 and the body every later line, each line one run. The
    whole text is used. Output: ``corpus_id, pmcid, title, abstract, body_text``
    as ARRAY<STRING> runs (pmcid a one-element list).
    """
    # At most three parts: line 1, line 2, and all later lines as one run
    # (join_runs turns its inner newlines into the joining spaces).
    parts = F.split(F.col("text"), "\n", 3)
    n = F.size(parts)
    return documents.select(
        F.col("doc_id").cast("long").alias("corpus_id"),
        F.array(F.concat(F.lit("PMC"), F.col("doc_id").cast("string"))).alias("pmcid"),
        F.slice(parts, 1, 1).alias("title"),
        F.slice(parts, 2, 1).alias("abstract"),
        F.slice(parts, 3, F.greatest(n - 2, F.lit(0))).alias("body_text"),
    )


def articles_from_runs(runs: DataFrame, keep_id: bool = True) -> DataFrame:
    """E3 on each of the four run lists: clean, join, strip (null when empty)."""
    cols = [tx.join_runs(f).alias(f) for f in tx.ARTICLE_FIELDS]
    if keep_id:
        cols = [F.col("corpus_id")] + cols
    return runs.select(*cols)


def require_fields(articles: DataFrame) -> DataFrame:
    """Keep an article only when all four fields are present and non-blank."""
    cond = None
    for f in tx.ARTICLE_FIELDS:
        c = tx.is_present(f)
        cond = c if cond is None else cond & c
    return articles.filter(held(cond))


def held(condition):
    """A filter condition that stays where it is written.

    Catalyst pushes a deterministic filter through projections and
    repartitions, re-evaluating the projected expressions inside it, possibly
    in a single scan task before ``spread``. Wrapping the condition in a
    non-deterministic guard keeps it above the projection, reading the
    already computed columns.
    """
    return F.when(F.spark_partition_id() >= 0, condition)


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """The article corpus ``(corpus_id, pmcid, title, abstract, body_text)``."""
    return require_fields(articles_from_runs(article_runs_from_documents(documents)))


def read_articles(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The corpus of the ``documents`` table; with ``ids (corpus_id)``, those articles only.

    Other documents are dropped before any text is cleaned.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    if ids is not None:
        docs = docs.join(ids.select(F.col("corpus_id").alias("doc_id")), "doc_id", "left_semi")
    return articles_from_documents(spread(docs))


def read_corpus_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given ``embeddings`` table as ``(corpus_id, embedding)``."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("corpus_id"), F.col("embedding"))
