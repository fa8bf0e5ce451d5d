"""What pair scoring and stored tables leave on the disks."""

from pyspark.sql import functions as F

from scriptorium.operators import rerank as rr
from scriptorium.session import materialize


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_stored_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    materialize(spark.range(10_000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffle_files(spark) - before


def test_sliced_scores_are_the_whole_scores(spark):
    words = ["apple", "river", "stone", "mill", "extraordinarily", "bread", "cloud"]
    rows = [(i, f"PMC{i}", "t", "a", " ".join(words[(i * j) % 7] for j in range(1, 6))) for i in range(60)]
    arts = materialize(spark.createDataFrame(
        [*rows, (None, "x", "t", "a", "b")], "corpus_id long, pmcid string, title string, abstract string, body_text string"))
    pairs = materialize(spark.createDataFrame(
        [(f"PMC{i}", i, (i * 7 + j) % 60, j) for i in range(60) for j in range(1, 6)] + [("PMC1", 1, 8, 1), (None, 2, 3, 1)],
        "request_id string, request_cid long, corpus_id long, retrieval_rank int"))
    whole = rr.score_pairs(pairs, arts)
    sliced = rr.score_pairs(pairs, arts, broadcast_bytes=0, slice_bytes=1)
    assert sliced.columns == whole.columns and sliced.count() > 0
    assert sorted(map(str, sliced.collect())) == sorted(map(str, whole.collect()))
    assert len(sliced.inputFiles()) > 0 and all("/scored-" in f for f in sliced.inputFiles())
