"""The pruning index of R4 against retrieve_top_k and a plain product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import index
from scriptorium.operators import retrieve as rt

SCHEMA = "corpus_id long, embedding array<double>"


def vectors(spark, mat, ids=None):
    ids = range(len(mat)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, mat)], SCHEMA).repartition(4)


def requests(spark, mat):
    return spark.createDataFrame([(f"r{i}", [float(x) for x in v]) for i, v in enumerate(mat)],
                                 "request_id string, embedding array<double>")


def rows(df):
    return sorted((r.request_id, r["rank"], r.corpus_id, round(r.score, 9)) for r in df.collect())


def clustered(rng, centres=12, each=60, dim=16):
    c = rng.standard_normal((centres, dim)) * 4
    return np.concatenate([x + 0.05 * rng.standard_normal((each, dim)) for x in c]), c


def test_clustered_vectors_skip_blocks(spark, tmp_path):
    rng = np.random.default_rng(0)
    mat, centres = clustered(rng)
    blocks = index.build_index(vectors(spark, mat), str(tmp_path / "i"), leaders=48, block_bytes=20 * 16 * 8)
    assert blocks.agg(F.sum("n")).first()[0] == len(mat) and blocks.agg(F.max("n")).first()[0] <= 20
    req = requests(spark, centres)
    skipped = spark.sparkContext.accumulator(0)
    got = rows(index.search_index(req, blocks, 10, skipped=skipped))
    assert got == rows(rt.retrieve_top_k(req, vectors(spark, mat), 10))
    assert skipped.value > 0.5 * len(mat) * len(centres)


@pytest.mark.parametrize("digits", [None, 1])
def test_ties_repeats_and_odd_values(spark, tmp_path, digits):
    rng = np.random.default_rng(1)
    mat = rng.integers(-2, 3, (150, 3)).astype(float)  # ties everywhere
    mat[7] = np.nan
    mat[11] = np.inf
    mat[13] = 0
    ids = [int(x) for x in rng.permutation(150)]
    corpus = vectors(spark, mat, ids).unionByName(spark.createDataFrame([(None, [1.0] * 3), (5000, None)], SCHEMA))
    req = requests(spark, np.concatenate([rng.integers(-2, 3, (20, 3)), [[0, 0, 0], [1e3, -1e3, 0.123456]]]))
    blocks = index.build_index(corpus, str(tmp_path / "i"), leaders=9, block_bytes=8 * 3 * 8)
    got = rows(index.search_index(req, blocks, 7, digits=digits))
    assert got == rows(rt.retrieve_top_k(req, corpus.filter("corpus_id is not null"), 7, digits=digits))
    over = rows(index.search_index(req, blocks, 7, digits=digits, broadcast_bytes=10))
    assert over == got


def test_small_and_empty(spark, tmp_path):
    few = index.build_index(vectors(spark, np.eye(3)), str(tmp_path / "a"))
    assert len(rows(index.search_index(requests(spark, np.eye(3)), few, 10))) == 9
    assert rows(index.search_index(requests(spark, np.zeros((0, 3))), few, 10)) == []
    none = index.build_index(vectors(spark, np.zeros((0, 3))), str(tmp_path / "b"))
    assert rows(index.search_index(requests(spark, np.eye(3)), none, 2)) == []
    with pytest.raises(ValueError):
        index.search_index(requests(spark, np.eye(2)), few, 2)
    with pytest.raises(ValueError):
        index.build_index(vectors(spark, np.eye(3)).unionByName(vectors(spark, np.eye(2))), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        index.search_index(requests(spark, np.eye(3)), few, 0)
