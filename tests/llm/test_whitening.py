import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import queries, spectrum, whitening as wh

from llm_tables import SF01


def check(a, k):
    values, vectors = spectrum.leading(a, k)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:k]
    scale = max(1e-300, np.abs(a).sum(axis=1).max())
    assert np.allclose(values, want, atol=1e-13 * scale, rtol=0)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * values).max(initial=0) < 1e-12 * scale


@pytest.mark.parametrize("seed", range(6))
def test_leading_pairs(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    b = rng.standard_normal((n, n)) * 10.0 ** rng.integers(-3, 4, n)
    check(b @ b.T, 8)
    check((b + b.T) / 2, 8)


def test_repeated_and_close_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    for d in ([5] * 12, [7, 7, 7, 5, 5, 1] + [0] * 6, [3, 3 + 1e-14, 3 - 1e-9, 2] + [1] * 8, [0] * 12,
              [9, 1e-17] + [-2] * 10):
        m = (q * np.array(d, float)) @ q.T
        check((m + m.T) / 2, 8)
    check(np.array([[0.0, 1.0], [1.0, 0.0]]), 2)


@pytest.mark.parametrize("shift", [-2.0, 0.0, 0.5, 3.0])
def test_counts(shift):
    rng = np.random.default_rng(3)
    b = rng.standard_normal((15, 15))
    np.fill_diagonal(b, 0)
    a = b + b.T
    assert spectrum.count_above(a, shift) == int((np.linalg.eigvalsh(a) > shift).sum())


def brute(rows, k=8):
    """Definition: exact integers, numpy's eigh."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    z = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return dev, z @ u / np.sqrt(e), e / np.trace(v), n


def compare(out, rows, k):
    dev, w, share, n = brute(rows, k)
    got = {}
    for r in out.collect():
        got.setdefault(r._id, {})[r.component] = r
    assert sorted(got) == sorted(i for i, _ in rows)
    table = np.array([[got[i][c + 1].whitened for c in range(k)] for i, _ in rows])
    sign = np.sign((table * w).sum(axis=0))
    assert np.allclose(table, w * sign, atol=1e-6)
    for (i, _), exact in zip(rows, dev):
        for c in range(k):
            r = got[i][c + 1]
            assert (r.n, r.deviation) == (n, exact)
            assert abs(r.explained / share[c] - 1) < 1e-9 and r.identity_error < 1e-8


def test_query_against_brute_force(spark):
    out = queries.op12_whitening(spark, SF01).withColumnRenamed("vec_id", "_id")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    assert dict(out.dtypes) == {"_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                "whitened": "double", "explained": "double", "identity_error": "double"}
    compare(out, rows, 8)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.5, 3) for i, v in rows],
                                 "vec_id long, embedding array<double>, whitened double, _id int").repartition(3)


def test_edges(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(x) for x in rng.standard_normal(5) * (1, 2, 3, 4, 5)]) for i in range(30)]
    good += [(100, [1e5, 0.0, -1e5, 0.5, 2.0])]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5),
           (204, [1.0, 2.0]), (205, []), (206, [1e300, 0.0, 0.0, 0.0, 0.0])]
    out = wh.whitening(frame(spark, good + bad))
    assert {r._id for r in out.select("_id").distinct().collect()} == {i for i, _ in good}
    assert {r.component for r in out.select("component").distinct().collect()} == {1, 2, 3, 4, 5}
    dev, _, _, _ = brute(good, 5)
    got = {r._id: r.deviation for r in out.filter("component = 1").collect()}
    assert got == {i: (v if v < 1 << 63 else None) for (i, _), v in zip(good, dev)}
    compare(wh.whitening(frame(spark, good[:30])), good[:30], 5)


def test_repeated_rows_ties_and_empty(spark):
    assert wh.whitening(frame(spark, [])).collect() == []
    assert wh.whitening(frame(spark, [(1, [1.0, 2.0])] * 4)).collect() == []
    # Equal variance in every direction: all eigenvalues are equal.
    rows = [(i, [float(s) if i == j else 0.0 for j in range(4)]) for i in range(4) for s in (1, -1)]
    out = wh.whitening(frame(spark, rows + rows + [(None, [0.0] * 4)]))
    assert out.count() == 17 * 4 and out.filter("_id is null").count() == 4
    assert out.agg(F.max("identity_error")).first()[0] < 1e-9
    assert all(abs(r.explained - 0.25) < 1e-9 for r in out.collect())
