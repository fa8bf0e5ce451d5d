"""Embedding whitening on the leading components of the covariance.

Each entry c becomes the integer ``floor(1024 c) + 100000``, so counts and sums are exact
whatever the order of the tasks. Three passes over the vectors, none of which shuffles them:

1. number of vectors and sum of each dimension (one row per task and length);
2. the centred covariance: a task sends its matrix row by row, rows of one number are
   added up by the task that their number is dealt to, and the driver gets one matrix
   (dimensions squared, independent of the rows);
3. the projection of every vector on the components, which ``spectrum.leading`` finds by
   LDL' counts and Rayleigh quotient iteration.

The covariance of what was stored is then measured, and its distance from the identity
is part of the result.

Edge cases: a vector that is null, or holds a null, a NaN, an infinity or an entry whose
integer needs over 62 bits, is left out. Of vectors with different lengths the commonest
length counts (of equally common ones the longest); others are left out. A component
without variance has no whitened value, and no row: a table of equal vectors, like an
empty one, gives none. Repeated rows count and come back one by one; a null id stays null.
``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spectrum
from .common import save

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
_SAFE = 1 << 62
_LOW = (1 << 32) - 1


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"))


def _integers(batch: pa.RecordBatch):
    """Per length: the ids and the integer vectors of the rows that count."""
    batch = batch.filter(pc.is_valid(batch.column("_vec")))
    column = batch.column("_vec")
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = pa.array(lengths == d)
        c = column.filter(rows).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        with np.errstate(over="ignore"):
            x = np.floor(c * SCALE)
        good = (np.isfinite(c) & (np.abs(x) < _SAFE)).all(axis=1)
        yield d, batch.column("_id").filter(rows).filter(pa.array(good)), x[good].astype(np.int64) + OFFSET


def _sums(batches):
    total: dict[int, list] = {}
    for batch in batches:
        for d, _, x in _integers(batch):
            t = total.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
            t[0] += len(x)
            t[1] += (x >> 32).sum(axis=0)
            t[2] += (x & _LOW).sum(axis=0)
    for d, (n, high, low) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d], pa.int32()), pa.array([n]), pa.array([high.tolist()], pa.list_(pa.int64())),
             pa.array([low.tolist()], pa.list_(pa.int64()))], ["d", "n", "high", "low"])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``, exact: 64-bit integers where they suffice, else Python's."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if most < _SAFE // 2:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _squares(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; None beyond a long."""
    if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < _SAFE:
        return (y * y).sum(axis=1).tolist()
    exact = (sum(int(v) ** 2 for v in row) for row in y.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def _covariances(batches, d, n, sums):
    total = np.zeros((d, d))
    for batch in batches:
        for length, _, x in _integers(batch):
            if length == d:
                z = _deviations(x, n, sums).astype(np.float64) / n
                total += z.T @ z
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(d), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])


def _added(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column("i").to_pylist(), batch.column("row").to_pylist(), strict=True):
            v = np.frombuffer(row)
            total[i] = total[i] + v if i in total else v
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
        ["i", "row"])


@dataclass
class Whitener:
    n: int                 # vectors of the fit list
    sums: list[int]        # sum of each dimension
    trace: float           # of the covariance
    values: np.ndarray     # eigenvalues, falling
    vectors: np.ndarray    # unit eigenvectors as rows


def fit(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
        vec_col: str = "embedding") -> Whitener | None:
    """The leading components of all vectors' covariance; None without vectors."""
    vectors = _vectors(embeddings, id_col, vec_col)
    parts = save(vectors.mapInArrow(_sums, "d int, n long, high array<long>, low array<long>"), "vector-sums")
    common = parts.groupBy("d").agg(F.sum("n").alias("n")).filter("n > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return None
    d, n = common.d, common.n
    by_dim = parts.filter(F.col("d") == d).select(
        F.posexplode(F.arrays_zip("high", "low")).alias("i", "s")).groupBy("i").agg(
        F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"),
        F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low"))
    sums = [0] * d
    for r in by_dim.collect():  # one row per dimension
        sums[r.i] = (int(r.high) << 32) + int(r.low)
    rows = vectors.mapInArrow(lambda b: _covariances(b, d, n, sums), "i int, row binary")
    added = rows.repartition("i").mapInArrow(_added, "i int, row binary")
    cov = np.zeros((d, d))
    for r in added.collect():  # one row per dimension
        cov[r.i] = np.frombuffer(r.row)
    cov /= n
    values, found = spectrum.leading(cov, components)
    real = values > d * spectrum.EPS * float(np.abs(cov).sum(axis=1).max())
    return Whitener(n, sums, float(np.trace(cov)), values[real], found[real])


def _projected(batches, n, sums, axes):
    for batch in batches:
        for d, ids, x in _integers(batch):
            if d != len(sums) or not len(x):
                continue
            y = _deviations(x, n, sums)
            w = (y.astype(np.float64) / n) @ axes
            ends = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(_squares(y), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))],
                ["_id", "deviation", "whitened"])


def whitened(embeddings: DataFrame, model: Whitener, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``_id, deviation, whitened array<double>`` of every vector that counts, stored once."""
    axes = np.ascontiguousarray((model.vectors / np.sqrt(model.values)[:, None]).T)
    n, sums = model.n, model.sums
    return save(_vectors(embeddings, id_col, vec_col).mapInArrow(
        lambda b: _projected(b, n, sums, axes), "_id long, deviation long, whitened array<double>"), "whitened")


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity."""
    w = [F.col("whitened")[i] for i in range(k)]
    mean = rows.agg(*[F.avg(c) for c in w]).first()
    if mean[0] is None:
        return 0.0
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    cov = rows.agg(*[F.avg((w[i] - mean[i]) * (w[j] - mean[j])) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(cov, pairs, strict=True))


def whitening(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
              vec_col: str = "embedding") -> DataFrame:
    """One row per vector and component: ``_id, component, n, deviation, whitened, explained,
    identity_error``."""
    schema = ("_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    model = fit(embeddings, components, id_col, vec_col)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = whitened(embeddings, model, id_col, vec_col)
    error = identity_error(rows, len(model.values))
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    long_rows = rows.select("_id", "deviation", F.posexplode("whitened").alias("i", "w"))
    return long_rows.select(
        "_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("w").alias("whitened"), F.get(share, F.col("i")).alias("explained"),
        F.lit(float(error)).alias("identity_error"))
