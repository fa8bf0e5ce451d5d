"""Exact top-k (R4) over a stored corpus of vector blocks, skipping blocks that cannot matter.

``build_index`` deals the vectors to the nearest of some leaders (corpus vectors chosen by
a hash), and packs the vectors of one leader, in blocks of about ``block_bytes``, one block a
row, with the block's centre and radius. For a request q no vector of a block scores above
``q.centre + |q| radius``.

``search_index`` runs two light passes and the full one:

1. the centres alone (the scan does not read the vectors) name each request's best block;
2. these blocks give each request k true scores, the last of which it must at least reach;
3. every block is read, and scored for the requests whose bound reaches that k-th score
   (or the better one found meanwhile in the same task). A block no request needs costs one
   product with its centre.

The result is that of ``retrieve_top_k``, ties by the lower id included: the bound has
slack for rounding, and a bound equal to the k-th score is not skipped.

Edge cases: null ids and vectors are left out, and uneven lengths raise; a NaN score never
counts, and a block with a vector that is not finite is never skipped. Corpus rows repeated
under one id are candidates one by one, as in ``retrieve_top_k``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .retrieve import _arrow_type, _collect_block, _make_kernel, rank_within, retrieve_top_k

BLOCK_BYTES = 1 << 20
# Bytes of request vectors and places that are broadcast.
DEFAULT_BROADCAST_BYTES = 128 << 20
MAX_LEADERS = 4096
_BLOCK = "block long, n int, ids binary, vectors binary, centre binary, radius double"


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(ids: np.ndarray, vectors: np.ndarray):
    with np.errstate(invalid="ignore", over="ignore"):
        centre = vectors.mean(axis=0)
        radius = float(np.sqrt(((vectors - centre) ** 2).sum(axis=1)).max())
    if not np.isfinite(radius):  # never skipped
        centre, radius = np.zeros(vectors.shape[1]), float("inf")
    return len(ids), ids.tobytes(), vectors.tobytes(), centre.tobytes(), radius


def build_index(corpus: DataFrame, path: str, *, id_col: str = "corpus_id", vector_col: str = "embedding",
                leaders: int | None = None, block_bytes: int = BLOCK_BYTES, mode: str = "errorifexists") -> DataFrame:
    """Write the blocks of ``corpus`` to ``path`` and return them.

    ``leaders`` (default: one for every four blocks, at most ``MAX_LEADERS``) decides how
    tight blocks are, never what is found. The exchange is a range one by (leader, id),
    so a leader with many vectors is split over tasks.
    """
    rows = corpus.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    rows = rows.filter("_id is not null and _v is not null")
    n, low, high = rows.agg(F.count("*"), F.min(F.size("_v")), F.max(F.size("_v"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} values")
    dim = max(1, high or 1)
    per_block = max(1, block_bytes // (8 * dim))
    if leaders is None:
        leaders = max(1, min(MAX_LEADERS, n // (4 * per_block)))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))
    chosen = rows.filter(finite).orderBy(F.xxhash64("_id"), "_id").limit(leaders).collect()  # at most MAX_LEADERS
    L = np.array([r._v for r in chosen], dtype=np.float64).reshape(-1, dim)
    half = (L * L).sum(axis=1) / 2

    def nearest(batches):
        for batch in batches:
            v = np.nan_to_num(_matrix(batch.column("_v"), dim), posinf=0, neginf=0)
            with np.errstate(over="ignore", invalid="ignore"):
                at = np.argmax(v @ L.T - half, axis=1) if len(L) else np.zeros(len(v), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], ["_at", "_id", "_v"])

    def pack(batches):
        at, ids, vectors, held = None, [], [], 0

        def done():
            return _packed(np.concatenate(ids), np.concatenate(vectors))

        for batch in batches:
            a = batch.column("_at").to_numpy()
            i, v = batch.column("_id").to_numpy(), _matrix(batch.column("_v"), dim)
            cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            for lo, hi in zip(cuts, cuts[1:]):
                while lo < hi:
                    if held and (a[lo] != at or held == per_block):
                        yield row(done())
                        ids, vectors, held = [], [], 0
                    take = min(hi - lo, per_block - held)
                    at = a[lo]
                    ids.append(i[lo:lo + take])
                    vectors.append(v[lo:lo + take])
                    held, lo = held + take, lo + take
        if held:
            yield row(done())

    def row(values):
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)],
                                          ["n", "ids", "vectors", "centre", "radius"])

    dealt = rows.mapInArrow(nearest, "_at int, _id long, _v array<double>")
    blocks = dealt.repartitionByRange("_at", "_id").sortWithinPartitions("_at", "_id").mapInArrow(
        pack, _BLOCK.split(", ", 1)[1])
    blocks.select(F.monotonically_increasing_id().alias("block"), "*").write.mode(mode).option(
        "parquet.block.size", str(16 * block_bytes)).parquet(path)
    return corpus.sparkSession.read.schema(_BLOCK).parquet(path)


def _bounds(Q, norms, centre, radius, slack):
    """The best score a block can hold, for each request."""
    c = np.frombuffer(centre)
    with np.errstate(invalid="ignore", over="ignore"):
        top = Q @ c + norms * radius
        top += slack + 1e-12 * (np.abs(top) + norms * (radius + np.sqrt(c @ c)))
    return np.where(np.isnan(top), np.inf, top)


def search_index(requests: DataFrame, blocks: DataFrame, k: int, *, request_col: str = "request_id",
                 vector_col: str = "embedding", digits: int | None = None,
                 broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, skipped=None) -> DataFrame:
    """``(request_id, corpus_id, score, rank)``: the k best of the whole index for every request.

    ``skipped``, an accumulator, counts the vectors times requests that were not scored.
    Requests above ``broadcast_bytes`` go through ``retrieve_top_k`` over the unpacked vectors.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = blocks.sparkSession
    id_type = requests.schema[request_col].dataType
    schema = T.StructType([T.StructField("request_id", id_type, False), T.StructField("corpus_id", T.LongType(), False),
                           T.StructField("score", T.DoubleType(), False)])
    rows = requests.select(F.col(request_col).alias("request_id"),
                           F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.filter("request_id is not null and embedding is not null")
    rows = materialize(rows.groupBy("request_id").agg(F.min("embedding").alias("embedding")), "requests")
    n, low, high = rows.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != high:
        raise ValueError(f"request vectors of {low} to {high} values")
    if not n:
        return spark.createDataFrame([], "request_id string, corpus_id long, score double, rank int").withColumn(
            "request_id", F.col("request_id").cast(id_type))
    sample = blocks.select("n", F.octet_length("centre").alias("c")).limit(1).collect()
    if sample and sample[0].c != 8 * high:
        raise ValueError(f"corpus vectors of {sample[0].c // 8} values, requests have {high}")
    if n * 8 * (high + 2 * k + 1) > broadcast_bytes:
        return retrieve_top_k(rows, _unpacked(blocks, high), k, digits=digits, broadcast_bytes=broadcast_bytes)
    ids, Q = _collect_block(rows, k, digits)
    norms = np.sqrt((Q * Q).sum(axis=1))
    slack = 0.0 if digits is None else 10.0 ** -digits
    sent = spark.sparkContext.broadcast((ids, Q, norms))
    _, topk, empty_state, flat = _make_kernel(k, digits)
    id_kind = _arrow_type(id_type)

    def best_blocks(batches):
        _, q, qn = sent.value
        best, at = np.full(len(q), -np.inf), np.full(len(q), -1, dtype=np.int64)
        for batch in batches:
            for b, c, r in zip(*(batch.column(x).to_pylist() for x in ("block", "centre", "radius"))):
                top = _bounds(q, qn, c, r, 0.0)
                better = top > best
                best[better], at[better] = top[better], b
        hit = np.flatnonzero(at >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(at[hit]), pa.array(best[hit])], ["r", "b", "s"])

    def scores(batches, wanted, floor):
        """The kernel over the blocks; ``wanted`` restricts a block to some requests, ``floor`` holds
        scores that each request is known to reach."""
        rids, q, qn = sent.value
        state, missed = empty_state(len(q)), 0
        for batch in batches:
            for b, m, i, v, c, r in zip(*(batch.column(x).to_pylist()
                                          for x in ("block", "n", "ids", "vectors", "centre", "radius"))):
                if wanted is not None:
                    sub = wanted.value.get(b)
                else:
                    least = np.maximum(floor.value, state[0][:, -1])
                    sub = np.flatnonzero(_bounds(q, qn, c, r, slack) >= least)
                missed += m * (len(q) - len(sub))
                if not len(sub):
                    continue
                V, ci = np.frombuffer(v).reshape(m, -1), np.frombuffer(i, np.int64)
                if len(sub) == len(q):
                    topk(q, V, ci, state)
                else:
                    part = state[0][sub], state[1][sub]
                    topk(q[sub], V, ci, part)
                    state[0][sub], state[1][sub] = part
        if wanted is None and skipped is not None:
            skipped.add(missed)
        r, i, s = flat(state)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(rids[r], id_kind) if wanted is None else pa.array(r),
                                              pa.array(i, pa.int64()), pa.array(s, pa.float64())],
                                             ["request_id", "corpus_id", "score"])

    best = blocks.select("block", "centre", "radius").mapInArrow(best_blocks, "r long, b long, s double")
    best = best.groupBy("r").agg(F.max_by("b", "s").alias("b")).collect()  # one row a request
    groups: dict[int, list] = {}
    for row in best:
        groups.setdefault(row.b, []).append(row.r)
    wanted = spark.sparkContext.broadcast({b: np.sort(np.array(r)) for b, r in groups.items()})
    names = spark.createDataFrame([(b,) for b in groups], "block long")
    first = blocks.join(F.broadcast(names), "block").mapInArrow(
        lambda x: scores(x, wanted, None), "request_id long, corpus_id long, score double")
    reached = rank_within(first, "request_id", [F.desc("score"), F.asc("corpus_id")], k).filter(F.col("rank") == k)
    floor = np.full(len(Q), -np.inf)
    for row in reached.select("request_id", "score").collect():  # at most one row a request
        floor[row.request_id] = row.score
    wanted.unpersist()
    floors = spark.sparkContext.broadcast(floor)
    found = blocks.mapInArrow(lambda x: scores(x, None, floors), schema)
    return rank_within(found, "request_id", [F.desc("score"), F.asc("corpus_id")], k)


def _unpacked(blocks: DataFrame, dim: int) -> DataFrame:
    def fn(batches):
        for batch in batches:
            for i, v in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist()):
                flat = np.frombuffer(v)
                ends = pa.array(np.arange(0, len(flat) + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(i, np.int64)), pa.ListArray.from_arrays(ends, pa.array(flat))],
                    ["corpus_id", "embedding"])

    return blocks.select("ids", "vectors").mapInArrow(fn, "corpus_id long, embedding array<double>")
