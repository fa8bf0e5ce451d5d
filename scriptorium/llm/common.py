"""Helpers shared by the operators of this subpackage.

Tables: every operator reads only the columns it names, so extra columns (also
ones that clash with an output name) never matter. Text that is null counts as
empty. A row without an id cannot be linked to another row; each operator's
docstring says what it returns for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize, small_batches

#: Rows of a side that may be broadcast after they were counted (16 to 64 bytes each).
BROADCAST_ROWS = 2_000_000


def save(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back (cuts the lineage).

    The rows are counted while they are written, for ``broadcast_if_small``.
    """
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    out.saved_rows = seen.get["rows"]
    return out


def broadcast_if_small(saved: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a stored table of at most ``rows`` rows, else the table.

    Both plans give the same rows; beyond the bound Spark joins by shuffling.
    """
    n = getattr(saved, "saved_rows", None)
    if n is None:
        n = saved.limit(rows + 1).count()
    return F.broadcast(saved) if n <= rows else saved


def helper_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores more as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id`` (long) and ``_text`` (null becomes empty)."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def text_chunks(batches: Iterator[pa.RecordBatch], id_name: str = "_id", text_name: str = "_text",
                limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about ``limit`` bytes of text (one row at least).

    Texts of any length are whole; the working arrays of a slice stay bounded.
    """
    for batch in batches:
        column = batch.column(text_name).cast(pa.binary())
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False) + 1)
        start, done = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start), column.slice(start, stop - start).to_pylist()
            start, done = stop, int(ends[stop - 1])


def runs_of(order_keys: list[np.ndarray]) -> np.ndarray:
    """True where a row of sorted key columns differs from the row before it."""
    n = len(order_keys[0])
    new = np.ones(n, dtype=bool)
    if n > 1:
        same = np.ones(n - 1, dtype=bool)
        for k in order_keys:
            same &= k[1:] == k[:-1]
        new[1:] = ~same
    return new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as ``(u, v)``: every node but the smallest of its part, and that one."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not held:
        return
    nodes, at = np.unique(np.concatenate([x for pair in held for x in pair]), return_inverse=True)
    sizes = np.cumsum([len(x) for pair in held for x in pair])[:-1]
    parts = np.split(at, sizes)
    a, b = np.concatenate(parts[0::2]), np.concatenate(parts[1::2])
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (root[a], root[b]):  # roots are linked to smaller roots, then paths are halved
            np.minimum.at(new, end, low)
        while not (new[new] == new).all():
            new = new[new]
        if (new == root).all():
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["u", "v"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)``: the smallest node of each connected component.

    ``edges`` has long columns ``a`` and ``b``. Each task first joins up the edges it has
    (a partition's nodes in memory). Then large-star and small-star steps
    alternate until nothing changes; both are joins against a per-node minimum
    that Spark sums up before it shuffles, so a hub needs no list of its
    neighbours. Each round is a stored table. Nodes without an edge are absent.
    """
    cur = save(edges.filter("a <> b").select("a", "b").mapInArrow(_contracted, "u long, v long").distinct(), name)
    state = None
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: larger neighbours of a node are linked to the node's minimum.
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours and the node itself go to the minimum of those.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u <> v").distinct()
        seen = Observation()
        cur = save(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"),
                                 F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
        now = tuple(seen.get[k] for k in "nsh")
        if now == state:
            break
        state = now
    roots = cur.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    own = roots.select(F.col("root").alias("node"), F.col("root")).distinct()
    return roots.union(own)
