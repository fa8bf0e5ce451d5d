"""Equi-joins whose left side may hold one key in a third of all rows.

``lookup_join`` measures the right side: when it fits whole, it is broadcast. Else the
frequent keys of the left side are found with a frequency sketch (a bounded summary per
task, merged), the right rows of those keys are broadcast as far as their measured bytes
fit, and everything else is joined by an ordinary shuffle. Rows of a frequent key then stay
in the tasks they are in; the result is that of the plain join either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: At most so many keys are treated as frequent, found among so many counters of a sketch.
TOP_KEYS, SKETCH_ITEMS = 256, 8192
#: Right rows of frequent keys that are broadcast, in bytes of ``row_bytes``.
BROADCAST_BYTES = 32 << 20


def frequent_keys(df: DataFrame, key: Column, top: int = TOP_KEYS, items: int = SKETCH_ITEMS,
                  least: int = 2) -> DataFrame:
    """``(_hot long, _times)``: codes of the keys that occur most often, stored; at most ``top`` rows."""
    found = df.select(key.alias("_code")).agg(F.expr(f"approx_top_k(_code, {top}, {items})").alias("s"))
    rows = found.select(F.explode("s").alias("e")).select(F.col("e.item").alias("_hot"), F.col("e.count").alias("_times"))
    return materialize(rows.filter(F.col("_times") >= least), "frequent-keys")


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", *, top: int = TOP_KEYS,
                least: int = 2, row_bytes: Column | None = None, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``left`` joined to ``right`` on ``on`` (``inner`` or ``left``), safe for frequent keys of ``left``.

    Both sides are read more than once: pass stored tables. ``row_bytes`` estimates the
    size of a right row (100 bytes when not given); of the frequent keys those that occur
    most are broadcast while they fit in ``limit_bytes``, the rest join by a shuffle,
    where adaptive execution may still split them.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    size = (row_bytes if row_bytes is not None else F.lit(100)).cast("long")
    if (right.agg(F.sum(size)).first()[0] or 0) <= limit_bytes:
        return left.join(F.broadcast(right), on, how)
    code = F.xxhash64(*on)
    hot = frequent_keys(left, code, top, least=least)
    first = right.select("*", code.alias("_code"), size.alias("_size"))
    first = first.join(F.broadcast(hot), F.col("_code") == F.col("_hot"))
    # All rows of a key go together; at most ``top`` keys are left for this window.
    keys = first.groupBy("_hot", "_times").agg(F.sum("_size").alias("_size"))
    fits = F.sum("_size").over(Window.orderBy(F.desc("_times"), "_hot")) <= limit_bytes
    kept = materialize(keys.withColumn("_fits", fits).filter("_fits").select("_hot"), "broadcast-keys")
    small = materialize(first.join(F.broadcast(kept), "_hot", "left_semi").drop("_code", "_hot", "_times", "_size"),
                        "frequent-rows")
    at_hot = code == F.col("_hot")
    often = left.join(F.broadcast(kept), at_hot, "left_semi").join(F.broadcast(small), on, how)
    rest = left.join(F.broadcast(kept), at_hot, "left_anti").join(right, on, how)
    return often.unionByName(rest)
