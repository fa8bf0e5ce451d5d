"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. One scan writes
``(id, SHA-256 of the normalised text, code points)``; everything after works on
these small rows. A Misra-Gries summary (Spark's ``approx_top_k`` sketch keeps at
most ``max_items`` counters) names the candidates for frequent digests. Their rows
are counted exactly and their winners found by a partial aggregation, and the
verified winners, at most ``top_k`` rows, are broadcast, so the rows of a frequent
digest are never shuffled. All other digests use an ordinary shuffle.

Edge cases: a null text counts as empty and equals any text of white space only;
rows repeated with the same id are listed once each; a null id loses every tie and
is the ``keep_id`` only of a group without other ids; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, helper_names, id_text, save

SPACES = " \t\n\x0b\x0c\r"
TOP_K = 256
MAX_ITEMS = 8192


def _digest(text):
    return F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, _digest string, _n)`` of every row, stored once."""
    t = id_text(docs, id_col, text_col)
    return save(t.select("_id", _digest(F.col("_text")).alias("_digest"),
                         F.char_length("_text").cast("long").alias("_n")), "digests")


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest the row with most code points, then smallest id (nulls last), and the size."""
    order = F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("x"), F.col("_id").alias("i"))
    return rows.groupBy("_digest").agg(F.min(order).alias("_w"), F.count("*").alias("_size")).select(
        F.col("_digest").alias("_key"), F.col("_w.i").alias("_keep"), (-F.col("_w.n")).alias("_keep_n"), "_size")


def _labelled(rows: DataFrame, winners: DataFrame) -> DataFrame:
    kept = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_n") == F.col("_keep_n"))
    return rows.join(winners, F.col("_digest") == F.col("_key")).select(
        F.col("_id"), F.col("_keep"), F.col("_size"), kept.alias("_kept"), F.col("_digest"), F.col("_n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 top_k: int = TOP_K, max_items: int = MAX_ITEMS) -> DataFrame:
    """One row per document: ``_id, _keep, _size, _kept, _digest, _n``."""
    rows = digests(docs, id_col, text_col)
    found = rows.agg(F.expr(f"approx_top_k(_digest, {top_k}, {max_items})").alias("s"))
    heavy = found.select(F.explode("s").alias("e")).filter("e.count > 1").select(F.col("e.item").alias("_heavy"))
    heavy = save(heavy, "frequent-digests")  # at most top_k rows
    at_heavy = F.col("_digest") == F.col("_heavy")
    often = rows.join(F.broadcast(heavy), at_heavy, "left_semi")
    rest = rows.join(F.broadcast(heavy), at_heavy, "left_anti")
    winners = save(_winners(often), "frequent-winners")
    return _labelled(often, F.broadcast(winners)).unionByName(_labelled(rest, _winners(rest)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns.

    Rows are dropped by id, text and length, so that rows with one id and different texts
    are judged each for itself; of rows with the same id and text, all stay or none.
    """
    groups = exact_groups(docs, id_col, text_col)
    drop = save(groups.filter(~F.col("_kept")).select("_id", "_digest", "_n").distinct(), "exact-copies")
    names = helper_names(docs, "_id", "_digest", "_n")
    small = drop.saved_rows <= BROADCAST_ROWS
    drop = F.broadcast(drop.toDF(*names)) if small else drop.toDF(*names)
    text = F.coalesce(docs[text_col], F.lit(""))
    # The digest is taken only of rows whose id and length are dropped: a condition on pairs, not a join key.
    same = docs[id_col].cast("long").eqNullSafe(F.col(names[0])) & (F.char_length(text) == F.col(names[2]))
    return docs.join(drop, same & F.coalesce(_digest(text) == F.col(names[1]), F.lit(False)), "left_anti")
