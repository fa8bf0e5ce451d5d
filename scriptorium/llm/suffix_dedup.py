"""Repeated passages by a sparse suffix array.

Suffixes are kept only where the text selects them: at the leftmost smallest code of
``GRAM`` words among ``GAP`` consecutive ones (minimisers). Equal passages select equal
places, so every passage of ``GAP - 1 + PREFIX`` (50) words holds a kept suffix whose
first ``PREFIX`` (40) words lie inside it. The suffixes are sorted by range on the code
of these words, then id and place, so a passage that very many texts share is
split over partitions; each suffix is compared with its neighbour before it, and
equal neighbours give a match of the later one with the earlier one. A text's
matches on one diagonal are chained to runs, and each run is extended to the left
and to the right, word by word, against its neighbour's text. A passage that goes on
past ``GAP - 1`` more words has a further kept suffix there, so that many words bound
an extension.

Found: every passage of at least 50 words that also starts earlier (smaller id, or
earlier in the same text); reported are true repeats only, of at least 40 words. A
passage is reported up to both ends unless its neighbour, which may be another
text with the same 40 words, leaves it before: then up to ``GAP - 1`` words may stay
at that end.

Edge cases: shorter texts (null and empty ones too) have no repeats; rows repeated
with the same id and text count as one text; rows without an id are returned
without repeats and match no other row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, runs_of, save, text_chunks
from .words import Words, least_in_window

GRAM = 16
GAP = 11
PREFIX = 40


def _suffixes(batches, gram, gap, prefix):
    for batch, texts in text_chunks(batches):
        words = Words(texts)
        codes = words.codes()
        starts = np.flatnonzero(words.whole(max(prefix, gap - 1 + gram)))
        if not len(starts):
            continue
        at = np.unique(starts + least_in_window(words.windows(codes, gram, 1), gap)[starts])
        whole = words.whole(prefix)
        at = at[at < len(whole)]
        at = at[whole[at]]
        doc = words.doc()[at]
        ids = batch.column("_id").to_numpy(zero_copy_only=False)[doc]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words.windows(codes, prefix, 2)[at].view(np.int64)), pa.array(ids, pa.int64()),
             pa.array((at - words.first[doc]).astype(np.int32))], ["_h", "_id", "_pos"])


def _matches(batches):
    """Rows equal to the row before them (kind 0); a partition's first and last row (1, 2)."""
    part, before = TaskContext.get().partitionId(), None

    def rows(kind, h, ids, pos, ref, ref_pos):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, part), pa.int32()), pa.array(h, pa.int64()),
             pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(ref, pa.int64()),
             pa.array(ref_pos, pa.int32())], ["kind", "part", "h", "id", "pos", "ref", "ref_pos"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h, ids, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_h", "_id", "_pos"))
        once = runs_of([h, ids, pos])  # repeated rows
        h, ids, pos = h[once], ids[once], pos[once]
        if before is None:
            yield rows(1, h[:1], ids[:1], pos[:1], ids[:1], pos[:1])
        else:
            h, ids, pos = (np.concatenate((a, b)) for a, b in zip(before, (h, ids, pos), strict=True))
        same = np.flatnonzero((h[1:] == h[:-1]) & ((ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1])))
        if len(same):
            yield rows(0, h[same], ids[same + 1], pos[same + 1], ids[same], pos[same])
        before = h[-1:], ids[-1:], pos[-1:]
    if before is not None:
        yield rows(2, *before, before[1], before[2])


def neighbour_matches(texts: DataFrame, gram: int, gap: int, prefix: int) -> DataFrame:
    """``(id, pos, ref, ref_pos)``: kept suffixes that equal their neighbour in ``prefix`` words."""
    order = ["_h", "_id", "_pos"]
    kept = save(texts.mapInArrow(lambda b: _suffixes(b, gram, gap, prefix), "_h long, _id long, _pos int"), "suffixes")
    found = save(kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _matches, "kind int, part int, h long, id long, pos int, ref long, ref_pos int"), "matches")
    across, last = [], None
    for r in found.filter("kind > 0").orderBy("part", "kind").collect():  # two rows per partition
        if r.kind == 1 and last is not None and last.h == r.h and (last.id, last.pos) != (r.id, r.pos):
            across.append((r.id, r.pos, last.id, last.pos))
        last = r
    matches = found.filter("kind = 0").select("id", "pos", "ref", "ref_pos")
    if across:
        matches = matches.union(texts.sparkSession.createDataFrame(across, "id long, pos int, ref long, ref_pos int"))
    return matches


def chained(matches: DataFrame, prefix: int) -> DataFrame:
    """``(run, id, start, end, ref, ref_start)``: matches of one text on one diagonal that touch."""
    diagonal = ["id", "ref", F.col("ref_pos") - F.col("pos")]
    order = Window.partitionBy(*diagonal).orderBy("pos")  # one text's places
    new = F.coalesce(F.col("pos") > F.lag("pos").over(order) + prefix, F.lit(True)).cast("int")
    runs = (matches.withColumn("new", new).withColumn("n", F.sum("new").over(order))
            .groupBy("id", "ref", (F.col("ref_pos") - F.col("pos")).alias("d"), "n")
            .agg(F.min("pos").alias("start"), (F.max("pos") + prefix).alias("end")))
    return runs.select(F.struct("id", "ref", "d", "n").alias("run"), "id", "start", "end", "ref",
                       (F.col("start") + F.col("d")).alias("ref_start"))


def _contexts(batches, width):
    for batch in batches:
        out = []
        for text, asked in zip(batch.column("_text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            words = text.encode().split()
            for a in asked:
                out.append({"run": a["run"], "own": a["own"],
                            "left": [w.decode() for w in words[max(0, a["a"] - width):a["a"]]],
                            "right": [w.decode() for w in words[a["b"]:a["b"] + width]]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
            ("run", pa.struct([("id", pa.int64()), ("ref", pa.int64()), ("d", pa.int32()), ("n", pa.int64())])),
            ("own", pa.bool_()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))


@F.pandas_udf(T.IntegerType())
def _equal_ahead(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of leading words that two lists share."""
    out = []
    for x, y in zip(a, b, strict=True):
        n = 0
        if x is not None and y is not None:
            while n < min(len(x), len(y)) and x[n] == y[n]:
                n += 1
        out.append(n)
    return pd.Series(out, dtype="int32")


def extended(runs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``(_id, start, end)`` of the runs, extended by up to ``width`` words on both sides."""
    length = F.col("end") - F.col("start")
    asked = runs.select(F.explode(F.array(
        F.struct(F.col("id").alias("t"), "run", F.lit(True).alias("own"),
                 F.col("start").alias("a"), F.col("end").alias("b")),
        F.struct(F.col("ref").alias("t"), "run", F.lit(False).alias("own"),
                 F.col("ref_start").alias("a"), (F.col("ref_start") + length).alias("b")))).alias("q")).select("q.*")
    asked = asked.groupBy("t").agg(F.collect_list(F.struct("run", "own", "a", "b")).alias("asked"))  # one text's runs
    schema = "run struct<id:long,ref:long,d:int,n:long>, own boolean, left array<string>, right array<string>"
    around = texts.join(asked, F.col("_id") == F.col("t")).select("_text", "asked").mapInArrow(
        lambda b: _contexts(b, width), schema)

    def side(own, col):
        return F.max(F.when(F.col("own") == own, F.col(col)))

    both = around.groupBy("run").agg(side(True, "left").alias("l"), side(False, "left").alias("rl"),
                                     side(True, "right").alias("r"), side(False, "right").alias("rr"))
    more = both.select("run", _equal_ahead(F.reverse("l"), F.reverse("rl")).alias("more_left"),
                       _equal_ahead("r", "rr").alias("more_right"))
    return runs.join(more, "run").select(F.col("id").alias("_id"), (F.col("start") - F.col("more_left")).alias("start"),
                                         (F.col("end") + F.col("more_right")).alias("end"))


def repeated_passages(docs: DataFrame, gram: int = GRAM, gap: int = GAP, prefix: int = PREFIX,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id, n_removed, spans`` (word ranges, disjoint and sorted)."""
    texts = id_text(docs, id_col, text_col)
    known = texts.filter("_id is not null")
    runs = save(chained(neighbour_matches(known, gram, gap, prefix), prefix), "runs")
    spans = extended(runs, known, gap - 1)
    spans = spans.groupBy("_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))

    def merge(acc, x):
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.get(acc, F.size(acc) - 1)["end"]),
                      F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))
                      ).otherwise(F.concat(acc, F.array(x)))

    kind = "array<struct<start:int,end:int>>"
    spans = spans.select(F.col("_id").alias("_sid"), F.aggregate(
        F.col("s").cast(kind), F.expr(f"cast(array() as {kind})"), merge).alias("spans"))
    rows = texts.select("_id").join(spans, F.col("_id") == F.col("_sid"), "left")
    spans = F.coalesce("spans", F.expr(f"cast(array() as {kind})"))
    return rows.select("_id", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
                       .alias("n_removed"), spans.alias("spans"))


def without_passages(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, kept_text``: the words outside ``spans`` (from ``repeated_passages``), joined by one space."""
    rows = id_text(docs, id_col, text_col).join(
        spans.filter("_id is not null").select(F.col("_id").alias("_sid"), "spans").distinct(),
        F.col("_id") == F.col("_sid"), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            words, kept, at = t.encode().split(), [], 0
            for x in s if s is not None else ():
                kept += words[at:x["start"]]
                at = x["end"]
            out.append(b" ".join(kept + words[at:]).decode())
        return pd.Series(out, dtype=object)

    return rows.select("_id", cut("_text", "spans").alias("kept_text"))
