"""Substring dedup with a count-min prefilter.

A word is removed when a window of ``window`` words that covers it also starts
earlier (smaller id, or earlier in the same text).

0. A text whose word sequence also has a smaller id loses every word (none below
   ``window`` words) and adds no first start, so the passes below skip it.
1. Each task counts, in a count-min sketch of two rows of 2^27 saturating cells, the
   anchor of every window: its leftmost smallest ``anchor``-word code. Equal windows have
   equal anchors at equal offsets, so an anchor's count is never below the count of
   any window on it. A task's sketch is sent as the cells it touched; the parts are
   merged by block of 2^16 cells, and what remains is one bit per cell (touched twice
   or more): 32 MB whatever the input, broadcast to the second pass.
2. Only windows whose anchor is estimated repeated go on, with a 128-bit code. Copies
   within a slice are settled there and go on under a key of their own; of the others
   the first start per code wins by an ordinary window function. A fuller sketch lets more windows through, and
   never loses one: the result is exact at any size.

Edge cases: texts below ``window`` words (also null and empty ones) lose nothing; a
row repeated with the same id and text counts as one text and is returned as often
as it came; rows without an id are returned whole and count for no other row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, id_text, runs_of, save, text_chunks
from .words import U, Words, least_in_window, mix

WINDOW = 20
ANCHOR = 10
CELL_BITS = 27
BLOCK_BITS = 16
ROWS = 2
_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd
_BLOCKS = 1 << (CELL_BITS - BLOCK_BITS)
_FLUSH = 1 << 21


def _anchors(words: Words, codes: np.ndarray, window: int, anchor: int):
    """Start of each whole window, and the word its anchor starts at, with all anchor codes."""
    keys = words.windows(codes, anchor)
    starts = np.flatnonzero(words.whole(window))
    return starts, starts + least_in_window(keys, window - anchor + 1)[starts], keys


def _cells(keys: np.ndarray, row: int) -> np.ndarray:
    return ((keys * U(_MULTIPLIERS[row])) >> U(64 - CELL_BITS)).astype(np.int64) + (row << CELL_BITS)


def _sketch_rows(cells: list[np.ndarray]):
    """The touched cells as one row per block: once-touched and more often touched cells."""
    cell, count = np.unique(np.concatenate(cells), return_counts=True)
    block = (cell >> BLOCK_BITS).astype(np.int32)
    low, often = cell.astype(np.uint16), count > 1
    cuts = np.flatnonzero(runs_of([block]))
    names, once, more = [], [], []
    for a, b in zip(cuts, [*cuts[1:], len(cell)], strict=True):
        names.append(int(block[a]))
        once.append(low[a:b][~often[a:b]].tobytes())
        more.append(low[a:b][often[a:b]].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(once, pa.binary()),
                                       pa.array(more, pa.binary())], ["block", "once", "more"])


def _sketch(batches, window, anchor):
    held, n = [], 0
    for _, texts in text_chunks(batches):
        words = Words(texts)
        starts, at, keys = _anchors(words, words.codes(), window, anchor)
        if len(starts):
            keys = keys[np.unique(at)]
            held += [_cells(keys, r) for r in range(ROWS)]
            n += ROWS * len(keys)
        if n >= _FLUSH:
            yield _sketch_rows(held)
            held, n = [], 0
    if held:
        yield _sketch_rows(held)


def _merge(batches):
    """Saturating counts of the blocks of one partition; yields their repeated cells as bits."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, more in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "more")), strict=True):
            c = counts.setdefault(block, np.zeros(1 << BLOCK_BITS, dtype=np.uint8))
            one, two = np.frombuffer(once, np.uint16), np.frombuffer(more, np.uint16)
            c[one] = np.minimum(c[one] + 1, 2)
            c[two] = 2
    for block, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()),
                                          pa.array([np.packbits(c > 1).tobytes()], pa.binary())], ["block", "bits"])


def repeated_cells(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The merged sketch as bits (a cell touched twice or more); fixed 32 MB."""
    parts = texts.mapInArrow(lambda b: _sketch(b, window, anchor), "block int, once binary, more binary")
    merged = parts.repartition("block").mapInArrow(_merge, "block int, bits binary")
    bits = np.zeros((ROWS * _BLOCKS, (1 << BLOCK_BITS) // 8), dtype=np.uint8)
    for row in merged.collect():  # at most ROWS * 2^11 rows of 8 KB
        bits[row.block] = np.frombuffer(row.bits, np.uint8)
    return bits.reshape(-1)


def _estimated_repeated(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), dtype=bool)
    for r in range(ROWS):
        cell = _cells(keys, r)
        hit &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return hit


def _candidates(batches, bits, window, anchor):
    """Windows estimated repeated; ``later`` if an equal one starts earlier in this slice."""
    for batch, texts in text_chunks(batches):
        words = Words(texts)
        codes = words.codes()
        starts, at, keys = _anchors(words, codes, window, anchor)
        if not len(starts):
            continue
        starts = starts[_estimated_repeated(bits.value, keys)[at]]
        if not len(starts):
            continue
        h1 = words.windows(codes, window, 1)[starts]
        h2 = words.windows(words.codes(2), window, 3)[starts]
        doc = words.doc()[starts]
        pos = (starts - words.first[doc]).astype(np.int32)
        ids = batch.column("_id").to_numpy(zero_copy_only=False)[doc]
        order = np.lexsort((pos, ids, h2, h1))
        h1, h2, ids, pos = h1[order], h2[order], ids[order], pos[order]
        new = runs_of([h1, h2])
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        later = (ids != ids[head]) | (pos != pos[head])
        once = runs_of([h1, h2, ids, pos])  # a repeated row gives its window once
        h1 = np.where(later, mix(ids.view(U)), h1)  # settled: kept out of the code's group
        h2 = np.where(later, pos.astype(U), h2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[once]) for x in (h1.view(np.int64), h2.view(np.int64), ids, pos, later)],
            ["h1", "h2", "_id", "pos", "later"])


def _keys(batches):
    for batch, texts in text_chunks(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array([hashlib.sha256(b" ".join(t.split())).digest() for t in texts])],
            ["_id", "_key"])


def later_copies(texts: DataFrame) -> DataFrame:
    """``_copy_id``: ids of texts whose whole word sequence has a smaller id too."""
    keys = save(texts.mapInArrow(_keys, "_id long, _key binary"), "word-digests")
    first = keys.groupBy("_key").agg(F.min("_id").alias("f"), F.max("_id").alias("l")).filter("f < l")
    found = keys.join(first, "_key").filter("_id > f").select(F.col("_id").alias("_copy_id")).distinct()
    return save(found, "later-copies")


def later_windows(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(_id, pos)`` of every window that also starts earlier; ``texts`` has ``_id, _text``."""
    bits = texts.sparkSession.sparkContext.broadcast(repeated_cells(texts, window, anchor))
    found = texts.mapInArrow(lambda b: _candidates(b, bits, window, anchor),
                             "h1 long, h2 long, _id long, pos int, later boolean")
    first = Window.partitionBy("h1", "h2").orderBy("_id", "pos")
    return found.withColumn("r", F.rank().over(first)).filter("later or r > 1").select("_id", "pos")


def _cut(batches, window):
    for batch, texts in text_chunks(batches):
        total, removed, digest, kept_texts = [], [], [], []
        for text, at, copy in zip(texts, batch.column("_at").to_pylist(),
                                  batch.column("_copy_id").to_pylist(), strict=True):
            words = text.split()  # bytes: exactly the six white-space bytes
            if copy is not None and len(words) >= window:
                kept = []
            elif at:
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                starts = np.unique(np.asarray(at, dtype=np.int64))
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + window, -1)
                stay = np.cumsum(gone[:-1]) == 0
                kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            else:
                kept = words
            joined = b" ".join(kept)
            total.append(len(words))
            removed.append(len(words) - len(kept))
            kept_texts.append(joined)
            digest.append(hashlib.sha256(joined).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept_texts, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())],
            ["_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id, n_words, n_removed, kept_text, kept_sha256``."""
    rows = id_text(docs, id_col, text_col)
    texts = rows.filter("_id is not null")
    copies = broadcast_if_small(later_copies(texts))
    is_copy = F.col("_id") == F.col("_copy_id")
    spots = later_windows(texts.join(copies, is_copy, "left_anti"), window, anchor).groupBy("_id").agg(
        F.collect_set("pos").alias("_at"))  # at most one place per word of the text
    rows = rows.join(copies, is_copy, "left").join(spots, "_id", "left")
    return rows.mapInArrow(lambda b: _cut(b, window),
                           "_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
