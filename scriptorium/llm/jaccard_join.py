"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Shingles are five consecutive words (a shorter text is one shingle). Texts of equal
word sequences are one class and enter once. Each representative gets a label of
``LABEL`` 16-bit MinHash values in each of ``TREES`` trees.

1. The labels of all trees are sorted by range (with the id, so that a label shared by
   very many texts is split too); in this order each tree's prefix trie is laid out,
   and the longest prefix that a text shares with any other is the one it shares
   with a neighbour. The matched prefix starts at the whole label and is shortened
   until the chance to find a pair at the threshold, 1 - (1 - t^d)^trees, reaches the
   target recall. Neighbours that share that prefix are linked: at most one link per
   text and tree, and the texts below a trie node hang together.
2. The connected candidates are verified exactly, all pairs, on their shingle sets. A set
   of candidates above a bound of texts or words is cut into chunks and each pair of
   chunks is a task of its own, so memory is bounded; a tile gives one row per
   text (its number of links, and the smallest text it hangs together with), not
   its pairs.
3. The classes are the connected components of the verified links.

Edge cases: texts without words (null, empty, white space) link to nothing; a row
repeated counts as a further copy; a row without an id is returned with its own
null class and no links; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (BROADCAST_ROWS, broadcast_if_small, components, helper_names, id_text, runs_of, save,
                     text_chunks)
from .words import U, Words, mix, shingles

SIZE = 5
THRESHOLD = 0.8
TREES = 24
LABEL = 8
TARGET = 0.9999
#: A chunk of candidates: texts, and words.
CHUNK_TEXTS = 256
CHUNK_WORDS = 400_000
_VALUE = 2  # bytes


def matched_prefix(threshold: float = THRESHOLD, trees: int = TREES, label: int = LABEL,
                   target: float = TARGET) -> int:
    """The longest prefix that finds a pair at the threshold with the target recall."""
    depth = label
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def _word_digest(text: bytes) -> bytes:
    return hashlib.sha256(b" ".join(text.split())).digest()


def _labels(batches, size, trees, label):
    factors = mix(np.arange(1, trees * label + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    for batch, texts in text_chunks(batches):
        words = Words(texts)
        codes, n = shingles(words, size)
        has = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[has]
        out = np.zeros((len(has), trees * label), dtype=">u2")
        if len(has):
            work = np.empty_like(codes)
            for i, f in enumerate(factors):
                np.multiply(codes, f, out=work)
                out[:, i] = (mix(np.minimum.reduceat(work, first)) >> U(48)).astype(np.uint16)
        labels = [None] * len(texts)
        for k, row in zip(has.tolist(), out, strict=True):
            labels[k] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(words.n, pa.int64()),
             pa.array([_word_digest(t) for t in texts], pa.binary()),
             pa.array(labels, pa.binary())], ["_id", "_words", "_key", "_labels"])


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading values that rows of two label matrices share."""
    return np.cumprod(a == b, axis=1).sum(axis=1)


def _neighbours(batches, depth, label):
    """Links between sorted neighbours; the partition's first and last row as well (kind 1, 2)."""
    part, before, tail = TaskContext.get().partitionId(), None, None

    def rows(kind, tree, lab, a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, part), pa.int32()), pa.array(tree, pa.int32()),
             pa.array(lab, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
            ["kind", "part", "tree", "label", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column("_tree").to_numpy(zero_copy_only=False)
        ids = batch.column("_node").to_numpy(zero_copy_only=False)
        raw = batch.column("_label").to_pylist()
        values = np.frombuffer(b"".join(raw), dtype=np.uint16).reshape(-1, label)
        if before is None:
            yield rows(1, tree[:1], raw[:1], ids[:1], ids[:1])
        else:
            tree, ids = np.concatenate((before[0], tree)), np.concatenate((before[1], ids))
            values = np.concatenate((before[2], values))
        link = np.flatnonzero((tree[1:] == tree[:-1]) & (_shared(values[1:], values[:-1]) >= depth))
        if len(link):
            yield rows(0, tree[link], [None] * len(link), ids[link], ids[link + 1])
        before = tree[-1:], ids[-1:], values[-1:]
        tail = raw[-1:]
    if before is not None:
        yield rows(2, before[0], tail, before[1], before[1])


def candidate_links(reps: DataFrame, depth: int, trees: int = TREES, label: int = LABEL) -> DataFrame:
    """``(a, b)``: neighbours in a sorted trie that share ``depth`` values."""
    width = label * _VALUE
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    laid = reps.select("_node", "_labels", tree.alias("_tree")).select(
        "_node", "_tree", F.expr(f"substring(_labels, _tree * {width} + 1, {width})").alias("_label"))
    order = ["_tree", "_label", "_node"]
    found = save(laid.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda b: _neighbours(b, depth, label),
        "kind int, part int, tree int, label binary, a long, b long"), "trie-links")
    across, last = [], None
    for r in found.filter("kind > 0").orderBy("part", "kind").collect():  # two rows per partition
        if r.kind == 1 and last is not None and last.tree == r.tree and _shared(
                np.frombuffer(last.label, np.uint16)[None], np.frombuffer(r.label, np.uint16)[None])[0] >= depth:
            across.append((last.a, r.a))
        last = r
    links = found.filter("kind = 0").select("a", "b")
    return links.union(reps.sparkSession.createDataFrame(across, "a long, b long")) if across else links


def _verify(ids, copies, side, texts, size, threshold):
    """Links, and the smallest id hanging together, of the texts of one tile."""
    codes, n = shingles(Words(texts), size)
    doc = np.repeat(np.arange(len(ids)), n)
    order = np.lexsort((codes, doc))
    doc, codes = doc[order], codes[order]
    once = runs_of([doc, codes])
    doc, codes = doc[once], codes[once]
    sizes = np.bincount(doc, minlength=len(ids)).astype(np.float64)
    _, column, times = np.unique(codes, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    doc, column = doc[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    both = np.zeros((len(ids), len(ids)))
    width = 4096
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (start, start + width))
        block = np.zeros((len(ids), width), dtype=np.float32)
        block[doc[a:b], column[a:b] - start] = 1
        both += block @ block.T
    linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    linked &= (both > 0) & ~np.eye(len(ids), dtype=bool)
    if side.any():
        linked &= side[:, None] != side[None, :]
    near = ids.copy()
    while True:  # the smallest id spreads along the links
        least = np.minimum(near, np.where(linked, near[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == near).all():
            return linked @ copies, near
        near = least


def _tiles(batches, size, threshold):
    """Groups of rows with equal tile, also across batches, one at a time."""
    held, key = [], None
    names = ["_root", "_i", "_j"]

    def done():
        rows = {r["_id"]: r for r in held if _word_digest(r["_text"].encode()) == r["_key"]}  # repeated rows once
        ids = np.array(sorted(rows), dtype=np.int64)
        rows = [rows[i] for i in ids.tolist()]
        side = np.array([r["_i"] != r["_j"] and r["_chunk"] == r["_j"] for r in rows])
        links, near = _verify(ids, np.array([r["_copies"] for r in rows], dtype=np.int64), side,
                              [r["_text"].encode() for r in rows], size, threshold)
        return ids, links, near, np.full(len(ids), held[0]["_chunks"])

    def batch_of(parts):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)],
            ["_id", "links", "near", "chunks"])

    out, n = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in names)
            if now != key:
                if held:
                    out.append(done())
                    n += len(out[-1][0])
                held, key = [], now
                if n > 5000:
                    yield batch_of(out)
                    out, n = [], 0
            held.append(row)
    if held:
        out.append(done())
    if out:
        yield batch_of(out)


def verified(texts: DataFrame, reps: DataFrame, links: DataFrame, size: int, threshold: float) -> DataFrame:
    """``(_id, links, near, chunks)`` per representative (its ``_node``) and tile."""
    groups = components(links, "candidates")
    members = save(groups.join(reps, groups["node"] == reps["_node"]).select(
        "node", "root", "_rep", "_key", "_copies", "_words"), "members")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(
        F.count("*") / CHUNK_TEXTS, F.sum("_words") / CHUNK_WORDS)).cast("int").alias("_chunks"))
    members = save(members.join(sizes, "root").select(
        F.col("node").alias("_node"), F.col("root").alias("_root"), "_rep", "_key", "_copies", "_chunks",
        F.pmod(F.xxhash64("node"), "_chunks").cast("int").alias("_chunk")), "chunks")
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    # An id may come with several texts: the tile keeps the one whose digest is the member's.
    rows = texts.join(broadcast_if_small(members), F.col("_id") == F.col("_rep")).select(
        F.col("_node").alias("_id"), "_text", "_key", "_copies", "_root", "_chunks", "_chunk", other.alias("_o"))
    tile = ["_root", "_i", "_j"]
    rows = rows.select("_id", "_text", "_key", "_copies", "_chunks", "_chunk", "_root",
                       F.least("_chunk", "_o").alias("_i"), F.greatest("_chunk", "_o").alias("_j"))
    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(
        lambda b: _tiles(b, size, threshold), "_id long, links long, near long, chunks long")


def _classified(docs: DataFrame, size: int, threshold: float, trees: int, label: int, target: float, id_col: str,
                text_col: str) -> DataFrame:
    """``jaccard_classes`` with the word digest ``_key`` of each row."""
    texts = id_text(docs, id_col, text_col)
    rows = save(texts.mapInArrow(lambda b: _labels(b, size, trees, label),
                                 "_id long, _words long, _key binary, _labels binary"), "labels")
    known = rows.filter("_id is not null and _labels is not null")
    # Texts are nodes under a number of their own: one id may come with several texts.
    reps = save(known.groupBy("_key").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies"),
                                          F.first("_words").alias("_words"), F.first("_labels").alias("_labels"))
                .withColumn("_node", F.monotonically_increasing_id()), "representatives")
    depth = matched_prefix(threshold, trees, label, target)
    tiles = save(verified(texts, reps, candidate_links(reps, depth, trees, label), size, threshold), "tiles")
    joined = tiles.filter("chunks > 1 and near <> _id").select(F.col("_id").alias("a"), F.col("near").alias("b"))
    roots = components(joined, "classes").select(F.col("node").alias("_node"), "root")
    near = tiles.groupBy(F.col("_id").alias("_node")).agg(F.sum("links").alias("_links"), F.min("near").alias("_near"))
    linked = save(near.join(roots, "_node", "left").join(reps.select("_node", "_rep"), "_node").select(
        "_node", "_links", "_rep", F.coalesce("root", "_near").alias("_root")), "linked-texts")
    least = linked.groupBy("_root").agg(F.min("_rep").alias("_least"))
    named = linked.join(least, "_root").select("_node", "_links", "_least")
    per_rep = reps.select("_key", "_node", "_rep", "_copies").join(named, "_node", "left").select(
        "_key", "_rep", F.coalesce("_least", "_rep").alias("_class"),
        (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_n"))
    out = known.select("_id", "_key").join(per_rep, "_key").select(
        "_id", F.col("_rep").alias("copy_id"), F.col("_class").alias("class_id"), F.col("_n").alias("n_links"), "_key")
    alone = rows.filter("_id is null or _labels is null").select(
        "_id", F.col("_id").alias("copy_id"), F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        "_key")
    return out.union(alone)


def jaccard_classes(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, trees: int = TREES,
                    label: int = LABEL, target: float = TARGET, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: ``_id, copy_id, class_id, n_links``.

    ``copy_id`` is the smallest id with the same words, ``class_id`` the smallest id of
    the connected component, ``n_links`` the number of other documents with a
    similarity of at least ``threshold`` (copies counted one by one). Rows with one id and
    different texts are separate documents here.
    """
    return _classified(docs, size, threshold, trees, label, target, id_col, text_col).drop("_key")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: the smallest id of each class.

    Rows are dropped by id and words, so that another text under the same id is judged for itself.
    """
    classes = _classified(docs, SIZE, THRESHOLD, TREES, LABEL, TARGET, id_col, text_col)
    drop = save(classes.filter("class_id <> _id").select("_id", "_key").distinct(), "near-copies")
    names = helper_names(docs, "_id", "_key")
    words = F.trim(F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), r"[\x20\x09-\x0D]+", " "))
    # Digests are taken only of rows whose id is dropped: a condition on pairs, not a join key.
    same = F.coalesce(F.unhex(F.sha2(words.cast("binary"), 256)) == F.col(names[1]), F.lit(False))
    small = drop.saved_rows <= BROADCAST_ROWS
    drop = F.broadcast(drop.toDF(*names)) if small else drop.toDF(*names)
    return docs.join(drop, (docs[id_col].cast("long") == F.col(names[0])) & same, "left_anti")
