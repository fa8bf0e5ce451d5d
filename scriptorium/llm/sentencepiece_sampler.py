"""SentencePiece encoding by sampling, and lossless decoding.

The pieces and scores come from a public ``.model`` file (its path is a parameter; the
driver reads it and ships its bounded bytes). A text becomes a dummy space plus the
text with spaces written as U+2581; its lattice has one edge per piece and place,
weighted ``exp(alpha * score)``, and one byte-fallback edge for a character that is no
piece (a literal U+2581 too, so that decoding is exact). No piece crosses the cut
before a run of spaces, nor a character that occurs in no longer piece, so the
lattice splits there into units.

Forward filtering sums the weights of all ways to each place, once per distinct
unit of a slice; backward sampling then draws one piece at a time for every
occurrence, from the end of its unit, with probability (ways to the piece's start) *
(its weight) / (ways to its end). The random numbers are a function of (seed, row
key, place in the text) alone: the same row gives the same pieces whatever the
partitioning, and other rows with the same text other ones.

Edge cases: null and empty texts give no ids and decode to the empty text; a null
key is a key of its own; a repeated row gives the same ids; any Unicode text comes
back unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_chunks
from .words import U, char_powers, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1e-3
SEED = 17
#: Pieces that no merge produces (spaces) score below this; they weigh as much as the least other piece.
UNUSABLE = -1e8
_SPACE, _MARK, _LITERAL = 0x20, 0x2581, 0x110000
_NULL_KEY = 0x5EED
_BITS = 20
_STEP = 0xD1B54A32D192ED03


class Lattice:
    """The piece trie as a hash table over prefixes, and sampling over slices of texts."""

    def __init__(self, model: bytes, alpha: float = ALPHA, seed: int = SEED):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.seed, self.byte_id = seed, np.zeros(256, dtype=np.int64)
        pieces, self.spelled = {}, []
        for i in range(sp.get_piece_size()):
            name, score = sp.id_to_piece(i), sp.get_score(i)
            raw = b""
            if sp.is_byte(i):
                raw = bytes([int(name[3:5], 16)])
                self.byte_id[raw[0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = name.replace("▁", " ").encode()
                pieces[name] = i, score
            self.spelled.append(raw)
        least = min(s for _, s in pieces.values() if s > UNUSABLE)
        self.fallback = alpha * (least - 10)
        self.n = len(self.spelled)
        self.weight = np.zeros(self.n)
        for i, s in pieces.values():
            self.weight[i] = alpha * max(s, least)
        self.longest = max(map(len, pieces))
        self.joins = np.zeros(_LITERAL + 1, dtype=bool)  # characters of longer pieces
        for name in pieces:
            if len(name) > 1:
                self.joins[[ord(c) for c in name]] = True
        self._fill(pieces)

    def _codes(self, points: np.ndarray):
        """Prefix sums from which any substring's code is one difference."""
        up, down = char_powers(len(points))
        sums = np.zeros(len(points) + 1, dtype=U)
        np.cumsum(mix(points.astype(U) + U(1)) * up, out=sums[1:])
        return sums, down

    def _fill(self, pieces):
        prefixes = {}
        for name, (i, _) in pieces.items():
            for k in range(1, len(name)):
                prefixes.setdefault(name[:k], -1)
        prefixes |= {name: i for name, (i, _) in pieces.items()}
        text = "".join(prefixes)
        sums, down = self._codes(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
        ends = np.cumsum([len(p) for p in prefixes])
        starts = np.concatenate(([0], ends[:-1]))
        codes = mix((sums[ends] - sums[starts]) * down[starts])
        self.slot_code = np.zeros(1 << _BITS, dtype=U)
        self.slot_piece = np.full(1 << _BITS, -2, dtype=np.int32)  # -2: empty, -1: only a prefix
        self.probes = 1
        for code, piece in zip(codes.tolist(), prefixes.values(), strict=True):
            at, tries = code >> (64 - _BITS), 1
            while self.slot_piece[at] != -2:
                at, tries = (at + 1) & ((1 << _BITS) - 1), tries + 1
            self.slot_code[at], self.slot_piece[at] = code, piece
            self.probes = max(self.probes, tries)

    def _lookup(self, codes: np.ndarray) -> np.ndarray:
        """Piece of each code; -1 a prefix only, -2 neither."""
        at = (codes >> U(64 - _BITS)).astype(np.int64)
        out = np.full(len(codes), -2, dtype=np.int32)
        open_ = np.arange(len(codes))
        for _ in range(self.probes):
            piece = self.slot_piece[at]
            hit = (self.slot_code[at] == codes[open_]) & (piece != -2)
            out[open_[hit]] = piece[hit]
            more = ~hit & (piece != -2)
            open_, at = open_[more], (at[more] + 1) & ((1 << _BITS) - 1)
            if not len(open_):
                break
        return out

    def _edges(self, points, end_of_unit):
        """All edges of the lattice: first place, length, piece (-1: fallback)."""
        sums, down = self._codes(points)
        alive, found = np.arange(len(points)), []
        single = np.zeros(len(points), dtype=bool)
        for size in range(1, self.longest + 1):
            alive = alive[alive + size <= end_of_unit[alive]]
            if not len(alive):
                break
            piece = self._lookup(mix((sums[alive + size] - sums[alive]) * down[alive]))
            is_piece = piece >= 0
            found.append((alive[is_piece], np.full(is_piece.sum(), size), piece[is_piece]))
            if size == 1:
                single[alive[is_piece]] = True
            alive = alive[piece != -2]
        rest = np.flatnonzero(~single)
        found.append((rest, np.ones(len(rest), dtype=np.int64), np.full(len(rest), -1, dtype=np.int32)))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        n_chars = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        raw = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), dtype=np.uint32)
        if not len(raw):
            return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        points = np.where(raw == _SPACE, np.uint32(_MARK), np.where(raw == _MARK, np.uint32(_LITERAL), raw))
        doc_end = np.cumsum(n_chars)
        doc_start = doc_end - n_chars
        # Units: cut at text starts, before runs of spaces, and around lone characters.
        space = points == _MARK
        cut = np.zeros(len(points) + 1, dtype=bool)
        cut[doc_start[n_chars > 0]] = True
        cut[1:-1] |= space[1:] & ~space[:-1]
        lone = np.flatnonzero(~self.joins[points])
        cut[lone] = cut[lone + 1] = True
        cut[0] = cut[-1] = True
        bounds = np.flatnonzero(cut)
        start, stop = bounds[:-1], bounds[1:]
        sums, _ = self._codes(points)
        _, down2 = char_powers(len(points))
        code = mix((sums[stop] - sums[start]) * down2[start])
        _, first, unit = np.unique(code, return_index=True, return_inverse=True)
        # The distinct units, one after the other, each with one more node than characters.
        u_start, u_len = start[first], (stop - start)[first]
        offset = np.cumsum(u_len) - u_len
        total = int(u_len.sum())
        places = np.arange(total) - np.repeat(offset, u_len) + np.repeat(u_start, u_len)
        up_points = points[places]
        at, size, piece = self._edges(up_points, np.repeat(offset + u_len, u_len))
        of_unit = np.repeat(np.arange(len(u_len)), u_len)
        src = at + of_unit[at]  # nodes: one more per unit before it
        dst = src + size
        w = np.where(piece >= 0, self.weight[piece], self.fallback)
        depth = (at - offset[of_unit[at]]) + size
        order = np.argsort((depth << 40) + dst)
        src, dst, w, piece, depth = src[order], dst[order], w[order], piece[order], depth[order]
        n_nodes = total + len(u_len)
        ways = np.full(n_nodes, -np.inf)
        ways[offset + np.arange(len(u_len))] = 0.0
        new = np.ones(len(dst), dtype=bool)
        new[1:] = dst[1:] != dst[:-1]
        heads = np.flatnonzero(new)
        score = np.empty(len(dst))
        level = np.flatnonzero(np.concatenate(([True], depth[1:] != depth[:-1])))
        for a, b in zip(level, [*level[1:], len(depth)], strict=True):
            score[a:b] = ways[src[a:b]] + w[a:b]
            h = heads[np.searchsorted(heads, a):np.searchsorted(heads, b)]
            ways[dst[h]] = np.logaddexp.reduceat(score[a:b], h - a)
        # Per node the running probability of its edges; the last one is never passed.
        upto = np.cumsum(np.exp(score - ways[dst]))
        last_of = np.concatenate((heads[1:], [len(dst)])) - 1
        before = np.concatenate(([0.0], upto[last_of[:-1]]))
        upto = (upto - np.repeat(before, last_of - heads + 1)).astype(np.float32)
        upto[last_of] = 2.0
        head = np.zeros(n_nodes, dtype=np.int32)
        head[dst[heads]] = heads
        src = src.astype(np.int32)
        # Backward sampling for every occurrence at once.
        of_doc = np.searchsorted(doc_end, start, side="right")
        row = mix(keys.astype(U) ^ U(self.seed * 0x9E3779B97F4A7C15 % (1 << 64)))[of_doc]
        base = (offset[unit] + unit).astype(np.int32)  # first node of the occurrence's unit
        shift = start - doc_start[of_doc] - base  # from a node to its place in the text
        step_row = row + shift.astype(U) * U(_STEP)
        live, steps, count = np.arange(len(unit), dtype=np.int32), [], np.zeros(len(unit), dtype=np.int32)
        node, floor, key = base + u_len[unit].astype(np.int32), base, step_row
        while len(live):
            draw = (mix(key + node.astype(U) * U(_STEP)) >> U(40)).astype(np.float32) * np.float32(2.0**-24)
            edge = head[node]
            wrong = np.flatnonzero(upto[edge] <= draw)
            while len(wrong):
                edge[wrong] += 1
                wrong = wrong[upto[edge[wrong]] <= draw[wrong]]
            steps.append((live, edge))
            count[live] += 1
            node = src[edge]
            on = node != floor
            live, node, floor, key = live[on], node[on], floor[on], key[on]
        last = np.cumsum(count, dtype=np.int64)
        chosen = np.empty(int(last[-1]), dtype=np.int32)
        for k, (live, edge) in enumerate(steps):
            chosen[last[live] - 1 - k] = edge
        ids = piece[chosen].astype(np.int64)
        n_ids = np.bincount(of_doc, weights=count, minlength=len(texts)).astype(np.int64)
        lone = np.flatnonzero(ids < 0)
        unit_of = np.searchsorted(last, lone, side="right")
        return self._bytes(ids, lone, raw[start[unit_of] + src[chosen[lone]] - base[unit_of]], n_ids)

    def _bytes(self, ids, lone, chars, n_ids):
        """Fallback edges (at ``lone``) become the ids of their characters' bytes."""
        if not len(lone):
            return ids, n_ids
        spelled = [chr(c).encode() for c in chars.tolist()]
        sizes = np.array([len(s) for s in spelled])
        times = np.ones(len(ids), dtype=np.int64)
        times[lone] = sizes
        out = np.repeat(ids, times)
        out[out < 0] = self.byte_id[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        of_doc = np.repeat(np.arange(len(n_ids)), n_ids)
        return out, np.bincount(of_doc, weights=times, minlength=len(n_ids)).astype(np.int64)

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text of one sequence of ids."""
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids])[1:]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:  # on the driver only
        return f.read()


def _encode(batches, shared, alpha, seed, check):
    lattice = Lattice(shared.value, alpha, seed)
    for batch, texts in text_chunks(batches):
        keys = np.array([_NULL_KEY if k is None else k for k in batch.column("_id").to_pylist()], dtype=np.int64)
        ids, n = lattice.sample([t.decode() for t in texts], keys.view(U))
        ends = np.concatenate(([0], np.cumsum(n)))
        arrays = [batch.column("_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                  pa.array(n, pa.int64())]
        names = ["_id", "ids", "n_tokens"]
        if check:
            flat = ids.tolist()
            same = [lattice.decode(flat[a:b]) == t for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]
            arrays.append(pa.array(same, pa.bool_()))
            names.append("lossless")
        yield pa.RecordBatch.from_arrays(arrays, names)


def encode(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED,
           id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """``_id, ids array<int>, n_tokens`` per row; with ``check`` also ``lossless`` (decoded again)."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    schema = "_id long, ids array<int>, n_tokens long" + ", lossless boolean" * check
    return id_text(docs, id_col, text_col).mapInArrow(
        lambda b: _encode(b, shared, alpha, seed, check), schema)


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "_id", ids_col: str = "ids") -> DataFrame:
    """``_id, text``: the texts back from their ids (null ids: empty text)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(model))

    def texts(batches):
        lattice = Lattice(shared.value)
        for batch in batches:
            out = [lattice.decode(ids or []).decode() for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.string())], ["_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(
        texts, "_id long, text string")
