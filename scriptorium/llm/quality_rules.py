"""Quality rules: counted base rules and a hashed n-gram logistic regression.

Features are word 1- and 2-grams and character 3- and 4-grams, hashed into two tables of
2^17 places; a text's value at a place is the share of its n-grams of that kind that fall
there, so length does not matter. The regression is fitted on labelled quality rows: a
fixed number of shards (documents dealt by a hash of their text) each fit L2-regularised
logistic regression by L-BFGS in one task, and the shards' weights are averaged. A fifth of
the labelled rows is held out; a slope and an intercept (Platt) fitted on the histogram of
their scores turn scores into probabilities. Every document is then scored in Arrow
batches, against fixed thresholds: below ``REJECT`` it goes, and below ``DOUBT`` it is kept
but marked ``doubtful``.

Bounds of the fit, the only sample taken here: each of ``SHARDS`` shards reads at most
``SHARD_ROWS`` labelled documents and stops before ``SHARD_ENTRIES`` (place, value)
pairs, in the order of a hash, so equal corpora give equal samples. Held-out rows and
scored rows are all rows.

Edge cases: null and empty texts have no words and fail the base rules; equal rows are
returned one by one but give the fit one row; a label row with a null id or a quality
other than 0 and 1 is ignored, and so are ids labelled both 0 and 1. Without labelled rows
of both kinds nothing is known: every probability is 1 and the base rules alone decide.
Texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, id_text, runs_of, save, small_batches, text_chunks
from .words import _SPACE, U, Words, mix, whole_windows, window_codes

BITS = 17                  # places of each of the two tables: 2^17
SHARDS = 8
SHARD_ROWS = 4096
SHARD_ENTRIES = 4_000_000
HOLD_OUT = 5               # one labelled row in five calibrates
GAIN = 64.0                # scale of the shares
PENALTY = 1e-4
STEPS = 60
REJECT, DOUBT = 0.5, 0.9   # fixed thresholds on the probability of good quality
LEAST_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"      # fixed value of the base rules

_PLACES = 1 << BITS
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _place(codes: np.ndarray) -> np.ndarray:
    return (codes >> U(64 - BITS)).astype(np.int32)


def _grams(words: Words, texts: list[bytes]):
    """Places of the words' and the characters' n-grams, each with its text's index."""
    codes, doc = words.codes(), words.doc()
    pair = words.whole(2)
    word = (np.concatenate([_place(codes), _place(words.windows(codes, 2))[pair]]),
            np.concatenate([doc, doc[:len(pair)][pair]]))
    chars = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32) for t in texts]
    n = np.array([len(c) for c in chars], dtype=np.int64)
    letters = mix(np.concatenate([*chars, np.zeros(0, np.uint32)]).astype(U) + U(0x9E3779B97F4A7C15))
    owner = np.repeat(np.arange(len(n)), n)
    places, docs = [], []
    for size in (3, 4):
        whole = whole_windows(n, size)
        places.append(_place(window_codes(letters, size, size))[whole] + _PLACES)
        docs.append(owner[:len(whole)][whole])
    return word, (np.concatenate(places), np.concatenate(docs))


def _shares(kinds, texts: int) -> list[np.ndarray]:
    """What one n-gram of each kind counts for, per text."""
    return [GAIN / np.maximum(np.bincount(doc, minlength=texts), 1) for _, doc in kinds]


def _scores(words: Words, texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    kinds = _grams(words, texts)
    out = np.full(len(texts), float(weights[-1]))
    for (place, doc), share in zip(kinds, _shares(kinds, len(texts)), strict=True):
        out += np.bincount(doc, weights=weights[place], minlength=len(texts)) * share
    return out


def _features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places and values of each text."""
    kinds = _grams(Words(texts), texts)
    key = [doc.astype(np.int64) * (2 * _PLACES) + place for place, doc in kinds]
    found = [np.unique(k, return_counts=True) for k in key]
    cells = np.concatenate([k for k, _ in found])
    value = np.concatenate([n * s[k // (2 * _PLACES)] for (k, n), s in
                            zip(found, _shares(kinds, len(texts)), strict=True)])
    order = np.argsort(cells, kind="stable")
    cells, value = cells[order], value[order].astype(np.float32)
    ends = np.searchsorted(cells, np.arange(1, len(texts) + 1) * (2 * _PLACES))
    place = (cells % (2 * _PLACES)).astype(np.int32)
    return [(place[a:b], value[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """The inner product on this thread (a task has one core, a linear algebra library takes all)."""
    return float(np.einsum("i,i->", a, b))


def _objective(w, place, value, row, first, y):
    """Penalised mean log loss and its gradient; the last weight is the constant."""
    z = np.add.reduceat(value * w[place], first) + w[-1]
    loss = np.logaddexp(0.0, np.where(y, -z, z)).mean() + PENALTY / 2 * _dot(w[:-1], w[:-1])
    r = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
    grad = np.bincount(place, weights=value * r[row], minlength=len(w))
    grad[:-1] += PENALTY * w[:-1]
    grad[-1] = r.sum()
    return loss, grad


def _minimum(w, loss_and_grad, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """L-BFGS with a halving line search."""
    loss, grad = loss_and_grad(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, t, r in reversed(past):
            alphas.append(r * _dot(s, q))
            q -= alphas[-1] * t
        if past:
            s, t, _ = past[-1]
            q *= _dot(s, t) / _dot(t, t)
        for (s, t, r), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - r * _dot(t, q))
        slope = _dot(grad, q)
        if slope <= 0:
            q, slope, past = grad, _dot(grad, grad), []
        step = 1.0
        while True:
            new = w - step * q
            new_loss, new_grad = loss_and_grad(new)
            if new_loss <= loss - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, t = new - w, new_grad - grad
        done = loss - new_loss <= 1e-7 * max(1.0, abs(loss))
        w, loss, grad = new, new_loss, new_grad
        if done:
            break
        curved = _dot(s, t)
        if curved > 1e-12:
            past = [*past[-memory + 1:], (s, t, 1 / curved)]
    return w


def _fit_shards(batches):
    """The weights of each shard; its rows come sorted by hash, and the bounds cut the rest."""
    held: list[tuple[bool, np.ndarray, np.ndarray]] = []
    shard, entries = None, 0

    def fitted():
        y = np.array([h[0] for h in held], dtype=float)
        if not 0 < y.sum() < len(y):
            return None
        place, value = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]).astype(float)
        n = np.array([len(h[1]) for h in held])
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        used, place = np.unique(place, return_inverse=True)  # the penalty keeps all others at zero
        small = _minimum(np.zeros(len(used) + 1), lambda v: _objective(v, place, value, row, first, y))
        w = np.zeros(2 * _PLACES + 1)
        w[used], w[-1] = small[:-1], small[-1]
        return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([w.tobytes()], pa.binary())],
                                          ["rows", "weights"])

    for batch, texts in text_chunks(batches):
        shards, marks = batch.column("_shard").to_pylist(), batch.column("_y").to_pylist()
        full = len(held) >= SHARD_ROWS or entries > SHARD_ENTRIES
        if full and shards[0] == shards[-1] == shard:
            continue
        for s, y, (place, value) in zip(shards, marks, _features(texts), strict=True):
            if s != shard:
                if held and (out := fitted()) is not None:
                    yield out
                shard, entries, held = s, 0, []
            entries += len(place)
            if len(place) and len(held) < SHARD_ROWS and entries <= SHARD_ENTRIES:
                held.append((bool(y), place.copy(), value.copy()))
    if held and (out := fitted()) is not None:
        yield out


def calibration(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Platt's slope and intercept from (score, good, bad) counts; smoothed targets."""
    z, good, bad = (np.array([b[i] for b in bins], dtype=float) for i in range(3))
    if not bins or not good.sum() or not bad.sum():
        return 1.0, 0.0
    high, low = (good.sum() + 1) / (good.sum() + 2), 1 / (bad.sum() + 2)
    target, total = good * high + bad * low, good + bad
    ab = np.array([1.0, 0.0])

    def loss(v):
        t = v[0] * z + v[1]
        return float((total * np.logaddexp(0, t) - target * t).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * z + ab[1], -500, 500)))
        g = np.array([((total * p - target) * z).sum(), (total * p - target).sum()])
        c = total * p * (1 - p)
        h = np.array([[(c * z * z).sum(), (c * z).sum()], [(c * z).sum(), c.sum()]]) + 1e-9 * np.eye(2)
        move, step = np.linalg.solve(h, g), 1.0
        while loss(ab - step * move) > loss(ab) and step > 1e-6:
            step /= 2
        ab = ab - step * move
        if np.abs(step * move).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


@dataclass
class Model:
    weights: np.ndarray    # both tables and the constant
    slope: float
    intercept: float


def _known(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``_label, _y`` of the ids with one label."""
    y = F.col(label_col)
    known = labels.filter(F.col(id_col).isNotNull() & y.isin(0, 1)).groupBy(
        F.col(id_col).cast("long").alias("_label")).agg(F.min(y).alias("_y"), F.max(y).alias("_y2"))
    return save(known.filter("_y = _y2").select("_label", F.col("_y").cast("boolean").alias("_y")), "quality-labels")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model | None:
    """The calibrated model; None without labelled documents of both kinds."""
    spark = docs.sparkSession
    known = broadcast_if_small(_known(labels, id_col, label_col))
    labelled = F.col("_id") == F.col("_label")
    rows = id_text(docs, id_col, text_col).join(known, labelled).select(
        "_text", "_y", F.xxhash64("_id", "_text").alias("_h")).withColumn("_part", F.pmod("_h", F.lit(HOLD_OUT)))
    # Twice the rows that the shards can take, by hash: what is shuffled stays bounded.
    ids = docs.select(F.col(id_col).cast("long").alias("_id")).join(known, labelled)
    n = ids.agg(F.approx_count_distinct("_id")).first()[0]
    share = min(1.0, 2.0 * SHARDS * SHARD_ROWS / max(n, 1))
    chosen = rows.filter("_part > 0").filter(F.pmod(F.xxhash64("_h"), F.lit(1 << 20)) < int(share * (1 << 20)))
    chosen = chosen.groupBy("_h").agg(F.first("_text").alias("_text"), F.first("_y").alias("_y"))
    sharded = chosen.select(F.pmod(F.shiftright("_h", 8), F.lit(SHARDS)).cast("int").alias("_shard"), "_h", "_y", "_text")
    fits = sharded.repartition(SHARDS, "_shard").sortWithinPartitions("_shard", "_h").mapInArrow(
        _fit_shards, "rows long, weights binary")
    found = [(r.rows, np.frombuffer(r.weights)) for r in fits.collect()]  # at most SHARDS rows of 2 MB
    if not found:
        return None
    weights = sum(n * w for n, w in found) / sum(n for n, _ in found)
    sent = spark.sparkContext.broadcast(weights)

    def scored(batches):
        for batch, texts in text_chunks(batches):
            z = np.round(np.clip(_scores(Words(texts), texts, sent.value), -64, 64) * 8)
            yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int32)), batch.column("_y")], ["bin", "_y"])

    held = rows.filter("_part = 0").select("_text", "_y").mapInArrow(scored, "bin int, _y boolean")
    bins = held.groupBy("bin").agg(F.sum(F.col("_y").cast("long")).alias("good"), F.count("*").alias("n")).collect()
    sent.unpersist()
    slope, intercept = calibration([(r.bin / 8, r.good, r.n - r.good) for r in bins])  # at most 1025 bins
    return Model(weights, slope, intercept)


def _repeated_words(words: Words) -> np.ndarray:
    """Per text: words in windows of ``REPEAT_WINDOW`` words that occur twice or more in it."""
    starts = np.flatnonzero(words.whole(REPEAT_WINDOW))
    covered = np.zeros(len(words.start) + 1, dtype=np.int64)
    doc = words.doc()
    if len(starts):
        codes = words.windows(words.codes(), REPEAT_WINDOW)[starts]
        order = np.lexsort((codes, doc[starts]))
        new = runs_of([doc[starts][order], codes[order]])
        again = order[~(new & np.append(new[1:], True))]
        if len(again):  # equal codes: settled by a second, independent code
            at = starts[np.sort(again)]
            first = words.windows(words.codes(), REPEAT_WINDOW)[at]
            second = words.windows(words.codes(2), REPEAT_WINDOW, 3)[at]
            order = np.lexsort((second, first, doc[at]))
            new = runs_of([doc[at][order], first[order], second[order]])
            at = at[order][~(new & np.append(new[1:], True))]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + REPEAT_WINDOW, -1)
    return np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=len(words.n))


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _per_text(flags: np.ndarray, texts: list[bytes]) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return sums[ends] - sums[np.concatenate(([0], ends[:-1]))]


_OUT = ("_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, p_good double, doubtful boolean, kept boolean")


def _judge(batches, weights, slope, intercept):
    for batch, texts in text_chunks(batches):
        words = Words(texts)
        chars = ~_SPACE[words.bytes] & ((words.bytes & 0xC0) != 0x80)
        n, repeated = words.n.astype(np.int64), _repeated_words(words)
        failed = (n < LEAST_WORDS) | (100 * repeated > REPEAT_PERCENT * n)
        if weights is None:
            p = np.ones(len(texts))
        else:
            z = _scores(words, texts, weights.value)
            p = 1 / (1 + np.exp(-np.clip(slope * z + intercept, -500, 500)))
        columns = [batch.column("_id"), n, _per_text(chars, texts), _per_text(_IS_SYMBOL[words.bytes], texts),
                   np.array([_repeated_lines(t) for t in texts], dtype=np.int64), repeated, failed, p,
                   (p >= REJECT) & (p < DOUBT), ~failed & (p >= REJECT)]
        names = [c.split()[0] for c in _OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def quality_rules(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``_id``, the base counts and verdict, ``p_good``, ``doubtful``, ``kept``."""
    weights = None if model is None else docs.sparkSession.sparkContext.broadcast(model.weights)
    slope, intercept = (1.0, 0.0) if model is None else (model.slope, model.intercept)
    return id_text(small_batches(docs), id_col, text_col).mapInArrow(
        lambda b: _judge(b, weights, slope, intercept), _OUT)
