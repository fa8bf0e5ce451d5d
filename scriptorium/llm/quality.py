"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model runs over character 4-grams. With ``every=True`` the symbols are the characters
themselves, so that the counts grow with the text; otherwise they are a fixed alphabet of
32 (folded Latin letters, one symbol each for capitals, digits, white space, sentence marks, other
signs and other letters). All trusted documents (``quality`` 1 and not toxic) are counted,
per language; tasks pre-aggregate, and the counts, contexts, discounts and lower-order
continuation counts are joined in shards by (language, n-gram). The documents' 4-grams,
each once a language, are joined to these shards, and their probabilities go by a
shuffle to the documents of the language, which are dealt out in parts of about ``PART``
symbols; there they are summed per document. No table passes through the driver. The few
4-grams of 32 symbols go to all parts of their language; of all characters a part
gets only those that it holds. ``judged_by_both`` scores by both models, and deals the texts once for that.

A document's cross-entropy per symbol is averaged with ``PRIOR`` symbols of the
language's mean, so that a few words cannot decide; its exponential is the
perplexity. A document is rejected when it is above the language's threshold: the
``QUANTILE`` of its trusted documents, all of them, times ``MARGIN``.

Edge cases: a language without trusted text uses the model and threshold of all trusted
text; with no trusted text at all everything is kept and the perplexity is null; a
null or empty text has the mean perplexity and stays; a null language is one of its
own; labels without a document are ignored; repeated labels count once. Rows equal in
every column are scored by one task. Characters beyond U+FFFF share 2,048 symbols.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, runs_of, save, small_batches

ORDER = 4
BITS = 5
#: Of a symbol that is a character.
WIDE_BITS = 16
QUANTILE = 0.99
MARGIN = 1.5
PRIOR = 100
#: Languages that a task counts at a time.
SLICE = 16
#: Symbols of a language that one task scores, on average.
PART = 1 << 23
#: Different 4-grams of characters that a task holds before it sends them.
HELD = 1 << 21
#: Stands for all languages together; real ones get a prefix.
ALL = "*"
_SPACE, _UPPER, _DIGIT, _MARK, _SIGN, _OTHER = range(26, 32)


def _alphabet() -> np.ndarray:
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for point in range(0x3000):
        c = chr(point)
        base = unicodedata.normalize("NFD", c)[0]
        kind = unicodedata.category(c)
        if "a" <= base <= "z":
            table[point] = ord(base) - ord("a")
        elif kind == "Lu":
            table[point] = _UPPER
        elif c.isspace():
            table[point] = _SPACE
        elif kind[0] == "N":
            table[point] = _DIGIT
        elif c in ".,;:!?'\"()-":
            table[point] = _MARK
        elif kind[0] in "PSC":
            table[point] = _SIGN
    return table


_TABLE: list[np.ndarray] = []


def _bits(every: bool) -> int:
    return WIDE_BITS if every else BITS


def _grams(texts: list[str], every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """4-gram codes of all texts, each after three spaces, and the texts' lengths."""
    if not _TABLE:
        _TABLE.append(_alphabet())
    pad = " " * (ORDER - 1)
    points = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le"), dtype=np.uint32)
    if every:  # no text has surrogates
        symbol = np.where(points >> WIDE_BITS, 0xD800 + (points & 0x7FF), points).astype(np.int64)
    else:
        symbol = _TABLE[0][points].astype(np.int32)
    bits = _bits(every)
    n = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.zeros(max(len(symbol) - ORDER + 1, 0), dtype=symbol.dtype)
    for k in range(ORDER):
        code = (code << bits) | symbol[k:k + len(code)]
    first = np.cumsum(n + ORDER - 1) - n - (ORDER - 1)
    inside = np.zeros(len(code) + 1, dtype=np.int32)
    np.add.at(inside, first[n > 0], 1)
    np.add.at(inside, (first + n)[n > 0], -1)
    return code[np.cumsum(inside[:-1]) > 0], n


def _slices(texts: list[str], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i == len(texts) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def _count(batches):
    """``(_lang, code, c)``: the 4-grams of a partition, summed before they are sent."""
    held: dict[str, np.ndarray] = {}

    def rows(lang):
        counts = held.pop(lang)
        code = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int32)),
                                           pa.array(counts[code])], ["_lang", "code", "c"])

    for batch in batches:
        langs = np.array(batch.column("_lang").to_pylist(), dtype=object)
        texts = batch.column("_text").to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for a, b in _slices(own):
                if lang not in held:
                    if len(held) == SLICE:
                        yield rows(next(iter(held)))
                    held[lang] = np.zeros(1 << (BITS * ORDER), dtype=np.int64)
                held[lang] += np.bincount(_grams(own[a:b])[0], minlength=1 << (BITS * ORDER))
    for lang in list(held):
        yield rows(lang)


def _count_every(batches):
    """``_count`` for codes of 64 bits: ``HELD`` different ones at a time."""
    held: dict[str, list] = {}
    size = 0

    def rows(lang):
        codes, counts = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
        code, at = np.unique(codes, return_inverse=True)
        c = np.zeros(len(code), dtype=np.int64)
        np.add.at(c, at, counts)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(c)],
                                          ["_lang", "code", "c"])

    for batch in batches:
        langs = np.array(batch.column("_lang").to_pylist(), dtype=object)
        texts = batch.column("_text").to_pylist()
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for a, b in _slices(own):
                held.setdefault(lang, []).append(np.unique(_grams(own[a:b], True)[0], return_counts=True))
                size += len(held[lang][-1][0])
                if size > HELD:
                    yield from [rows(x) for x in list(held)]
                    size = 0
    for lang in list(held):
        yield rows(lang)


def _counted(texts: DataFrame, every: bool) -> DataFrame:
    """``(_lang, code, c)`` of ``texts`` (``_lang, _text``), one row or more a code."""
    return texts.select("_lang", "_text").mapInArrow(
        _count_every if every else _count, f"_lang string, code {'long' if every else 'int'}, c long")


def _discounts(counts: DataFrame) -> DataFrame:
    """Per language and order the three discounts of modified Kneser-Ney."""
    n = counts.groupBy("_lang", "n").agg(
        *[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def d(k):
        value = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.greatest(F.lit(0.1), F.least(F.lit(float(k)), F.coalesce(value, F.lit(0.5 * k)))).alias(f"d{k}")

    return n.select("_lang", "n", d(1), d(2), d(3))


def _suffix(n: int, every: bool = False):
    return F.col("code") if n == ORDER else F.col("code").bitwiseAND((1 << (_bits(every) * n)) - 1)


def _key(kind, code, every: bool = False):
    """Shard key: kind n is an n-gram's own share, ``ORDER`` + n the weight below its context, 0 a whole probability."""
    if every:
        return F.struct(kind.cast("int").alias("kind"), code.cast("long").alias("code")).alias("key")
    return (kind * (1 << (BITS * ORDER)) + code).cast("int").alias("key")


def _shares(texts: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(_lang, code, c)``, the 4-grams of ``texts`` (``_lang, _text``), and ``(_lang, key, value)``, all orders' shares and weights."""
    top = _counted(texts, every).groupBy("_lang", "code").agg(F.sum("c").alias("c"))
    general = top.groupBy("code").agg(F.sum("c").alias("c")).select(F.lit(ALL).alias("_lang"), "code", "c")
    grams = save(top.union(general), "grams")
    lower, below = None, grams
    for n in range(ORDER - 1, 0, -1):  # distinct left neighbours
        below = below.groupBy("_lang", _suffix(n, every).alias("code")).agg(F.count("*").alias("c"))
        part = below.withColumn("n", F.lit(n))
        lower = part if lower is None else lower.union(part)
    counts = grams.withColumn("n", F.lit(ORDER)).union(save(lower, "lower-grams"))
    c = counts.join(broadcast_if_small(save(_discounts(counts), "discounts")), ["_lang", "n"])
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    c = c.select("_lang", "n", "code", F.shiftrightunsigned("code", _bits(every)).alias("ctx"), "c", cut.alias("cut"))
    context = c.groupBy("_lang", "n", "ctx").agg(F.sum("c").alias("s"), F.sum("cut").alias("mass"))
    own = c.join(context, ["_lang", "n", "ctx"]).select(
        "_lang", _key(F.col("n"), F.col("code"), every), ((F.col("c") - F.col("cut")) / F.col("s")).alias("value"))
    weights = context.select(
        "_lang", _key(F.col("n") + ORDER, F.col("ctx"), every), (F.col("mass") / F.col("s")).alias("value"))
    return grams, save(own.union(weights), "shares")


def _probabilities(grams: DataFrame, shards: DataFrame, orders: tuple[int, ...], base: float | None = None,
                   every: bool = False) -> DataFrame:
    """``grams`` (``_lang, code``, more) with ``p``, interpolated over ``orders`` from ``base`` or the shards' whole probabilities."""
    keys = []
    for n in orders:
        keys += [_key(F.lit(n), _suffix(n, every), every),
                 _key(F.lit(ORDER + n), F.shiftrightunsigned(_suffix(n, every), _bits(every)), every)]
    keys.append(_key(F.lit(0), _suffix(orders[0] - 1, every), every))
    asked = grams.select("*", F.posexplode(F.array(*keys)).alias("at", "key"))
    found = asked.join(shards, ["_lang", "key"]).groupBy(*grams.columns).agg(
        *[F.max(F.when(F.col("at") == i, F.col("value"))).alias(f"v{i}") for i in range(len(keys))])
    p = F.col(f"v{len(keys) - 1}") if base is None else F.lit(base)
    for i in range(len(orders)):
        p = F.coalesce(F.col(f"v{2 * i}"), F.lit(0.0)) + F.coalesce(F.col(f"v{2 * i + 1}"), F.lit(1.0)) * p
    return found.select(*grams.columns, p.alias("p"))


def _shards(shares: DataFrame) -> DataFrame:
    """``(_lang, key, value)``: the shares of orders 3 and 4, and of each language all 1,024 probabilities of order 2.

    Orders 1 and 2 have few keys, which all 4-grams of a language would meet.
    """
    pairs = shares.select("_lang").distinct().select(
        "_lang", F.explode(F.sequence(F.lit(0), F.lit((1 << (2 * BITS)) - 1))).alias("code"))
    kind = F.shiftright("key", BITS * ORDER)
    whole = _probabilities(pairs, shares, (1, 2), 2.0**-BITS).select("_lang", _key(F.lit(0), F.col("code")), "p")
    return save(shares.filter(kind.isin(3, 4, ORDER + 3, ORDER + 4)).union(whole), "shards")


def _every_probability(grams: DataFrame, shares: DataFrame) -> DataFrame:
    """Different ``grams`` (``_lang, code``) of characters with ``p``, order by order.

    A lower order's probability is made once for all 4-grams that end alike, so no key
    meets more rows than there are characters.
    """
    asked = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        asked[n] = save(asked[n + 1].select("_lang", _suffix(n, True).alias("code")).distinct(), "asked")
    out = None
    for n in range(1, ORDER + 1):
        shards = shares.filter(F.col("key.kind").isin(n, ORDER + n))
        if out is not None:
            shards = shards.union(save(out, "below").select("_lang", _key(F.lit(0), F.col("code"), True), "p"))
        out = _probabilities(asked[n], shards, (n,), 2.0**-WIDE_BITS if n == 1 else None, True)
    return out


def _pack(batches):
    """One dense table of log-probabilities per language of the partition."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        frame = batch.to_pandas()
        for lang, rows in frame.groupby("_lang"):
            if lang not in held:
                held[lang] = np.repeat([0.0, 1.0], [(ORDER + 1) << (BITS * ORDER), ORDER << (BITS * ORDER)])
            held[lang][rows["key"].to_numpy()] = rows["value"].to_numpy()
    for lang, values in held.items():
        kinds = values.reshape(2 * ORDER + 1, -1)
        p = np.full(1, 2.0**-BITS)
        for n in range(1, ORDER + 1):
            code = np.arange(1 << (BITS * n))
            p = kinds[n][code] + kinds[ORDER + n][code >> BITS] * p[code & (len(p) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([np.log(p).astype(np.float32).tobytes()])],
                                         ["_lang", "logs"])


def log_probabilities(texts: DataFrame) -> DataFrame:
    """``(_lang, logs)``: all 32^4 float32 log-probabilities, to look at a model; ``texts`` has ``_lang, _text``."""
    return _shares(texts)[1].repartition("_lang").mapInArrow(_pack, "_lang string, logs binary")


def _langs(col):
    return F.concat(F.lit("="), F.coalesce(col, F.lit("")))


class _Dense:
    """The log-probabilities of a part, by code."""

    def __init__(self):
        self.logs = np.full(1 << (BITS * ORDER), np.nan, dtype=np.float32)

    def clear(self):
        self.logs.fill(np.nan)

    def add(self, code, p):
        self.logs[code] = np.log(p)

    def __getitem__(self, code):
        return self.logs[code]


class _Sorted:
    """The same for codes of 64 bits."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.new, self.code, self.logs = [], np.zeros(0, dtype=np.int64), np.zeros(0)

    def add(self, code, p):
        self.new.append((code, np.log(p)))

    def __getitem__(self, code):
        if self.new:
            codes, logs = (np.concatenate(x) for x in zip((self.code, self.logs), *self.new, strict=True))
            order = np.argsort(codes)
            self.new, self.code, self.logs = [], codes[order], logs[order]
        if not len(self.code):
            return np.full(len(code), np.nan)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.logs[at], np.nan)


_Columns = tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]


def _sums(batches: Iterator[_Columns]) -> Iterator[pa.Array]:
    """Sums of the texts of a part, whose probabilities come in the rows before them (null for those)."""
    yield from _summed(batches, {False: _Dense()})


def _sums_every(batches: Iterator[_Columns]) -> Iterator[pa.Array]:
    yield from _summed(batches, {True: _Sorted()})


def _sums_both(batches: Iterator[_Columns]) -> Iterator[pa.Array]:
    yield from _summed(batches, {False: _Dense(), True: _Sorted()})


def _summed(batches, held):
    """``held``: the probabilities of the part by ``every``; a given row belongs to one of them."""
    now = None
    for part, text, every, codes, ps in batches:
        parts = part.to_numpy(zero_copy_only=False)
        given = codes.is_valid().to_numpy(zero_copy_only=False)
        kind = every.fill_null(False).to_numpy(zero_copy_only=False)
        nats, length = {e: np.zeros(len(parts)) for e in held}, np.zeros(len(parts), dtype=np.int64)
        edges = np.flatnonzero(runs_of([parts, given, kind])) if len(parts) else []
        for start, stop in zip(edges, [*edges[1:], len(parts)]):
            if parts[start] != now:
                for logs in held.values():
                    logs.clear()
                now = parts[start]
            if given[start]:
                at = codes.slice(start, stop - start).flatten().to_numpy()
                held[bool(kind[start])].add(at, ps.slice(start, stop - start).flatten().to_numpy())
                continue
            texts = [t or "" for t in text.slice(start, stop - start).to_pylist()]
            for a, b in _slices(texts):
                for e, logs in held.items():
                    code, n = _grams(texts[a:b], e)
                    has = np.flatnonzero(n)
                    if len(has):
                        nats[e][start + a + has] = -np.add.reduceat(logs[code].astype(np.float64), (np.cumsum(n) - n)[has])
                length[start + a:start + b] = n
        if any(np.isnan(x).any() for x in nats.values()):
            raise ValueError("a text changed between two reads of the documents")
        yield pa.StructArray.from_arrays([pa.array(x) for x in (length, *nats.values())],
                                         ["n", *(_nats(e) for e in held)], mask=pa.array(given))


def _nats(every: bool) -> str:
    return "every_nats" if every else "nats"


class Model:
    """The stored shards, and the thresholds and means by language."""

    def __init__(self, shares: DataFrame, every: bool = False):
        self.every = every
        self.shards = shares if every else _shards(shares)
        # The weight below the empty context stands once a language, as does the probability of the first pair.
        first = F.col("key.kind") == ORDER + 1 if every else F.col("key") == 0
        self.known = self.shards.filter(first).select(F.col("_lang").alias("_model"))
        self.names = sorted(r._model for r in self.known.collect())
        self.limits: DataFrame | None = None

    def by_language(self, table: DataFrame) -> DataFrame:
        """A broadcast hint for a table with a row per language, of 16 to 64 bytes, unless there are very many."""
        return F.broadcast(table) if len(self.names) <= BROADCAST_ROWS else table

    def found(self, texts: DataFrame, counts: DataFrame | None) -> DataFrame:
        """The different 4-grams of 32 symbols of ``texts`` with ``p``, stored; ``counts`` are they, if known."""
        if counts is None:
            counts = _counted(texts, False).groupBy("_lang", "code").agg(F.sum("c").alias("c"))
        return save(_probabilities(counts, self.shards, (3, 4)), "found")

    def _held(self, docs: DataFrame, text: str) -> DataFrame:
        """``(_lang, _part, _codes, _ps)``: the probabilities of the different 4-grams that each part holds."""
        dealt = docs.select(F.concat_ws(":", "_part", "_lang").alias("_lang"),
                            F.coalesce(F.col(text), F.lit("")).alias("_text")).repartition("_lang")
        held = save(_counted(dealt, True).select(F.expr("substring(_lang, instr(_lang, ':') + 1)").alias("_lang"),
                                                 F.substring_index("_lang", ":", 1).cast("int").alias("_part"), "code"), "held")
        different = save(held.select("_lang", "code").distinct(), "asked")
        found = _every_probability(different, self.shards)
        given = held.join(found, ["_lang", "code"]).groupBy("_lang", "_part", F.pmod(F.xxhash64("code"), F.lit(64))).agg(
            F.collect_list(F.struct("code", "p")).alias("_found")).select(
            "_lang", "_part", F.col("_found.code").alias("_codes"), F.col("_found.p").alias("_ps"))
        return save(given, "given")  # so that these joins' shuffle files are gone when the texts are dealt


def _scored(models: list[Model], rows: DataFrame, text: str, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``_e``: the number of symbols ``n``, and a model's summed negative log-probability (``_nats``).

    ``rows`` has ``_row``, a struct with the field ``text``, ``_lang``, a model's name, and more; ``counts`` are its
    4-grams of 32 symbols, if known. Several models are of the same trusted text, so they have the same names.
    """
    texts = small_batches(rows).select("_lang", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = {m.every: m.found(texts, counts) for m in models if not m.every}
    if found:
        parts = found[False].groupBy("_lang").agg(F.ceil(F.sum("c") / PART).cast("int").alias("_parts"))
    else:
        size = texts.groupBy("_lang").agg(F.sum(F.char_length("_text")).alias("c"))
        parts = save(size.groupBy("_lang").agg(F.ceil(F.sum("c") / PART).cast("int").alias("_parts")), "parts")
    parts = models[0].by_language(parts)
    fields = [f"`_row`.`{f.name}`" for f in rows.schema["_row"].dataType
              if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    part = F.pmod(F.xxhash64(*fields), F.greatest(F.coalesce("_parts", F.lit(1)), F.lit(1)))
    docs = rows.join(parts, "_lang", "left").withColumn("_part", part.cast("int")).drop("_parts")
    out = docs
    for model in models:
        if model.every:
            given = model._held(docs, text)
        else:
            packed = found[False].groupBy("_lang", F.shiftright("code", 12)).agg(
                F.collect_list(F.struct(F.col("code").cast("long").alias("code"), "p")).alias("_found"))
            given = packed.join(parts, "_lang").select(
                "_lang", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
                F.col("_found.code").alias("_codes"), F.col("_found.p").alias("_ps"))
        out = out.unionByName(given.withColumn("_every", F.lit(model.every)), allowMissingColumns=True)
    out = out.repartition("_lang", "_part").sortWithinPartitions("_lang", "_part", F.col("_codes").isNull(), "_every")
    kinds = sorted({m.every for m in models})
    sums = _sums_both if len(kinds) > 1 else _sums_every if kinds[0] else _sums
    schema = "n long, " + ", ".join(f"{_nats(e)} double" for e in kinds)
    score = F.arrow_udf(sums, schema).asNondeterministic()  # needs the rows before, so it must not move
    out = out.withColumn("_e", score(F.xxhash64("_lang", "_part"), F.col(text), F.col("_every"), F.col("_codes"), F.col("_ps")))
    return out.filter("_e is not null").drop("_part", "_every", "_codes", "_ps")


def trusted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``_id, _lang, _text`` of the documents labelled good and not toxic."""
    ids = save(labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("_label_id")).distinct(), "trusted")
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("_id"), _langs(F.col(lang_col)).alias("_lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.join(broadcast_if_small(ids), F.col("_id") == F.col("_label_id"), "left_semi")


def train(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", every: bool = False) -> Model | None:
    """The model of all trusted documents, with thresholds; None without any. ``every``: of all characters."""
    texts = trusted(docs, labels, id_col, text_col, lang_col)
    grams, shares = _shares(texts, every)
    model = Model(shares, every)
    if not model.names:
        return None
    # A language of empty texts only has no model.
    rows = texts.join(model.by_language(model.known), F.col("_lang") == F.col("_model"), "left").select(
        F.struct("_id", "_text").alias("_row"), F.coalesce("_model", F.lit(ALL)).alias("_lang"))
    scored = _scored([model], rows, "_row._text", None if every else grams.filter(F.col("_lang") != ALL))
    scored = save(scored.select("_lang", F.col(f"_e.{_nats(every)}").alias("nats"), "_e.n"), "trusted-entropy")
    both = scored.filter(F.col("_lang") != ALL).union(scored.select(F.lit(ALL), "nats", "n"))
    mean = both.groupBy("_lang").agg((F.sum("nats") / F.greatest(F.sum("n"), F.lit(1))).alias("_mean"))
    smooth = (F.col("nats") + PRIOR * F.col("_mean")) / (F.col("n") + PRIOR)
    model.limits = save(both.join(model.by_language(mean), "_lang").groupBy("_lang").agg(
        F.first("_mean").alias("_mean"),
        (F.exp(F.percentile_approx(smooth, quantile, 10000)) * margin).alias("_limit")), "limits")
    return model


def _judged(docs: DataFrame, models: list[Model], text_col: str, lang_col: str) -> DataFrame:
    """``_row``, a struct of the columns of ``docs``, and ``_quality0``, ``_quality1`` of each model."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       _langs(F.col(lang_col)).alias("_name"))
    limits, owns = None, []
    for i, model in enumerate(models):
        # One row per language: 16 bytes each; the general entry is the last resort.
        last = model.limits.filter(F.col("_lang") == ALL).first()
        own = model.limits.select(F.col("_lang").alias("_model"), F.struct(
            F.col("_mean").alias("m"), F.col("_limit").alias("t")).alias(f"_own{i}"))
        limits = own if limits is None else limits.join(own, "_model")
        owns.append(F.coalesce(f"_own{i}", F.struct(F.lit(last._mean).alias("m"), F.lit(last._limit).alias("t"))).alias(f"_own{i}"))
    rows = rows.join(models[0].by_language(limits), F.col("_name") == F.col("_model"), "left").select(
        "_row", F.coalesce("_model", F.lit(ALL)).alias("_lang"), *owns)
    found = []
    for i, model in enumerate(models):
        own = F.col(f"_own{i}")
        smooth = F.exp((F.col(f"_e.{_nats(model.every)}") + PRIOR * own["m"]) / (F.col("_e.n") + PRIOR))
        found.append(F.struct(smooth.alias("perplexity"), own["t"].alias("threshold"),
                              (smooth <= own["t"]).alias("kept")).alias(f"_quality{i}"))
    return _scored(models, rows, f"`_row`.`{text_col}`").select("_row", *found)


_NONE = "named_struct('perplexity', cast(null as double), 'threshold', cast(null as double), 'kept', true)"


def judged(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with one more column ``_quality``: perplexity, threshold, kept."""
    if model is None:
        return docs.withColumn("_quality", F.expr(_NONE))
    own = [F.col(f"`_row`.`{c}`") for c in docs.columns if c.lower() != "_quality"]
    return _judged(docs, [model], text_col, lang_col).select(*own, F.col("_quality0").alias("_quality"))


def judged_by_both(docs: DataFrame, labels: DataFrame, text_col: str = "text", lang_col: str = "lang", **columns) -> DataFrame:
    """``docs`` with ``_quality`` by the 4-grams of 32 symbols and ``_quality_every`` by those of all characters."""
    models = [train(docs, labels, text_col=text_col, lang_col=lang_col, every=e, **columns) for e in (False, True)]
    own = [F.col(f"`_row`.`{c}`") for c in docs.columns if c.lower() not in ("_quality", "_quality_every")]
    if models[0] is None:
        out = docs.select(F.struct("*").alias("_row")).select("_row", F.expr(_NONE).alias("_quality0"), F.expr(_NONE).alias("_quality1"))
    else:
        out = _judged(docs, models, text_col, lang_col)
    return out.select(*own, F.col("_quality0").alias("_quality"), F.col("_quality1").alias("_quality_every"))


def quality_filter(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns."""
    model = train(docs, labels, **columns)
    if model is None:
        return docs
    out = _judged(docs, [model], columns.get("text_col", "text"), columns.get("lang_col", "lang"))
    return out.filter("_quality0.kept").select("_row.*")
