"""Benchmark decontamination by template canonicalisation.

Every word loses its outer punctuation and its case; numbers, number words, units,
numbers with a unit, and names (capitalised words inside a sentence) become typed
placeholders; a capitalised word that opens a sentence may be a name or not, and matches
as either. A document is contaminated by an item in one of three ways: a window of
``WINDOW`` template words (a whole item, if it has fewer, but ``LEAST``) with at least
half of them literal occurs in both, and the values in the placeholders are consistent
along the whole match: one item value always stands for one document value, and
different names stay different; or a run of twice ``WINDOW`` words of a match that is not
consistent as a whole is so in itself; or a window of ``WINDOW`` words (a whole item, if it
has fewer, but ``SHORT``) occurs in both with the same values, however few are literal.
So a copy is caught and a question with other numbers or names too, but not a text that
only shares the pattern. A letter of a script without spaces (Chinese, Japanese, Thai and
the like) is a word of its own.

The windows are hash-joined on the map side: the item windows are few, but not bounded,
so items are dealt by hash over slices of about ``SLICE_WINDOWS`` windows, each broadcast
of its own; every document window is looked up in every slice, whatever their number,
and documents are never shuffled.

Edge cases: null and empty texts are clean; an empty benchmark contaminates nothing;
items below ``SHORT`` words cannot be told from chance and match nothing; null
items are skipped; repeated items and rows are judged alike; items with equal text are
all listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs_of, save, small_batches
from .words import _WORDS, U, mix, whole_windows, window_codes

WINDOW = 13
LEAST = 8
SHORT = 5
SLICE_WINDOWS = 1_000_000
_CACHE = 200_000

# Words that name numbers and units.
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen
fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand
million billion half quarter dozen twice""".split())
UNITS = frozenset("""mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres
kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton
tons ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour
hours day days week weeks month months year years mph kmh km/h m/s percent degree degrees usd eur gbp dollar dollars
euro euros cent cents volt volts watt watts joule joules newton newtons""".split())

_PUNCT = "\"'`.,;:!?()[]{}<>*_~-–—‘’“”«»¿¡…"
_NUMBER = re.compile(r"[+\-−]?[$€£]?\d[\d.,:/]*%?[$€£]?")
_WITH_UNIT = re.compile(r"[+\-−]?\d[\d.,]*([^\W\d_][\w/]*)")
_LISTED = NUMBER_WORDS | UNITS
LITERAL, NUMBER, UNIT, MEASURE, NAME, DROPPED, OPENER = range(7)
#: Letters of scripts without spaces, and the punctuation between them.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
                       "\U00020000-\U0003ffff])|[\u3000-\u303f\uff01-\uff0f\uff1a-\uff20]")
_MAYBE_UNSPACED = re.compile(rb"[\xe3-\xe9\xef\xf0]|\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]")


def _split(text: bytes) -> list[bytes]:
    if not text.isascii() and _MAYBE_UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", text.decode()).encode()
    return text.split()


def _code(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, 7)


def kind_of(word: str) -> tuple[int, str]:
    """The type of a word (``NAME``: capitalised, so one inside a sentence) and its bare form."""
    if word.islower() and word.isalpha() and word not in _LISTED:
        return LITERAL, word
    bare = word.strip(_PUNCT)
    low = bare.lower()
    if not bare:
        return DROPPED, low
    if low in NUMBER_WORDS or _NUMBER.fullmatch(bare):
        return NUMBER, low
    if low in UNITS:
        return UNIT, low
    if (m := _WITH_UNIT.fullmatch(low)) and m[1] in UNITS:
        return MEASURE, low
    if bare[0].isupper() and (len(bare) == 1 or not bare.isupper()):
        return NAME, low
    return LITERAL, low


class Templates(dict):
    """Word -> number of its entry; ``value``, ``kind`` and ``ends`` hold the entries."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.clear()
        self.new = []
        self.value, self.kind, self.ends = np.zeros(0, U), np.zeros(0, np.int8), np.zeros(0, bool)

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        kind, low = kind_of(text)
        ends = not text[-1].isalnum() and text.rstrip("\"')]}”’»")[-1:] in (".", "!", "?", ":")
        self[word] = n = len(self)
        self.new.append((_code(low), kind, ends))
        return n

    def _grow(self):
        if self.new:
            value, kind, ends = zip(*self.new, strict=True)
            self.value = np.concatenate((self.value, np.array(value, dtype=U)))
            self.kind = np.concatenate((self.kind, np.array(kind, dtype=np.int8)))
            self.ends = np.concatenate((self.ends, np.array(ends, dtype=bool)))
            self.new = []

    def read(self, texts: list[bytes]):
        """Template codes, values and kinds of all words, and the number of each text's words."""
        if len(self) > _CACHE:
            self.reset()
        words = [_split(t) for t in texts]
        n = np.array([len(ws) for ws in words], dtype=np.int64)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), dtype=np.int32, count=int(n.sum()))
        self._grow()
        value, kind, ends = self.value[at], self.kind[at], self.ends[at]
        opens = np.ones(len(at), dtype=bool)
        opens[1:] = ends[:-1]
        opens[(np.cumsum(n) - n)[n > 0]] = True
        kind[(kind == NAME) & opens] = OPENER
        code = np.where((kind == LITERAL) | (kind == OPENER), value, _TYPES[kind])
        stay = kind != DROPPED
        doc = np.repeat(np.arange(len(n)), n)[stay]
        return code[stay], value[stay], kind[stay], np.bincount(doc, minlength=len(n))


_TYPES = np.array([_code(f"<type {k}>") for k in range(7)], dtype=U)


def _windows(code, n, size):
    """Starts and codes of the windows of ``size``."""
    whole = whole_windows(n, size)
    if not whole.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    start = np.flatnonzero(whole)
    return start, window_codes(code, size, 5)[start]


def _literals(kind, start, size):
    """Numbers of literals in the windows."""
    sums = np.concatenate(([0], np.cumsum(kind == LITERAL)))
    return sums[start + size] - sums[start]


class _Table:
    """Sorted codes of item windows with their starts; a bit per code bucket goes before the search."""

    def __init__(self, size: int, code: np.ndarray, start: np.ndarray):
        order = np.argsort(code, kind="stable")
        self.size, self.code, self.start = size, code[order], start[order]
        bits = max(16, (16 * len(code)).bit_length())
        self.shift = U(64 - bits)
        self.some = np.zeros(1 << bits, dtype=bool)
        self.some[code >> self.shift] = True

    def pairs(self, at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of text windows and of the item windows with the same code."""
        maybe = self.some[code >> self.shift]
        at, code = at[maybe], code[maybe]
        low, high = np.searchsorted(self.code, code), np.searchsorted(self.code, code, side="right")
        times = high - low
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        return np.repeat(at, times), self.start[entry]


class Items:
    """The template words and windows of a slice of the benchmark."""

    def __init__(self, rows: list[tuple[int, str]], window: int = WINDOW, least: int = LEAST):
        self.ids = np.array([i for i, _ in rows], dtype=np.int64)
        self.code, self.value, self.kind, self.n = Templates().read([t.encode() for _, t in rows])
        self.item = np.repeat(np.arange(len(rows)), self.n)
        self.window = window
        # What an opener of a text can be but a name.
        self.words = np.unique(self.value[(self.kind == LITERAL) | (self.kind == OPENER)])
        self.tables, self.exact = [], []
        for size in range(min(least, SHORT), window + 1):
            wanted = self.n >= window if size == window else self.n == size
            for tables, codes, lowest in ((self.tables, self._templates, least), (self.exact, self._values, SHORT)):
                if size >= min(lowest, window):
                    start, code = codes(size)
                    use = wanted[self.item[start]]
                    if use.any():
                        tables.append(_Table(size, code[use], start[use]))

    def _values(self, size):
        return _windows(self.value, self.n, size)

    def _templates(self, size):
        """Windows with enough literals, once for each choice of openers that are names."""
        start = np.flatnonzero(whole_windows(self.n, size))
        up = _WORDS.get(max(size, 1))[0]
        raw = np.zeros(len(start), dtype=U)
        for k in range(size):
            raw += self.code[start + k] * up[k]
        count = _literals(np.where(self.kind == OPENER, LITERAL, self.kind), start, size)
        for k in range(size):
            enough = 2 * count >= size
            start, raw, count = start[enough], raw[enough], count[enough]
            as_name = self.kind[start + k] == OPENER
            of = start[as_name]
            raw = np.concatenate((raw, raw[as_name] + (_TYPES[NAME] - self.code[of + k]) * up[k]))
            start, count = np.concatenate((start, of)), np.concatenate((count, count[as_name] - 1))
        enough = 2 * count >= size
        return start[enough], mix(raw[enough] + U(5))

    def _found(self, code, value, kind, n):
        """``(size, at, of)`` of the template windows that both hold."""
        opener = np.flatnonzero(kind == OPENER)
        known = opener[np.isin(value[opener], self.words)]
        names, either = kind.copy(), kind.copy()
        names[opener] = either[opener] = NAME
        either[known] = LITERAL
        near = np.zeros(len(kind) + 1, dtype=np.int64)
        near[known + 1] = 1
        near = np.cumsum(near)
        for table in self.tables:
            size, found = table.size, []
            for kinds in (either, names)[:1 + bool(len(known))]:
                codes = np.where(kinds == NAME, _TYPES[NAME], code)
                start, window = _windows(codes, n, size)
                use = 2 * _literals(kinds, start, size) >= size
                if kinds is names:
                    use &= near[start + size] > near[start]  # the others are as before
                at, of = table.pairs(start[use], window[use])
                same = np.ones(len(at), dtype=bool)
                for k in range(size):  # the windows themselves, not only their codes
                    a, b = at + k, of + k
                    opens = self.kind[b] == OPENER
                    same &= np.where(opens, (kinds[a] == NAME) | (kinds[a] == LITERAL) & (value[a] == self.value[b]),
                                     (kinds[a] == self.kind[b]) & (codes[a] == self.code[b]))
                found.append(np.stack((at[same], of[same])))
            at, of = np.unique(np.concatenate(found, axis=1), axis=1)
            if len(at):
                yield size, at, of

    def matches(self, code, value, kind, n):
        """``(text, item id, windows, changed)`` for all matches of a slice of texts."""
        doc = np.repeat(np.arange(len(n)), n)
        out, told = [], [np.zeros(0, dtype=np.int64)]
        for size, at, of in self._found(code, value, kind, n):
            order = np.lexsort((at, at - of, self.item[of], doc[at]))
            at, of = at[order], of[order]
            cuts = np.flatnonzero(runs_of([doc[at], self.item[of], at - of]))
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                # The template words that the windows of this diagonal cover.
                mine = np.unique((at[a:b, None] + np.arange(size)).ravel())
                theirs = mine - (at[a] - of[a])
                kinds, other = self.kind[theirs], value[mine] != self.value[theirs]
                slot = (kinds != LITERAL) & (other | (kinds != OPENER))
                pairs = [(k, i, d) if s else None for k, i, d, s in zip(
                    np.where(kinds == OPENER, NAME, kinds).tolist(), self.value[theirs].tolist(), value[mine].tolist(),
                    slot.tolist(), strict=True)]
                low, high = _consistent_run(pairs)
                if high - low == len(pairs) or high - low >= 2 * self.window:
                    inside = (at[a:b] >= mine[low]) & (at[a:b] + size - 1 <= mine[high - 1])
                    out.append((int(doc[at[a]]), int(self.ids[self.item[of[a]]]), int(inside.sum()),
                                bool((other & slot)[low:high].any())))
                    told.append(at[a:b][inside] * len(self.value) + of[a:b][inside])
        told = np.concatenate(told)
        for table in self.exact:
            at, of = table.pairs(*_windows(value, n, table.size))
            same = np.ones(len(at), dtype=bool)
            for k in range(table.size):
                same &= value[at + k] == self.value[of + k]
            at, of = at[same], of[same]
            new = ~np.isin(at * len(self.value) + of, told)
            pairs, times = np.unique(np.stack((doc[at], self.item[of]))[:, new], axis=1, return_counts=True)
            out += [(d, int(self.ids[i]), w, False) for d, i, w in zip(*pairs.tolist(), times.tolist(), strict=True)]
        return out


def _consistent_run(pairs: list) -> tuple[int, int]:
    """The longest run in which one item value stands for one document value, and names keep apart."""
    there, back, low, best = {}, {}, 0, (0, 0)
    for high, pair in enumerate(pairs):
        if pair:
            keys = [(there, pair[:2], pair[2])] + [(back, pair[2], pair[1])] * (pair[0] == NAME)
            while any(key in held and held[key][0] != want for held, key, want in keys):
                if (gone := pairs[low]) is not None:
                    for held, key in [(there, gone[:2])] + [(back, gone[2])] * (gone[0] == NAME):
                        held[key][1] -= 1
                        if not held[key][1]:
                            del held[key]
                low += 1
            for held, key, want in keys:
                held.setdefault(key, [want, 0])[1] += 1
        if high + 1 - low > best[1] - best[0]:
            best = low, high + 1
    return best


def slices(benchmark: DataFrame, item_col: str, text_col: str, window: int, least: int) -> list[Items]:
    """The benchmark as slices of bounded size, one broadcast each."""
    items = save(benchmark.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("_item"), F.col(text_col).alias("_text"),
        F.size(F.split(F.col(text_col), r"\s+")).cast("long").alias("_n")).distinct(), "benchmark")
    total = items.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    parts = -(-total // SLICE_WINDOWS)
    where = F.pmod(F.xxhash64("_item"), F.lit(max(parts, 1)))
    for part in range(parts):
        rows = items.filter(where == part).select("_item", "_text").collect()  # about SLICE_WINDOWS words
        yield Items([tuple(r) for r in rows], window, least)


def _finder(shared):
    @F.pandas_udf("items array<long>, windows long, changed boolean")
    def find(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for texts in series:
            items, windows, changed = [set() for _ in texts], [0] * len(texts), [False] * len(texts)
            raw = [t.encode() if isinstance(t, str) else b"" for t in texts]
            start = size = 0
            for i, t in enumerate(raw):
                size += len(t)
                if size >= 1 << 19 or i == len(raw) - 1:
                    for d, item, n, other in shared.value.matches(*templates.read(raw[start:i + 1])):
                        items[start + d].add(item)
                        windows[start + d] += n
                        changed[start + d] |= other
                    start, size = i + 1, 0
            yield pd.DataFrame({"items": [sorted(x) for x in items], "windows": windows, "changed": changed})
    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """``docs`` with one more column ``_leak``: items array<long>, windows long, changed boolean.

    ``items`` are the ids of the items found (empty: clean), ``windows`` the number of
    matching windows, ``changed`` whether a match has other numbers, names or units.
    """
    context = small_batches(docs).sparkSession.sparkContext
    hits = []
    for part in slices(benchmark, item_col, item_text_col, window, least):
        hits.append(_finder(context.broadcast(part))(F.col(text_col)))
    if not hits:
        empty = "named_struct('items', cast(array() as array<long>), 'windows', 0L, 'changed', false)"
        return docs.withColumn("_leak", F.expr(empty))
    if len(hits) == 1:
        return docs.withColumn("_leak", hits[0])
    names = [f"_leak{k}" for k in range(len(hits))]
    out = docs.withColumns(dict(zip(names, hits, strict=True)))

    def both(op, field):
        total = F.col(names[0])[field]
        for n in names[1:]:
            total = op(total, F.col(n)[field])
        return total

    return out.withColumn("_leak", F.struct(
        F.array_sort(F.array_distinct(both(lambda a, b: F.concat(a, b), "items"))).alias("items"),
        both(lambda a, b: a + b, "windows").alias("windows"),
        both(lambda a, b: a | b, "changed").alias("changed"))).drop(*names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """The clean rows of ``docs``, all columns."""
    return contaminated(docs, benchmark, **columns).filter(F.size("_leak.items") == 0).select(
        [F.col(f"`{c}`") for c in docs.columns])
