"""PII: keyed surrogates for detected entities, in DataFrame functions only.

Found are e-mail addresses, IP addresses, card numbers (with a right check digit),
social security and phone numbers, account numbers, secrets (access keys, and values
after ``password=``, ``token =`` and the like) and names (after a title, or a listed
first name before a surname). The surrogate of an entity is a function of the secret
key, its type and its canonical form alone, so the same entity gets the same
surrogate in every document and notation; it has the type and format of the original:
length, case, separators and alphabet, a right check digit, the same top-level domain,
and for names the gender (from title or list) and the script.

Collision check: all distinct entities are drawn again, with the next attempt number,
where two share a surrogate or a surrogate is a real entity, until none is left. The
few drawn again reach their documents as a map; every other surrogate is computed in
place, so texts are not shuffled for them.

Edge cases: null texts stay null, empty ones empty; texts without entities are
unchanged; rows without an id, and repeated rows, are treated like all others; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, save

KEY = "replace-this-key"
MAX_ROUNDS = 32

# Titles by gender, and first names that are recognised without a title.
TITLES_F = "Mrs Ms Miss Madam Frau Madame Mme Señora Sra".split()
TITLES_M = "Mr Sir Herr Monsieur Señor Sr".split()
TITLES = [*TITLES_F, *TITLES_M, "Dr", "Prof", "г-жа", "г-н"]
NAMES_F = "Anna Maria Emma Sophie Laura Julia Mary Elizabeth Sarah Emily Marie Claire Carmen Lucía Elena Ольга Анна".split()
NAMES_M = "John James Peter Paul Michael Thomas David Robert Hans Pierre Jean José Carlos Juan Miguel Иван Сергей".split()

_ANY_TITLE, _ANY_NAME = "|".join(TITLES), "|".join(NAMES_F + NAMES_M)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,63}"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
CARD = r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
         r"|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")
ACCOUNT = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
ACCESS = r"\bAKIA[0-9A-Z]{16}\b"
SECRET = r"\b(?i:password|passwd|pwd|secret|api_key|apikey|token)\s?[=:]\s?\"?[^\s\"]+"
NAME = (rf"\p{{Lu}}(?<=\b(?:{_ANY_TITLE})\.? \p{{Lu}})\p{{L}}+"
        rf"|\p{{Lu}}(?<=\b(?:{_ANY_TITLE})\.? \p{{Lu}}\p{{Ll}}{{1,15}} \p{{Lu}})\p{{Ll}}+"
        rf"|\b(?:{_ANY_NAME})\b(?= \p{{Lu}}\p{{Ll}})|\p{{Lu}}(?<=\b(?:{_ANY_NAME}) \p{{Lu}})\p{{Ll}}+")
# No pattern matches inside a word but for digits after a letter: said once, before all of them.
ENTITY = (r"(?:(?<![A-Za-z0-9])|(?<=[A-Za-z])(?=\d))(?:"
          + "|".join([EMAIL, IP, CARD, SSN, PHONE, ACCOUNT, ACCESS, SECRET, NAME]) + ")")
_LEAD = r"^\w+\s?[=:]\s?\"?"

_LATIN = "bdfghjklmnprstvaeiou"
_CYRILLIC = "бдфгхйклмнпрствaеиоу".replace("a", "а")
_GREEK = "βδφγχξκλμνπρστψαειου"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _luhn(digits: Column) -> Column:
    """The check sum of a digit string, from the right, the last digit counted singly."""
    n = F.char_length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def kind_of(m: Column, women: Column, men: Column) -> Column:
    """The type of a match; null for digits that are no card."""
    def full(pattern):
        return m.rlike(f"^(?:{pattern})$")

    return (F.when(m.contains("@"), "email").when(full(IP), "ip")
            .when(full(r"[\d -]{13,23}") & ~full(r"\d{3}-\d{2}-\d{4}"), F.when(_luhn(_digits(m)) % 10 == 0, "card"))
            .when(full(r"\d{3}-\d{2}-\d{4}"), "ssn").when(full(r"[+(\d][\d ().-]+"), "phone")
            .when(m.rlike("^AKIA"), "access").when(full(r"[A-Z]{2}\d{2}[A-Z0-9]+"), "account")
            .when(m.rlike(_LEAD), "secret")
            .when(F.array_contains(women, m) | m.isin(NAMES_F), "name f")
            .when(F.array_contains(men, m) | m.isin(NAMES_M), "name m").otherwise("name"))


def canonical(m: Column, kind: Column) -> Column:
    """What all notations of an entity share."""
    return (F.when(kind == "email", F.lower(m)).when(kind.isin("card", "ssn"), _digits(m))
            .when(kind == "phone", _let(_digits(m), lambda d: F.when(F.char_length(d) > 10, F.right(d, F.lit(10))).otherwise(d)))
            .when(kind == "secret", F.regexp_replace(m, _LEAD, ""))
            .when(F.substring(kind, 1, 4) == "name", F.lower(m)).otherwise(m))


def _shaped(text: Column, digest: Column) -> Column:
    """Every letter and digit replaced by one of its kind, from the digest."""
    def one(i):
        h = F.conv(F.substring(digest, (i * 2 - 1) % 126 + 1, F.lit(2)), 16, 10).cast("int")
        c = F.substring(text, i, F.lit(1))

        def pick(letters):
            return F.substring(F.lit(letters), h % len(letters) + 1, F.lit(1))

        return (F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
                .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"\p{IsCyrillic}"), pick(_CYRILLIC))
                .when(c.rlike(r"\p{IsGreek}"), pick(_GREEK)).when(c.rlike(r"\p{Ll}"), pick("àâäçèéêëîïñòóöùûü")).otherwise(c))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), one), "")


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, F.lit(key)), 512)


def _syllables(digest: Column, kind: Column, text: Column, attempt: Column) -> Column:
    """A pronounceable name with an ending of the gender, in the script of ``text``."""
    def at(k, letters):
        h = F.conv(F.substring(digest, F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("int")
        return F.substring(F.lit(letters), h % len(letters) + 1, F.lit(1))

    consonants, vowels = _LATIN[:15], _LATIN[15:]
    body = F.concat(*[at(k, consonants if k % 2 == 0 else vowels) for k in range(6)],
                    F.when(attempt > 0, F.concat(at(6, consonants), at(7, vowels))).otherwise(""))
    name = F.concat(body, F.when(kind == "name f", F.concat(at(8, "lnr"), F.lit("a")))
                    .when(kind == "name m", at(8, "nrsk")).otherwise(F.concat(at(8, "lnrd"), F.lit("er"))))
    return (F.when(text.rlike(r"\p{IsCyrillic}"), F.translate(name, _LATIN, _CYRILLIC))
            .when(text.rlike(r"\p{IsGreek}"), F.translate(name, _LATIN, _GREEK)).otherwise(name))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the replacement."""
    own = _digest(key, kind, canon, attempt.cast("string"))

    def octet(digest, k, least, n):
        return (F.conv(F.substring(digest, F.lit(4 * k + 1), F.lit(4)), 16, 10).cast("int") % n + least).cast("string")

    def card(digest):
        first = F.concat(F.substring(canon, 1, 1), _shaped(F.substring(canon, F.lit(2), F.char_length(canon) - 2), digest))
        return _let(first, lambda f: F.concat(f, ((10 - _luhn(F.concat(f, F.lit("0"))) % 10) % 10).cast("string")))

    def email(digest):
        domain = F.substring_index(canon, "@", -1)
        top = F.substring_index(domain, ".", -1)
        rest = F.substring(domain, F.lit(1), F.char_length(domain) - F.char_length(top))
        return F.concat(_shaped(F.substring_index(canon, "@", 1), digest), F.lit("@"),
                        _let(_digest(key, F.lit("domain"), domain), lambda d: _shaped(rest, d)), top)

    def any_kind(digest):
        hexed = F.translate(_shaped(F.translate(canon, "abcdef", "000000"), digest), "ghijklmnopqrstuvwxyz", "abcdefabcdefabcdefab")
        return (F.when(kind == "email", email(digest))
                .when(kind == "ip", F.concat_ws(".", octet(digest, 0, 1, 223), octet(digest, 1, 0, 256), octet(digest, 2, 0, 256),
                                                octet(digest, 3, 1, 254)))
                .when(kind == "card", card(digest))
                .when(kind == "access", F.concat(F.lit("AKIA"), _shaped(F.substring(canon, 5, 100), digest)))
                .when(kind == "account", F.concat(F.substring(canon, 1, 2), _shaped(F.substring(canon, 3, 100), digest)))
                .when((kind == "secret") & canon.rlike("^[0-9a-f]{8,}$"), hexed)
                .when(F.substring(kind, 1, 4) == "name", _syllables(digest, kind, canon, attempt))
                .otherwise(_shaped(canon, digest)))

    return _let(own, any_kind)


def rendered(m: Column, kind: Column, value: Column) -> Column:
    """The surrogate in the notation of the match."""
    seen = F.char_length(_digits(m)) - F.char_length(value)  # country code digits stay

    def digit(i):
        c = F.substring(m, i, F.lit(1))
        k = F.char_length(_digits(F.substring(m, F.lit(1), i))) - seen
        return F.when(c.rlike("[0-9]") & (k > 0), F.substring(value, k, F.lit(1))).otherwise(c)

    def case(i):
        v = F.substring(value, i, F.lit(1))
        return F.when(F.substring(m, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(v)).otherwise(v)

    places = F.sequence(F.lit(1), F.char_length(m))
    return (F.when(kind.isin("card", "ssn", "phone"), F.array_join(F.transform(places, digit), ""))
            .when(kind == "email", F.array_join(F.transform(places, case), ""))
            .when(kind == "secret", F.concat(F.regexp_extract(m, _LEAD, 0), value))
            .when(F.substring(kind, 1, 4) == "name", F.when((m == F.upper(m)) & (F.char_length(m) > 1), F.upper(value))
                  .otherwise(F.initcap(value))).otherwise(value))


def _genders(text: Column) -> tuple[Column, Column]:
    """First names that follow a title of each gender."""
    def after(titles):
        return F.regexp_extract_all(text, F.lit(rf"\b(?:{'|'.join(titles)})\.? (\p{{Lu}}\p{{L}}+)(?= \p{{Lu}}\p{{Ll}})"), F.lit(1))

    return after([*TITLES_F, "г-жа"]), after([*TITLES_M, "г-н"])


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _kind, _canon)`` of every entity, stored once."""
    women, men = _genders(F.col("_text"))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).withColumn(
        "_m", F.regexp_extract_all("_text", F.lit(ENTITY), F.lit(0))).filter(F.size("_m") > 0)
    rows = rows.select("_id", women.alias("_w"), men.alias("_n"), F.explode("_m").alias("_m"))
    rows = rows.withColumn("_kind", kind_of(F.col("_m"), F.col("_w"), F.col("_n"))).filter("_kind is not null")
    return save(rows.select("_id", "_kind", canonical(F.col("_m"), F.col("_kind")).alias("_canon")), "entities")


def redrawn(entities: DataFrame, key: str) -> DataFrame | None:
    """``(_kind, _canon, _attempt)`` of the entities that need another attempt than the first."""
    known = save(entities.select("_kind", "_canon").distinct(), "distinct-entities")
    real = known.select(F.col("_kind").alias("_k"), F.col("_canon").alias("_v"))
    todo, settled, out = known, None, None
    for attempt in range(MAX_ROUNDS):
        drawn = save(todo.select("_kind", "_canon", surrogate(
            F.col("_kind"), F.col("_canon"), F.lit(attempt), key).alias("_value")), "drawn")
        taken = real if settled is None else real.union(settled)
        first = drawn.groupBy("_kind", "_value").agg(F.min("_canon").alias("_first"))
        checked = drawn.join(first, ["_kind", "_value"]).join(
            taken.distinct().withColumn("_taken", F.lit(True)),
            (F.col("_kind") == F.col("_k")) & (F.col("_value") == F.col("_v")), "left")
        lost = (F.col("_canon") != F.col("_first")) | F.coalesce("_taken", F.lit(False))
        checked = save(checked.select("_kind", "_canon", "_value", lost.alias("_lost")), "checked")
        won = checked.filter("not _lost")
        settled_now = won.select(F.col("_kind").alias("_k"), F.col("_value").alias("_v"))
        settled = settled_now if settled is None else settled.union(settled_now)
        if attempt:
            part = won.select("_kind", "_canon", F.lit(attempt).alias("_attempt"))
            out = part if out is None else out.union(part)
        todo = checked.filter("_lost").select("_kind", "_canon")
        if todo.isEmpty():
            return out
    raise ValueError(f"surrogates still collide after {MAX_ROUNDS} attempts")


def with_surrogates(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns: ``_surrogates`` (the new text) and ``_n_entities``."""
    found = _found(docs, id_col, text_col)
    again = redrawn(found, key)
    out = docs
    if again is not None:
        name = F.concat("_kind", F.lit("|"), "_canon")
        maps = found.join(save(again, "redrawn"), ["_kind", "_canon"]).groupBy("_id").agg(
            F.map_from_entries(F.collect_set(F.struct(name, "_attempt"))).alias("_attempts"))
        maps = broadcast_if_small(save(maps.withColumnRenamed("_id", "_map_id"), "attempts"), 200_000)
        out = out.join(maps, out[id_col].cast("long").eqNullSafe(F.col("_map_id")), "left").drop("_map_id")
        attempts = F.col("_attempts")
    else:
        attempts = F.expr("cast(null as map<string,int>)")
    text = F.col(text_col)
    women, men = _genders(text)
    out = out.withColumn("_m", F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).withColumn(
        "_g", F.when(F.size("_m") > 0, F.struct(women.alias("w"), men.alias("n"))))

    def replaced(m):
        def by_kind(kind):
            def by_canon(canon):
                attempt = F.coalesce(F.try_element_at(attempts, F.concat(kind, F.lit("|"), canon)), F.lit(0))
                return _let(surrogate(kind, canon, attempt, key), lambda value: rendered(m, kind, value))
            return F.when(kind.isNull(), m).otherwise(_let(canonical(m, kind), by_canon))
        return _let(kind_of(m, F.col("_g.w"), F.col("_g.n")), by_kind)

    pieces = F.split(text, ENTITY, -1)
    new = F.transform(F.col("_m"), replaced)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.array_append(new, F.lit("")), lambda a, b: F.array(a, b))), "")
    kinds = F.filter(F.col("_m"), lambda m: kind_of(m, F.col("_g.w"), F.col("_g.n")).isNotNull())
    out = out.withColumn("_surrogates", F.when(F.size("_m") > 0, joined).otherwise(text)).withColumn(
        "_n_entities", F.when(F.size("_m") > 0, F.size(kinds)).otherwise(0).cast("long"))
    return out.drop("_m", "_g", "_attempts")
