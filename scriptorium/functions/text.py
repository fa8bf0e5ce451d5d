"""Column expressions for text cleaning and article text assembly.

All of these are built-in Spark expressions: they stay in the JVM and inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that define the results.
#
# Cleaning pattern: each match becomes one space. Braces are escaped for Java;
# (?d) makes '.' stop only at '\n', as in Python.
CLEAN_PATTERN = r"(?d)[\r\n\t]|\{.*?\}|\\.*?\{.*?\}"
# The same pattern for RE2 (DuckDB), used by the SQL oracles.
CLEAN_PATTERN_RE2 = r"[\r\n\t]|\{.*?\}|\\.*?\{.*?\}"
# Characters removed by strip(): exactly Python's str.isspace() set.
WHITESPACE_CLASS = (
    r"[\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Token pattern for the lexical encoder and scorer: runs of letters or digits.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# Article fields in their fixed order, and the embedding defaults.
ARTICLE_FIELDS = ("pmcid", "title", "abstract", "body_text")
EMBEDDING_FIELDS = ("title", "abstract", "body_text")
EMBEDDING_SEPARATOR = "[SEP]"
# ---------------------------------------------------------------------------

STRIP_PATTERN = rf"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$"
# The same characters as a literal set for TRIM(BOTH ... FROM ...).
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                    + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Replace line breaks, tabs, ``{...}`` groups and ``\\name...{...}`` spans by one space.

    Without a ``{`` only the single characters can match: plain replacements, several times faster.
    """
    plain = c = _col(c)
    for sign in "\r\n\t":
        plain = F.replace(plain, F.lit(sign), F.lit(" "))
    return F.when(F.contains(c, F.lit("{")), F.regexp_replace(c, CLEAN_PATTERN, " ")).otherwise(plain)


def strip_text(c) -> Column:
    """Remove leading and trailing white space (Python's ``str.strip()`` set)."""
    return F.btrim(_col(c), F.lit(WHITESPACE_CHARS))


def join_runs(runs) -> Column:
    """Clean every run, join with one space, strip; an empty list gives null.

    Computed as one cleaning pass over the runs joined by ``\n``: no match of
    the pattern can span a ``\n`` (``.`` stops there and ``\n`` is only
    consumed alone, becoming the joining space), so the result is the same as
    cleaning run by run, in one regular-expression pass instead of one per run.
    """
    runs = _col(runs)
    joined = strip_text(clean_text(F.array_join(runs, "\n")))
    return F.when(F.size(runs) > 0, joined)


def is_present(c) -> Column:
    """True for a non-null value with at least one non-space character."""
    c = _col(c)
    return c.isNotNull() & (F.length(strip_text(c)) > 0)


def article_text(fields=ARTICLE_FIELDS) -> Column:
    """E5: field values joined by one space, in field order."""
    return F.concat_ws(" ", *[F.col(f) for f in fields])


def article_text_keyed(fields=ARTICLE_FIELDS) -> Column:
    """``key: value`` lines joined by a newline."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), F.col(f)) for f in fields])


def embedding_text(fields=EMBEDDING_FIELDS, sep: str = EMBEDDING_SEPARATOR) -> Column:
    """The chosen columns joined by the separator, without spaces."""
    return F.concat_ws(sep, *[F.col(f) for f in fields])


def tokens(c) -> Column:
    """Lower-case runs of letters and digits, in text order (duplicates kept)."""
    parts = F.split(F.lower(_col(c)), TOKEN_SPLIT)
    return F.filter(parts, lambda t: F.length(t) > 0)


def token_set(c) -> Column:
    """Distinct tokens of a text."""
    return F.array_distinct(tokens(c))
