"""E2-E7 string cases (FIXTURES.md) and a property test of the single-pass join."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as tx


def cleaned(run):
    """The cleaning rule read off character by character: what a left-to-right scan takes out.

    A line break or tab; a brace group on one line; a backslash up to the first brace group after it
    on its line.
    """
    out, i = [], 0
    while i < len(run):
        line = run.find("\n", i)
        line = len(run) if line < 0 else line
        taken = 0
        if run[i] in "\r\n\t":
            taken = 1
        elif run[i] in "{\\":
            # A backslash may be followed by any characters before its group opens.
            start = i if run[i] == "{" else run.find("{", i, line)
            end = run.find("}", start + 1, line) if start >= 0 else -1
            taken = end + 1 - i if end >= 0 else 0
        out.append(" " if taken else run[i])
        i += taken or 1
    return "".join(out)


def py_join_runs(runs):
    """Each run cleaned, then all in one line, then without outer white space."""
    text = ""
    for n, run in enumerate(runs):
        text += (" " if n else "") + cleaned(run)
    while text and text[0].isspace():
        text = text[1:]
    while text and text[-1].isspace():
        text = text[:-1]
    return text if runs else None


def one(spark, col_expr, value, dtype=T.StringType()):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", dtype)]))
    return df.select(col_expr.alias("o")).first()["o"]


def test_clean_cases(spark):
    c = tx.clean_text(F.col("v"))
    assert one(spark, c, "a\tb") == "a b"
    assert one(spark, c, "a{x}b") == "a b"
    assert one(spark, c, "\\usepackage{k} t") == "  t"
    assert one(spark, c, "{p\nq}") == "{p q}"
    assert one(spark, c, "{p q}") == " "
    assert one(spark, c, "a  b") == "a  b"


def test_strip_unicode(spark):
    assert one(spark, tx.strip_text(F.col("v")), " a ") == "a"


def test_join_runs_cases(spark):
    arr = T.ArrayType(T.StringType())
    assert one(spark, tx.join_runs(F.col("v")), ["{a", "b}"], arr) == "{a b}"
    assert one(spark, tx.join_runs(F.col("v")), [], arr) is None
    assert one(spark, tx.join_runs(F.col("v")), [" x ", "\ty"], arr) == "x   y"


ALPHABET = st.sampled_from(list("ab {}\\\n\t\r    xé"))
RUNS = st.lists(st.text(ALPHABET, max_size=12), max_size=5)


@settings(max_examples=60, deadline=None)
@given(RUNS)
def test_join_runs_matches_python(spark, runs):
    got = one(spark, tx.join_runs(F.col("v")), runs, T.ArrayType(T.StringType()))
    assert got == py_join_runs(runs)


def test_article_text_forms(spark):
    df = spark.createDataFrame([("P1", "T", "A", "B")], "pmcid string, title string, abstract string, body_text string")
    row = df.select(tx.article_text().alias("a"), tx.article_text_keyed().alias("k"),
                    tx.embedding_text().alias("e")).first()
    assert row["a"] == "P1 T A B"
    assert row["k"] == "pmcid: P1\ntitle: T\nabstract: A\nbody_text: B"
    assert row["e"] == "T[SEP]A[SEP]B"
