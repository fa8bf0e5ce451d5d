import hashlib
import re

import pytest

from scriptorium.llm import exact_dedup as ed

from llm_tables import table  # noqa: F401


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        w = min(g)
        out.append((i, w[3], len(g), (-len(t or ""), i) == (w[0], w[3]), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = ([(n, "hot text") for n in range(50, 20, -1)] + [(1, "hot  text\n"), (2, "a b"), (3, "ab"), (4, "a\u00a0b"),
        (5, None), (6, ""), (7, " "), (None, "ab"), (None, "only null"), (8, "x" * 50000), (9, "x" * 50000),
        (10, "\U0001F600 é"), (11, "\U0001F600é"), (12, "same"), (12, "same")])


@pytest.mark.parametrize("top_k", [1, 2, 256])
def test_against_brute_force(table, top_k):
    out = ed.exact_groups(table(ROWS), top_k=top_k, max_items=1024)
    got = sorted((tuple(r) for r in out.select("_id", "_keep", "_size", "_kept", "_digest").collect()), key=str)
    assert got == brute(ROWS)


def test_filter_keeps_one_of_each(table):
    docs = table(ROWS)
    kept = ed.exact_dedup(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted({norm(r.text) for r in rows}) == sorted({norm(t) for _, t in ROWS})
    assert 1 in {r.doc_id for r in rows} and 2 in {r.doc_id for r in rows}


@pytest.mark.parametrize("rows,want", [
    ([(1, "a b"), (1, "ab")], [(1, "a b")]), ([(1, "A"), (2, "A"), (2, "B")], [(1, "A"), (2, "B")]),
    ([(None, "A"), (2, "A"), (None, "B"), (None, None), (3, "")], [(2, "A"), (None, "B"), (3, "")]),
    ([(1, "A"), (1, "A"), (2, "A")], [(1, "A"), (1, "A")])])
def test_filter_judges_texts_under_one_id_apart(table, rows, want):
    docs = table(rows).selectExpr("*", "doc_id as _id", "'x' as _digest", "5 as _n")
    out = ed.exact_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_empty_and_native(table):
    empty = table([])
    assert ed.exact_groups(empty).collect() == [] and ed.exact_dedup(empty).collect() == []
    plan = ed.exact_groups(table(ROWS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
