import random

import numpy as np

from scriptorium.llm import common, jaccard_join as jj, queries

from llm_tables import SF01, table  # noqa: F401


def sets(t, size=5):
    w = (t or "").encode().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, threshold=0.8):
    """(id, text) -> sorted (id, class, links)."""
    s = [sets(t) for _, t in rows]
    where = {}
    for n, x in enumerate(s):
        for g in x:
            where.setdefault(g, []).append(n)
    both = {}
    for ns in where.values():
        for i, a in enumerate(ns):
            for b in ns[i + 1:]:
                both[a, b] = both.get((a, b), 0) + 1
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, b), k in both.items():
        if rows[a][0] is not None and rows[b][0] is not None and k >= threshold * (len(s[a]) + len(s[b]) - k) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least.setdefault(find(n), []).append(i)
    return sorted(((i, None if i is None else min(least[find(n)]), links[n]) for n, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("_id", "class_id", "n_links").collect()), key=str)


def family(r, first, n, length, changes):
    base = [f"w{r.randint(0, 10**6)}" for _ in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(changes):
            w[r.randrange(length)] = f"x{r.randint(0, 10**6)}"
        out.append((first + i, " ".join(w)))
    return out


def test_matched_prefix_reaches_the_target():
    d = jj.matched_prefix()
    assert 1 - (1 - 0.8**d) ** jj.TREES >= jj.TARGET > 1 - (1 - 0.8 ** (d + 1)) ** jj.TREES


def test_against_brute_force(table, monkeypatch):
    r = random.Random(5)
    rows = family(r, 0, 30, 120, 1) + family(r, 100, 20, 60, 2) + family(r, 200, 5, 400, 3)
    rows += [(300 + n, " ".join(f"u{r.randint(0, 10**6)}" for _ in range(50))) for n in range(30)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "two words"), (404, "two  words"), (405, "words two"),
             (406, "one two three four five"), (None, "two words"), (None, None), (407, "same " * 3000),
             (408, "same " * 2000), (0, rows[0][1]), (900, rows[0][1] + " "), (901, rows[7][1])]
    want = brute(rows)
    assert got(jj.jaccard_classes(table(rows))) == want
    monkeypatch.setattr(jj, "CHUNK_TEXTS", 4)  # groups cut into tiles give the same
    assert got(jj.jaccard_classes(table(rows, 7))) == want
    kept = {x.doc_id for x in jj.near_dedup(table(rows)).collect()}
    assert kept == {c for i, c, _ in want}


def test_texts_under_one_id_are_apart(table):
    r = random.Random(3)
    near, far = family(r, 0, 3, 200, 1), family(r, 0, 2, 60, 40)
    a, b, c = (t for _, t in near)
    rows = [(1, a), (2, b), (2, far[0][1]), (3, far[1][1]), (4, far[0][1]), (3, "one"), (5, "one"), (2, c), (5, None)]
    docs = table(rows).selectExpr("*", "doc_id as _id", "'x' as _key")
    out = jj.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=str) == sorted(
        [(1, a), (2, far[0][1]), (3, far[1][1]), (3, "one"), (5, None)], key=str)
    assert sorted((x.doc_id, x.text) for x in jj.near_dedup(table([(1, "A"), (2, "A"), (2, "B")])).collect()) == [
        (1, "A"), (2, "B")]


def test_empty(table):
    assert got(jj.jaccard_classes(table([]))) == []


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [tuple(map(int, e)) for e in r.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    rows = [tuple(x) for x in common.components(df).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_query_against_brute_force(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op1_ngram_jaccard(spark, SF01)
    assert sorted((tuple(x) for x in out.select("doc_id", "class_id", "n_links").collect()), key=str) == brute(docs)
