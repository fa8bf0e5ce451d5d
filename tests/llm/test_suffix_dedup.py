import random

from scriptorium.llm import queries, suffix_dedup as sd

from llm_tables import SF01, table  # noqa: F401


def covered(rows, size, left=0, right=0):
    """Words of windows of ``size`` words that also start earlier, but for words at their ends, per id."""
    texts = {i: (t or "").encode().split() for i, t in rows if i is not None}
    first, out = {}, {}
    for i in sorted(texts):
        w, gone = texts[i], set()
        for p in range(len(w) - size + 1):
            if first.setdefault(tuple(w[p:p + size]), (i, p)) != (i, p):
                gone.update(range(p + left, p + size - right))
        out[i] = gone
    return out


def check(rows, result, gap, least):
    must, may = covered(rows, gap - 1 + least, gap - 1, gap - 1), covered(rows, least)
    assert sorted(str(r._id) for r in result) == sorted(str(i) for i, _ in rows)
    n = 0
    for r in result:
        got = {p for s in r.spans for p in range(s.start, s.end)}
        assert len(got) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        if r._id is None:
            assert not got
            continue
        assert must[r._id] <= got <= may[r._id], r._id
        n += len(got)
    return n


def passages(seed):
    r = random.Random(seed)
    shared = [[f"p{k}_{j}" for j in range(r.randint(8, 40))] for k in range(6)]
    rows = []
    for n in range(50):
        w = []
        for _ in range(r.randint(0, 5)):
            w += [f"u{r.randint(0, 10**9)}" for _ in range(r.randint(0, 15))]
            w += r.choice(shared)[r.randint(0, 3):]
        rows.append((n, " ".join(w)))
    return rows


def test_found_and_reported(table):
    rows = passages(1) + [(100, None), (101, ""), (102, "a " * 200), (103, "a " * 90), (None, "a " * 90)]
    rows += [(3, rows[3][1]), (200, rows[7][1]), (201, rows[7][1])]
    for gram, gap, prefix in ((3, 4, 8), (4, 6, 12)):
        out = sd.repeated_passages(table(rows, 5), gram, gap, prefix)
        result = out.collect()
        assert check(rows, result, gap, prefix) > 500
        kept = dict(tuple(x) for x in sd.without_passages(table(rows), out).filter("_id is not null").collect())
        for x in result:
            if x._id is not None:
                w = (dict(rows)[x._id] or "").split()
                gone = {p for s in x.spans for p in range(s.start, s.end)}
                assert kept[x._id] == " ".join(v for p, v in enumerate(w) if p not in gone)


def test_extension_reaches_the_passage_ends(table):
    body = [f"b{n}" for n in range(30)]
    rows = [(1, " ".join(["x", "y", *body, "z"])), (2, " ".join(["q", *body, "r", "s"]))]
    out = {r._id: [tuple(s) for s in r.spans] for r in sd.repeated_passages(table(rows), 3, 4, 8).collect()}
    assert out == {1: [], 2: [(1, 31)]}


def test_empty(table):
    assert sd.repeated_passages(table([])).collect() == []


def test_query_against_brute_force(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    result = queries.op5_suffix_dedup(spark, SF01).withColumnRenamed("doc_id", "_id").collect()
    assert check(rows, result, 11, 40) > 1000
