import re

import pytest

from scriptorium.llm import decontaminate as dc, queries

from llm_tables import SF01, table  # noqa: F401

ITEMS = [
    (1, "Yesterday the farmer called Anna Miller sold 12 crates of pears to Peter Brown for 30 euros each and kept 12 for Anna ."),
    (2, "one short item that has just nine template words"),
    (3, "too short to use"),
    (4, None), (None, "the item without an id has quite a number of words in it so it could match"),
    (5, "the river rises in the north, crosses seven valleys and reaches the sea after 300 km of slow water"),
    (6, "the river rises in the north, crosses seven valleys and reaches the sea after 300 km of slow water"),
]
DOCS = [
    (10, "Some words. " + ITEMS[0][1] + " More words."),
    (11, "yes. Yesterday the farmer called Berta Meier sold 15 crates of pears to Paul Green for 90 euros each and kept 15 for Berta ."),
    (12, "Yesterday the farmer called Berta Meier sold 15 crates of pears to Paul Green for 90 euros each and kept 16 for Clara ."),
    (13, "Yesterday the farmer called Berta Berta sold 15 crates of pears to Berta Green for 90 euros each and kept 15 for Berta ."),
    (14, "x y z One short item that has just nine template words q"),
    (15, "too short to use"), (16, None), (17, ""), (18, " \n"),
    (19, "So (the river rises in the North crosses 9 valleys AND reaches the sea after 41 miles of slow water!"),
    (20, "so the river rises in the north, crosses seven valleys and reaches\n the  sea after 300 km, of slow water, " * 400),
    (None, ITEMS[4][1]),
    (21, "the farmer called sold crates of pears to for each and kept for"),
    (10, "Some words. " + ITEMS[0][1] + " More words."),
]


@pytest.fixture()
def items(spark):
    return spark.createDataFrame([(i, t, 3) for i, t in ITEMS] * 2, "item_id long, text string, windows int")


@pytest.mark.parametrize("slice_windows", [10, 10**6])
def test_cases(table, items, monkeypatch, slice_windows):
    monkeypatch.setattr(dc, "SLICE_WINDOWS", slice_windows)
    docs = table(DOCS)
    out = dc.contaminated(docs, items).select("doc_id", "text", "_leak.*").collect()
    assert len(out) == len(DOCS)
    found = {(r.doc_id, tuple(r["items"]), r.changed) for r in out if r["items"]}
    assert found == {(10, (1,), False), (11, (1,), True), (14, (2,), False), (20, (5, 6), False), (19, (5, 6), True)}
    clean = dc.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(["12", "13", "15", "16", "17", "18", "None", "21"])


LONG = "the miller of {a} had {n} sacks of flour and sold {n} of them at once to the old baker who lived behind the " \
       "church near the bridge and then went home to {a} with a purse full of coins and {n} empty sacks under his arm"


@pytest.mark.parametrize("item, doc, changed", [
    ("Compute 3 + 4 * 5 - 6 / 2 + 8 =", "Now: compute 3 + 4 * 5 - 6 / 2 + 8 = ?", False),
    ("Compute 3 + 4 * 5 - 6 / 2 + 8 =", "Now: compute 3 + 4 * 5 - 6 / 2 + 9 = ?", None),
    ("What is the capital of France?", "He asked: what is the capital of France? Paris.", False),
    ("What is the capital of France?", "What is the capital of Spain?", None),
    ("法国的首都是哪个城市？", "请问，法国的首都是哪个城市？答案是巴黎。", False),
    ("法国的首都是哪个城市？", "西班牙的首都是哪个城市？", None),
    ("Anna sold 12 pears to her friends. Berta bought 5 of them for 3 euros.",
     "Carla sold 14 pears to her friends. Doris bought 6 of them for 4 euros.", True),
    ("Anna sold 12 pears to her friends. Berta bought 5 of them for 3 euros.",
     "We saw that Carla sold 14 pears to her friends. Doris bought 6 of them for 4 euros.", True),
    ("The farmer sold 12 pears to her friends. Berta bought 5 of them for 3 euros.",
     "So the farmer sold 14 pears to her friends. Doris bought 6 of them for 4 euros.", True),
    (LONG.format(a="Ulm", n=9), LONG.format(a="Ulm", n=9).replace("9 empty", "8 empty"), False),
    (LONG.format(a="Ulm", n=9), LONG.format(a="Bern", n=7).replace("7 empty", "8 empty"), True),
])
def test_whole_job(table, spark, item, doc, changed):
    """Exact copies of any kind, openers that are names, and consistent parts of a longer match."""
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    [row] = dc.contaminated(table([(1, doc)]), items).select("_leak.*").collect()
    assert (row["items"], row.changed) == (([7], changed) if changed is not None else ([], False))


def test_empty(table, items):
    assert dc.contaminated(table([]), items).collect() == []
    assert dc.decontaminate(table(DOCS), items.limit(0)).count() == len(DOCS)


def test_kinds():
    kinds = {"12": 1, "3,000.5": 1, "$5": 1, "Seven": 1, "50%": 1, "km": 2, "Hours.": 2, "5kg": 3, "(Anna)": 4, "NASA": 0,
             "word,": 0, "--": 5, "é": 0}
    assert {w: dc.kind_of(w)[0] for w in kinds} == kinds


def test_query_against_brute_force(spark):
    """The planted passages hold no slots that change: template equality is equality of bare lower-case words."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SF01}/benchmark.parquet").collect()

    def bare(t):
        return [w for w in (x.strip(dc._PUNCT).lower() for x in t.split()) if w]
    grams = {}
    for b in bench:
        w = bare(b.text)
        size = min(13, len(w))
        for p in range(len(w) - size + 1):
            grams.setdefault(tuple(w[p:p + size]), set()).add(b.item_id)
    assert min(len(bare(b.text)) for b in bench) >= 13
    want = {}
    for d in docs:
        w = bare(d.text)
        want[d.doc_id] = sorted(set().union(*(grams.get(tuple(w[p:p + 13]), ()) for p in range(len(w) - 12))))
    got = {r.doc_id: r for r in queries.op3_decontaminate(spark, SF01).collect()}
    assert {i: r["items"] for i, r in got.items()} == want and any(want.values())
    assert all(r.contaminated == bool(r["items"]) for r in got.values())
