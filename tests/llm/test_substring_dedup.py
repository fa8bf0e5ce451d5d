import hashlib
import random

from scriptorium.llm import queries, substring_dedup as sd
from scriptorium.llm.words import U, Words, least_in_window

import numpy as np

from llm_tables import SF01, table  # noqa: F401


def brute(rows, window=20):
    """rows: (id, text); windows judged on the input, first start wins."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts[i] = (t or "").encode().split()
    first = {}
    for i in sorted(texts):
        w = texts[i]
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), (i, p))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p:p + window])] != (i, p):
                gone.update(range(p, p + window))
        kept = b" ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_words_and_windows():
    r = random.Random(1)
    texts = [b" ".join(bytes(r.choices(b"abc", k=r.randint(1, 3))) for _ in range(r.randint(0, 12)))
             for _ in range(40)] + [b"", b"  a\x0bb\t\n", "\u00a0x \x1f".encode()]
    words, flat = Words(texts), [x for t in texts for x in t.split()]
    assert [words.buffer[a:b] for a, b in zip(words.start, words.end)] == flat
    codes = words.codes()
    assert len({*zip(flat, codes.tolist())}) == len(set(flat)) == len(set(codes.tolist()))
    for size in (1, 3, 5):
        codes_of, whole = words.windows(codes, size, 1), words.whole(size)
        seen, at = {}, 0
        for t in texts:
            w = t.split()
            for j in range(len(w)):
                fits = j + size <= len(w)
                assert bool(at + j < len(whole) and whole[at + j]) == fits
                if fits:
                    assert seen.setdefault(tuple(w[j:j + size]), codes_of[at + j]) == codes_of[at + j]
            at += len(w)
        assert len(set(seen.values())) == len(seen)
    values = np.array(r.choices(range(5), k=200), dtype=U)
    offset = least_in_window(values, 7)
    assert all(o == list(values[i:i + 7]).index(min(values[i:i + 7])) for i, o in enumerate(offset))


def test_small_windows_against_brute_force(table, monkeypatch):
    r = random.Random(3)
    rows = [(n, " ".join(r.choice("ab") for _ in range(r.randint(0, 40)))) for n in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "a b a b a b a b a b"), (103, "a " * 300),
             (104, "a " * 300), (104, "a " * 300), (7, rows[7][1])]
    assert got(sd.substring_dedup(table(rows), 6, 3)) == brute(rows, 6)
    monkeypatch.setattr(sd, "_FLUSH", 8)
    assert got(sd.substring_dedup(table(rows), 6, 6)) == brute(rows, 6)


def test_empty_table(table):
    assert got(sd.substring_dedup(table([]))) == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()
    out = queries.op9_substring_dedup(spark, SF01)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute([tuple(r) for r in docs])
