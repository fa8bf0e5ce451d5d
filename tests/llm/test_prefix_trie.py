import hashlib
import zlib

import numpy as np
import pytest

from scriptorium.llm import prefix_trie as pt, queries

from llm_tables import SF01


def brute(rows):
    """The trie by its definition: every rebuilt conversation as a tuple of turns."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), tie, (role, text)))
    turns = {c: [t[2] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = turns.get(base, [])[:h] + own[h:]
    member, ends = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            member.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    kids = {}
    for node in member:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(member, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        own = (len(member[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in below)
    out = set()
    for node, cs in member.items():
        text = ",".join(str(c) for c in sorted(ends.get(node, [])))
        out.add((min(cs), len(node), min(member[node[:-1]]) if node else None, len(cs), len(kids.get(node, [])),
                 leaves[node], saved[node], hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(out):
    rows = [tuple(r) for r in out.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows],
                                 "conv_id long, turn long, role string, text string, depth int, _c string").repartition(3)


def test_arithmetic():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, pt.PRIME, 500, dtype=np.uint64) for _ in range(2))
    a[:3], b[:3] = pt.PRIME - 1, [pt.PRIME - 1, 0, 1]
    assert pt.times(a, b).tolist() == [int(x) * int(y) % pt.PRIME for x, y in zip(a, b)]
    e = rng.integers(0, 1 << 40, 50, dtype=np.uint64)
    assert pt.power(12345, e).tolist() == [pow(12345, int(x), pt.PRIME) for x in e]


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    out = queries.op11_prefix_trie(spark, SF01)
    assert out.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in COLUMNS]
    assert got(out) == brute(rows)


def random_rows(seed):
    """Few different turns, so that prefixes are shared and chains nest."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(np.arange(-12, 60)).tolist():
        for t in range(int(rng.integers(1, 13))):
            rows.append((c, t, ["user", "bot"][t % 2], ["a", "bé", "", "c c"][int(rng.integers(0, 2 + seed % 3))]))
    return rows


@pytest.mark.parametrize("seed", range(1))
def test_random(spark, monkeypatch, seed):
    monkeypatch.setattr(pt, "BLOCK", 4)
    monkeypatch.setattr(pt, "CHUNK", 3)
    rows = random_rows(seed)
    assert got(pt.prefix_trie(frame(spark, rows))) == brute(rows)


def test_collisions_are_found_and_settled(spark):
    rows = random_rows(2)[:80]
    assert got(pt.prefix_trie(frame(spark, rows), seeds=(0, 1))) == brute(rows)
    with pytest.raises(ArithmeticError):
        pt.prefix_trie(frame(spark, rows), seeds=(0,))


def test_edges(spark):
    assert pt.prefix_trie(frame(spark, [])).collect() == []
    hot = [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, None, None, None), (1, 0, "user", "tie"),
            (1, 0, "bot", "tie"), (1, 0, "user", "tie"), (5, 2, "user", "x" * 300000), (7, 1, "a", "b"),
            (2, 10, "user", "\U0001F600"), (2, -3, "", "neg"), (-7, 1, "a", "b"), *hot,
            *[(3, t, "user", f"long {t % 7}") for t in range(500)]]
    assert got(pt.prefix_trie(frame(spark, rows))) == brute(rows)
