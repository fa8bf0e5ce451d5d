import math
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from scriptorium.llm import queries, sentencepiece_sampler as ss

from llm_tables import SF01, table  # noqa: F401

TEXTS = [None, "", " ", "a", "the the  the", "x\n\n y\t", "▁ literal ▁▁", "\U0001F600 é ß 漢字",
         "no" * 3000, " " * 70, "<s> </s> <0x41> <unk>", "\x00\x1f ", "end "]


@pytest.fixture(scope="module")
def lattice():
    return ss.Lattice(ss.model_bytes(ss.MODEL), alpha=2e-4)


def ways(lattice, sp, text):
    """Brute force: every segmentation of a short text with its weight."""
    names = {sp.id_to_piece(i): i for i in range(sp.get_piece_size())
             if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    s = "▁" + text.replace(" ", "▁")

    def go(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in names:
                for tail, w in go(rest[k:]):
                    yield (names[rest[:k]], *tail), w + lattice.weight[names[rest[:k]]]
    return dict(go(s))


def test_samples_follow_the_lattice(lattice):
    sp = sentencepiece.SentencePieceProcessor(model_file=ss.MODEL)
    text, n = "there on", 20000
    all_ways = ways(lattice, sp, text)
    total = sum(math.exp(w) for w in all_ways.values())
    ids, sizes = lattice.sample([text] * n, np.arange(n).astype(np.uint64))
    ends = np.cumsum(sizes)
    seen = Counter(tuple(ids[b - s:b].tolist()) for b, s in zip(ends, sizes))
    assert set(seen) <= set(all_ways)
    for way, w in all_ways.items():
        p = math.exp(w) / total
        assert abs(seen[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    assert len(seen) > 3


def test_round_trip_and_library_decoder(spark, table):
    sp = sentencepiece.SentencePieceProcessor(model_file=ss.MODEL)
    rows = list(enumerate(TEXTS)) + [(None, "no key"), (4, TEXTS[4])]
    out = ss.encode(table(rows), check=True)
    got = out.collect()
    assert all(r.lossless for r in got) and len(got) == len(rows)
    back = {(r._id, r.text) for r in ss.decode(out).collect()}
    assert back == {(i, t or "") for i, t in rows}
    for r in got:
        text = dict(rows)[r._id] or ""
        if "▁" not in text:
            assert sp.decode(r.ids) == text and len(r.ids) == r.n_tokens
    assert len({tuple(r.ids) for r in got if r._id == 4}) == 1
    assert ss.encode(table([])).collect() == []


def test_same_row_same_pieces_in_any_layout(table):
    rows = [(n, "others were sampling the segmentations") for n in range(200)]
    a = {r._id: r.ids for r in ss.encode(table(rows, 1), alpha=2e-4).collect()}
    b = {r._id: r.ids for r in ss.encode(table(rows[::-1], 7), alpha=2e-4).collect()}
    assert a == b and len({tuple(v) for v in a.values()}) > 20


def test_query_is_lossless(spark):
    out = queries.op10_sentencepiece(spark, SF01)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=ss.MODEL)
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.lossless and r.n_tokens == len(r.ids) and sp.decode(r.ids) == docs[r.doc_id] for r in rows)
