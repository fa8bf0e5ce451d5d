"""Stores with several writers (S9, A6), replayed epochs, durable answers (A4)."""

import threading

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import answers as ans
from scriptorium.operators import cache as ch
from scriptorium.sources import config as cfg
from scriptorium.sources.files import Folder
from scriptorium.streaming import requests as rq

KEYS = [f"{k}_summary" for k in cfg.AUDIENCES]


def wide(spark, rows):
    """``(id, text)`` pairs as wide answers."""
    return spark.createDataFrame([(i, *[f"{k} {t}" for k in KEYS]) for i, t in rows],
                                 ", ".join(f"{c} string" for c in (ch.STORE_KEY, *KEYS)))


def content(df):
    return {r[ch.STORE_KEY]: r[KEYS[0]].split(" ", 1)[1] for r in df.collect()}


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    store = ch.SummaryStore(spark, str(tmp_path / "s"))
    failed, start = [], threading.Barrier(4)

    def work(w):
        try:
            start.wait()
            for n in range(3):
                store.save(wide(spark, [(f"k{w}-{n}", "x"), ("shared", f"{w}-{n}")]))
        except Exception as exc:  # noqa: BLE001
            failed.append(exc)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert len(store._numbers("batch")) == 12
    got = content(store.read())
    assert set(got) == {"shared"} | {f"k{w}-{n}" for w in range(4) for n in range(3)}


def test_a_number_is_claimed_once(spark, tmp_path):
    folder, won = Folder(spark, str(tmp_path)), []
    threads = [threading.Thread(target=lambda: won.append(folder.create("_claims/1"))) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 7 + [True]


def test_a_writer_killed_in_mid_save_leaves_the_store_readable(spark, tmp_path, monkeypatch):
    store = ch.SummaryStore(spark, str(tmp_path / "s"))
    store.save(wide(spark, [("a", "1")]))

    def dies(*_):
        raise RuntimeError("killed")

    for step in ("publish", "create"):
        with monkeypatch.context() as m:
            m.setattr(store.folder, step, dies)
            with pytest.raises(RuntimeError):
                store.save(wide(spark, [("a", "lost"), ("b", "lost")]))
        assert content(store.read()) == {"a": "1"}
    bad = wide(spark, [("c", "1")]).withColumn(KEYS[0], F.raise_error(F.lit("task fails")))
    with pytest.raises(Exception):
        store.save(bad)
    store.save(wide(spark, [("b", "2")]))
    assert content(store.read()) == {"a": "1", "b": "2"}


def test_compaction(spark, tmp_path):
    store = ch.SummaryStore(spark, str(tmp_path / "s"), buckets=8)
    assert store.compact() is None
    store.save(wide(spark, [(f"k{i}", "old") for i in range(200)]))
    store.save(wide(spark, [(f"k{i}", "new") for i in range(0, 200, 2)]))
    want = {f"k{i}": "old" if i % 2 else "new" for i in range(200)}
    assert content(store.read()) == want
    first = store.compact()
    assert store.compact() == first  # nothing new to merge
    store.save(wide(spark, [("k1", "later"), ("z", "later")]))
    want |= {"k1": "later", "z": "later"}
    before = store.read()  # planned on the batches as they are
    assert content(store.read()) == want
    store.compact()
    assert content(before) == want  # not yet vacuumed
    assert store.vacuum() == 4 and store._numbers("batch") == []
    assert content(store.read()) == want
    some = spark.createDataFrame([("k1",), ("k4",), ("none",)], "pmc_id string")
    assert content(store.read(some)) == {"k1": "later", "k4": "new"}
    files = {r.f for r in store.raw(some).select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) <= 4  # the buckets of three keys, of eight
    store.save(wide(spark, [("k4", "last")]))
    assert content(store.read(some)) == {"k1": "later", "k4": "last"}


def test_tokens(spark, tmp_path, monkeypatch):
    store = ch.SummaryStore(spark, str(tmp_path / "s"))
    n = store.save(wide(spark, [("a", "1")]), token="q/1")
    never = wide(spark, [("a", "2")]).withColumn(KEYS[0], F.raise_error(F.lit("computed again")))
    assert store.save(never, token="q/1") == n and content(store.read()) == {"a": "1"}
    # Dead between the claim and the rename: the next run finishes under the same number.
    with monkeypatch.context() as m:
        m.setattr(store.folder, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.save(wide(spark, [("b", "1")]), token="q/2")
    assert not store.was_saved("q/2")
    assert store.save(wide(spark, [("b", "2")]), token="q/2") == n + 1
    store.compact()
    store.vacuum()
    assert store.was_saved("q/1") and store.save(never, token="q/1") == n
    assert content(store.read()) == {"a": "1", "b": "2"}


def tree(path):
    return sorted(str(p) for p in path.rglob("*"))


def test_a_replayed_epoch_writes_nothing(spark, tmp_path):
    store = ch.SummaryStore(spark, str(tmp_path / "s"))
    arts = spark.createDataFrame([(1, "P1"), (2, "P2")], "corpus_id long, pmcid string")
    calls = []

    def compute(todo):
        ids = sorted(r.request_id for r in todo.collect())
        calls.append(ids)
        return wide(spark, [(i, f"call {len(calls)}") for i in ids])

    handle = rq.epoch_handler(spark, store, arts, compute, str(tmp_path / "ckpt"))
    batch = spark.createDataFrame([("P1",), ("P1",), ("nobody",), (None,)], "request_id string")
    handle(batch, 0)
    files, answers = tree(tmp_path), content(store.read())
    handle(batch, 0)
    assert tree(tmp_path) == files and content(store.read()) == answers == {"P1": "call 1"}
    # The driver died after the save, before the epoch was finished: only the report is written.
    Folder(spark, store.path).delete("_unknown")
    handle(batch, 0)
    assert calls == [["P1"]] and store._numbers("batch") == [1]
    handle(spark.createDataFrame([("P2",), ("P1",)], "request_id string"), 1)
    assert calls == [["P1"], ["P2"]] and content(store.read()) == {"P1": "call 1", "P2": "call 2"}
    assert [(r.request_id, r.epoch) for r in rq.unknown_requests(spark, store).collect()] == [("nobody", 0)]


def counting_client(folder):
    """A client that counts its calls in a folder (workers are other processes), and fails for some
    prompts while told so."""

    class Client:
        def generate(self, system, text, temperature):
            import os
            import uuid

            open(f"{folder}/calls/{uuid.uuid4().hex}", "w").close()
            if os.path.exists(f"{folder}/broken") and text.endswith("7"):
                raise RuntimeError("client fails")
            return None if text == "no answer" else f"{system}|{text}|{temperature}"

    return Client


def test_durable_answers_ask_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    folder = str(tmp_path)
    prompts = spark.createDataFrame(
        [(f"r{i}", a, "sys", f"text {i % 40}") for i in range(50) for a in ("x", "y")] + [("n", "x", None, "no answer")],
        "request_id string, audience string, system string, text string").repartition(4)
    make = counting_client(folder)
    group = 10
    durable = ans.DurableAnswers(spark, f"{folder}/answers", make, 0.5, group_rows=group)
    (tmp_path / "broken").touch()
    with pytest.raises(Exception):
        durable(prompts)
    asked = len(list((tmp_path / "calls").iterdir()))
    written = durable.stored().count()
    (tmp_path / "broken").unlink()
    out = {(r.request_id, r.audience): r.summary for r in ans.attach_answers(prompts, durable).collect()}
    assert out == {(f"r{i}", a): f"sys|text {i % 40}|0.5" for i in range(50) for a in ("x", "y")} | {("n", "x"): None}
    total = len(list((tmp_path / "calls").iterdir()))
    # Groups are dealt by hash, so that one may hold twice its share; a failed task is tried once in local mode.
    assert total <= 41 + 2 * group and total - asked == 41 - written
    ans.attach_answers(prompts, durable).count()
    assert len(list((tmp_path / "calls").iterdir())) == total + 1  # the prompt without an answer
    hotter = ans.DurableAnswers(spark, f"{folder}/answers", make, 0.9)
    assert hotter(prompts.filter("request_id = 'r1' and audience = 'x'")).first().summary == "sys|text 1|0.9"
    with pytest.raises(ValueError):
        ans.DurableAnswers(spark, folder, make, group_rows=0)
