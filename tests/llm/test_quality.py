import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import quality as q, queries

from llm_tables import SF01, table  # noqa: F401


def symbols(t):
    return [int(x) for x in q._alphabet()[[ord(c) for c in "   " + t]]]


def brute(texts):
    """Interpolated modified Kneser-Ney by definition: a function (context, symbol) -> probability."""
    grams = Counter()
    for t in texts:
        s = symbols(t)
        grams.update(tuple(s[i:i + 4]) for i in range(len(s) - 3))
    counts = {4: grams}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    disc, by_ctx = {}, {}
    for n, c in counts.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else None
        disc[n] = [0.0]
        for d in (1, 2, 3):
            v = d - (d + 1) * y * k[d + 1] / k[d] if k[d] and y is not None else 0.5 * d
            disc[n].append(max(0.1, min(float(d), v)))
        by_ctx[n] = defaultdict(dict)
        for g, x in c.items():
            by_ctx[n][g[:-1]][g[-1]] = x

    def prob(ctx, w):
        n = len(ctx) + 1
        low = prob(ctx[1:], w) if n > 1 else 1 / 32
        seen = by_ctx[n].get(ctx)
        if not seen:
            return low
        total, mass = sum(seen.values()), sum(disc[n][min(x, 3)] for x in seen.values())
        x = seen.get(w, 0)
        return max(x - disc[n][min(x, 3)], 0) / total + mass / total * low
    return prob


def test_model_is_kneser_ney(table):
    texts = ["The cat sat. The cat ran!", "a dog; 12 cats & a hat", "", "tattarattat " * 30, "é Ünï 漢"]
    df = table(list(enumerate(texts))).select(F.lit("=en").alias("_lang"), F.col("text").alias("_text"))
    tables = {r._lang: np.exp(np.frombuffer(r.logs, np.float32).astype(float)) for r in q.log_probabilities(df).collect()}
    assert set(tables) == {"=en", "*"} and np.allclose(tables["=en"], tables["*"])
    p = tables["=en"].reshape(-1, 32)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    prob = brute(texts)
    for ctx in [(26, 26, 26), (19, 7, 4), (0, 19, 26), (1, 2, 3), (31, 30, 29), (0, 19, 19)]:
        row = p[ctx[0] * 1024 + ctx[1] * 32 + ctx[2]]
        assert np.allclose(row, [prob(ctx, w) for w in range(32)], atol=1e-6)


def test_edge_rows(spark, table):
    good = [(n, f"the quiet river ran over the stones and the mill {n}") for n in range(40)]
    rows = good + [(50, None), (51, ""), (52, "$$$ %%% &&& ### " * 40), (53, "x"), (None, "the river ran"), (0, good[0][1])]
    labels = spark.createDataFrame([(n, 1, 0) for n in range(40)] * 2 + [(52, 0, 0), (99, 1, 0), (None, 1, 0), (51, 1, None)],
                                   "doc_id long, quality int, toxic int")
    docs = table(rows)
    kept = q.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(i) for i, _ in rows if i != 52)
    other = docs.withColumn("lang", F.lit(None).cast("string"))  # labels only cover another language
    out = q.judged(other, q.train(docs, labels)).select("doc_id", "_quality.*").collect()
    assert {r.doc_id for r in out if not r.kept} == {52} and len(out) == len(rows)
    none = q.judged(docs, q.train(docs, labels.filter("quality = 5")))
    assert all(r._quality.kept and r._quality.perplexity is None for r in none.collect())
    assert q.quality_filter(table([]), labels).collect() == []


def test_languages_without_a_model_use_all_text(spark, table):
    good = [(n, f"the quiet river ran over the stones and the mill {n}") for n in range(40)]
    docs = table([*good, (50, ""), (52, "$$$ %%% &&& ### " * 40), (53, "the mill ran over the quiet river")])
    lang = F.when(F.col("doc_id") < 40, "en").when(F.col("doc_id") == 50, "xx")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 53, "xx").otherwise(lang))
    labels = spark.createDataFrame([(n, 1, 0) for n in [*range(40), 50]], "doc_id long, quality int, toxic int")
    model = q.train(docs, labels)
    for more in (0, 1001):  # as many other languages that no document here has
        model.names = sorted([*model.names, *(f"=other{n}" for n in range(more))])
        out = q.judged(docs, model).select("doc_id", "_quality.kept").collect()
        assert {r.doc_id: r.kept for r in out} == {i: i != 52 for i in [*range(40), 50, 52, 53]}


@pytest.fixture(scope="module")
def halves(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, labels.filter("doc_id % 2 = 0")


def test_held_out_accuracy(halves):
    docs, labels, half = halves
    out = q.judged(docs, q.train(docs, half)).join(labels.filter("doc_id % 2 = 1"), "doc_id").select(
        "quality", "_quality.kept").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2


def test_query_against_brute_force(spark):
    out = {r.doc_id: r for r in queries.op2_quality(spark, SF01).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF01}/labels.parquet").filter("quality=1 and toxic=0").collect()}
    assert set(out) == set(docs)
    own = [docs[i].text for i in sorted(trusted) if i in docs and docs[i].lang == "es"]
    prob = brute(own)

    def nats(t):
        s = symbols(t)
        return -sum(math.log(prob(tuple(s[i:i + 3]), s[i + 3])) for i in range(len(s) - 3)), len(t)
    sums = [nats(t) for t in own]
    mean = sum(a for a, _ in sums) / sum(n for _, n in sums)
    smooth = sorted((a + 100 * mean) / (n + 100) for a, n in sums)
    limit = math.exp(smooth[math.ceil(0.99 * len(smooth)) - 1]) * q.MARGIN
    some = [i for i in docs if docs[i].lang == "es"][::7]
    for i in some:
        a, n = nats(docs[i].text)
        assert math.isclose(out[i].perplexity, math.exp((a + 100 * mean) / (n + 100)), rel_tol=1e-4)
        assert math.isclose(out[i].threshold, limit, rel_tol=1e-3) and out[i].kept == (out[i].perplexity <= out[i].threshold)


def test_documents_meet_the_shards_by_joins(spark, table, monkeypatch):
    """20 languages, several parts each: the sums are those of the whole tables, and the driver sends no table."""
    def sent(*_):
        raise AssertionError("a table goes through the driver")
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", sent)
    monkeypatch.setattr(q, "PART", 150, raising=False)
    words = ["river", "Stone", "mill 12", "ran & hid", "été, sûr", "漢 字"]
    rows = [(n, " ".join(words[(n * k + k) % 6] for k in range(1, 5 + n % 7))) for n in range(120)]
    docs = table([*rows, (200, None), (None, "river"), (None, "river")]).withColumn(
        "lang", F.when(F.col("doc_id") < 120, F.concat(F.lit("l"), F.col("doc_id") % 20)).otherwise("none"))
    labels = spark.createDataFrame([(n, 1, 0) for n in range(0, 120)], "doc_id long, quality int, toxic int")
    out = q.judged(docs, q.train(docs, labels)).select("doc_id", "text", "lang", "_quality.*").collect()
    assert len(out) == 123 and len([r for r in out if r.doc_id is None]) == 2
    tables = {r._lang: np.frombuffer(r.logs, np.float32).astype(float) for r in q.log_probabilities(docs.filter(
        "doc_id < 120").select(F.concat(F.lit("="), "lang").alias("_lang"), F.col("text").alias("_text"))).collect()}
    assert len(tables) == 21

    def nats(lang, text):
        s = symbols(text)
        return -sum(tables[lang][((s[i] * 32 + s[i + 1]) * 32 + s[i + 2]) * 32 + s[i + 3]] for i in range(len(s) - 3))
    sums, size = defaultdict(float), Counter()
    for n, text in rows:
        for lang in (f"=l{n % 20}", "*"):
            sums[lang] += nats(f"=l{n % 20}", text)
            size[lang] += len(text)
    for r in out:
        lang, text = "=" + r.lang if "=" + r.lang in tables else "*", r.text or ""
        smooth = (nats(lang, text) + 100 * sums[lang] / size[lang]) / (len(text) + 100)
        assert math.isclose(r.perplexity, math.exp(smooth), rel_tol=1e-6)


def test_columns_named_like_helpers_stay(spark, table):
    good = [(n, f"the quiet river ran over the stones and the mill {n}") for n in range(40)]
    docs = table([*good, (52, "$$$ %%% &&& ### " * 40)])
    for name in ("_model", "_quality", "_e", "_lang", "_own", "_part", "_codes"):
        docs = docs.withColumn(name, F.col("doc_id") + 1)
    kept = q.quality_filter(docs, spark.createDataFrame([(n, 1, 0) for n in range(40)], "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.filter("doc_id < 40").collect()))


def brute_every(texts):
    """The same by definition over characters: a function text -> nats."""
    counts = {4: Counter(("   " + t)[i:i + 4] for t in texts for i in range(len(t)))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    disc, seen = {}, {}
    for n, c in counts.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else None
        disc[n] = [0.0] + [max(0.1, min(float(d), d - (d + 1) * y * k[d + 1] / k[d] if k[d] and y is not None else 0.5 * d))
                           for d in (1, 2, 3)]
        seen[n] = defaultdict(dict)
        for g, x in c.items():
            seen[n][g[:-1]][g[-1]] = x

    def prob(g):
        n, low = len(g), prob(g[1:]) if len(g) > 1 else 2.0**-16
        own = seen[n].get(g[:-1])
        if not own:
            return low
        x, total = own.get(g[-1], 0), sum(own.values())
        return max(x - disc[n][min(x, 3)], 0) / total + sum(disc[n][min(v, 3)] for v in own.values()) / total * low
    return lambda t: -sum(math.log(prob(("   " + t)[i:i + 4])) for i in range(len(t)))


@pytest.mark.parametrize("part, held", [(1 << 23, 1 << 21), (150, 40)])
def test_model_of_all_characters_against_brute_force(table, spark, monkeypatch, part, held):
    monkeypatch.setattr(q, "PART", part)
    monkeypatch.setattr(q, "HELD", held)
    words = ["river", "Stone", "mill 12", "ran & hid", "été, sûr", "漢 字", "быстрая лиса", "한국어", "\ufffd😀\u0000"]
    rows = [(n, " ".join(words[(n * k + k + n % 4) % 9] for k in range(1, 5 + n % 7))) for n in range(80)]
    other = [(200, None), (201, ""), (None, "river"), (None, "river"), (202, "лиса ZZZ 龍"), (0, rows[0][1]), (0, "Stone 12")]
    docs = table([*rows, *other]).withColumn(
        "lang", F.when(F.col("doc_id") < 80, F.concat(F.lit("l:"), F.col("doc_id") % 4)).when(F.col("doc_id") != 202, "none"))
    labels = spark.createDataFrame([(n, 1, 0) for n in range(0, 80) if n % 2 or n % 3], "doc_id long, quality int, toxic int")
    out = q.judged(docs, q.train(docs, labels, every=True)).select("doc_id", "text", "lang", "_quality.*").collect()
    assert len(out) == 87
    good = [(f"l:{i % 4}", t) for i, t in [*rows, *other[-2:]] if i is not None and i < 80 and (i % 2 or i % 3)]
    nats, limits = {}, {}
    for lang in ["*", *sorted({x for x, _ in good})]:
        nats[lang] = brute_every([t for x, t in good if lang in ("*", x)])
    scored = [(x, nats[x](t), len(t)) for x, t in good]
    for lang in nats:
        own = [(a, n) for x, a, n in scored if lang in ("*", x)]
        mean = sum(a for a, _ in own) / sum(n for _, n in own)
        smooth = sorted((a + 100 * mean) / (n + 100) for a, n in own)
        limits[lang] = mean, math.exp(smooth[math.ceil(0.99 * len(smooth)) - 1]) * q.MARGIN
    for r in out:
        lang, text = r.lang if r.lang in nats else "*", r.text or ""
        mean, limit = limits[lang]
        assert math.isclose(r.perplexity, math.exp((nats[lang](text) + 100 * mean) / (len(text) + 100)), rel_tol=1e-6)
        assert math.isclose(r.threshold, limit, rel_tol=1e-3) and r.kept == (r.perplexity <= r.threshold)


def test_held_out_accuracy_of_all_characters(halves):
    docs, labels, half = halves
    out = q.judged(docs, q.train(docs, half, every=True)).join(labels.filter("doc_id % 2 = 1"), "doc_id").select(
        "quality", "_quality.kept").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2


def test_edges_of_the_model_of_all_characters(spark, table):
    good = [(n, f"the quiet river ran over the stones and the mill {n}") for n in range(40)]
    docs = table([*good, (50, None), (51, ""), (52, "$$$ %%% &&& ### " * 40), (53, "x")])
    labels = spark.createDataFrame([(n, 1, 0) for n in range(40)], "doc_id long, quality int, toxic int")
    kept = q.quality_filter(docs, labels, every=True)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [*range(40), 50, 51, 53]
    assert q.quality_filter(docs, labels.filter("quality = 5"), every=True).count() == 44
    assert q.quality_filter(table([(0, ""), (1, None), (2, "x")]), labels.limit(2), every=True).count() == 3
    assert q.quality_filter(table([]), labels, every=True).collect() == []


def test_query_counts_all_characters_too(spark, table, tmp_path, monkeypatch):
    """The verdict over 32 symbols stays; beside it stands that of the model of the characters themselves."""
    monkeypatch.setattr(q, "PART", 400)
    good = [(n, f"быстрая коричневая лиса бежит через поле и реку {n}") for n in range(40)]
    other = [(50, None), (51, ""), (52, "ъъщщ эээфф ццц жжжж ьььь " * 40), (53, good[0][1]), (53, good[0][1]), (None, "река")]
    docs = table([*good, *other])
    labels = spark.createDataFrame([(n, 1, 0) for n in range(40)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = queries.op2_quality(spark, str(tmp_path)).collect()
    assert len(out) == 46
    nats = brute_every([t for _, t in good])
    mean = sum(nats(t) for _, t in good) / sum(len(t) for _, t in good)
    text = dict([*good, *other])
    for r in out:
        t = text[r.doc_id] or ""
        assert math.isclose(r.every_perplexity, math.exp((nats(t) + 100 * mean) / (len(t) + 100)), rel_tol=1e-6)
        assert r.every_kept == (r.every_perplexity <= r.every_threshold) == (r.doc_id != 52) and r.kept
    alone = {(r.doc_id, r._quality) for r in q.judged(docs, q.train(docs, labels)).collect()}
    assert alone == {(r.doc_id, (r.perplexity, r.threshold, r.kept)) for r in out}
    labels.filter("false").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    none = queries.op2_quality(spark, str(tmp_path)).collect()
    assert len(none) == 46 and all(r.kept and r.every_kept and r.every_perplexity is None for r in none)
