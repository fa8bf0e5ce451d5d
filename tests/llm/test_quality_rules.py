import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import quality_rules as qr, queries

from llm_tables import SF01, table  # noqa: F401

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
    lines, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in lines
            lines.add(line)
    n, r = len(words), len(covered)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, r, n < 20 or 100 * r > 30 * n)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def base(out):
    return sorted((str(r._id), tuple(r[c] for c in BASE)) for r in out.collect())


TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h " * 4, "x " * 9, "x " * 8, "x y " * 100 + "# $ <tag> & | % *",
         "line one\nline one\n line one\n\n \nline one", "é ü \U0001F600 漢字 z\r\nq\x0bw\x0ce",
         " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i % 15}" for i in range(40)),
         " ".join(f"long{i}" for i in range(20000)) + " tail" + " rep" * 30]


def test_base_counts_against_brute_force(table):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4]), (4, TEXTS[4]), (4, "other")]
    out = qr.quality_rules(table(rows), None)
    assert base(out) == sorted((str(i), brute(t)) for i, t in rows)
    for r in out.collect():
        assert r.p_good == 1.0 and r.kept == (not r.base_failed) and not r.doubtful


def test_query_counts_and_verdicts(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op13_quality_rules(spark, SF01).withColumnRenamed("doc_id", "_id").cache()
    assert out.dtypes[:7] == [("_id", "bigint"), *[(c, "bigint") for c in BASE[:-1]], ("base_failed", "boolean")]
    assert base(out) == sorted((str(i), brute(t)) for i, t in docs)
    for r in out.collect():
        assert 0 <= r.p_good <= 1
        assert r.kept == (not r.base_failed and r.p_good >= qr.REJECT)
        assert r.doubtful == (qr.REJECT <= r.p_good < qr.DOUBT)


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    part = F.pmod(F.xxhash64(F.col("doc_id") + 17), F.lit(4))
    # Texts that also occur among the others are no fair test.
    digest = docs.select("doc_id", F.xxhash64("text").alias("h"))
    own = digest.join(known.filter(part > 0), "doc_id", "left_semi").select("h").distinct()
    fair = digest.join(own, "h", "left_anti").join(known.filter(part == 0), "doc_id").select("doc_id", "quality")
    model = qr.train(docs, known.filter(part > 0))
    got = qr.quality_rules(docs, model).join(fair, F.col("_id") == F.col("doc_id")).filter("not base_failed")
    rows = [(r.quality, r.p_good) for r in got.select("quality", "p_good").collect()]
    y, p = (np.array(x) for x in zip(*rows))
    assert (y == 1).sum() > 400 and (y == 0).sum() > 40
    assert (p[y == 1] >= qr.REJECT).mean() > 0.99
    assert (p[y == 0] < qr.REJECT).mean() > 0.9
    # Calibrated: the mean probability is the share of good rows.
    assert abs(p.mean() - y.mean()) < 0.03 and ((p - y) ** 2).mean() < 0.02


def test_labels_without_use(spark, table):
    docs = table([(i, f"word{i} and more text of number {i}") for i in range(20)])
    for rows in ([], [(i, 1, 0) for i in range(20)], [(i, q, 0) for i in range(20) for q in (0, 1)],
                 [(None, 0, 0), (None, 1, 1), (3, 7, 0), (4, None, 0), (99, 0, 0), (98, 1, 0)]):
        assert qr.train(docs, labels(spark, rows)) is None


def test_empty_repeated_rows_and_clashes(spark, table):
    assert qr.quality_rules(table([]), None).collect() == []
    assert qr.train(table([]), labels(spark, [(1, 0, 0), (2, 1, 0)])) is None
    good = [(i, f"this is a calm sentence with ordinary words number {i} in it") for i in range(60)]
    bad = [(100 + i, f"BUY!!! $$$ ### CLICK*** NOW%%% &&& {i} <<< FREE!!! $$$ ***") for i in range(60)]
    rows = good + bad + [bad[0]] * 200 + [(500, None), (501, "")]
    docs = table(rows).selectExpr("*", "1 as _id", "2 as _y", "3 as _h", "4 as _shard", "5 as _text", "6 as _label")
    marks = [(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad] * 2 + [(500, 0, 0), (501, 1, 0)]
    model = qr.train(docs, labels(spark, marks))
    out = {r._id: r for r in qr.quality_rules(docs, model).collect()}
    assert all(out[i].p_good >= 0.5 for i, _ in good) and all(out[i].p_good < 0.5 for i, _ in bad)
    again = qr.train(docs.repartition(7), labels(spark, marks))
    assert np.allclose(model.weights, again.weights) and model.slope == pytest.approx(again.slope)


def test_calibration_recovers_a_logistic_curve():
    z = np.arange(-40, 41) / 8
    n = 100000
    good = n / (1 + np.exp(-(2.0 * z - 1.0)))
    a, b = qr.calibration([(x, g, n - g) for x, g in zip(z, good)])
    assert (a, b) == pytest.approx((2.0, -1.0), abs=0.02)
    assert qr.calibration([]) == (1.0, 0.0) and qr.calibration([(1.0, 5, 0)]) == (1.0, 0.0)


def test_minimum_is_where_the_gradient_vanishes():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 12, replace=False)) for _ in range(80)]
    place, n = np.concatenate(rows), np.full(80, 12)
    value, y = rng.random(len(place)) * 3, (rng.random(80) < 0.4).astype(float)
    first, row = np.cumsum(n) - n, np.repeat(np.arange(80), n)
    f = lambda w: qr._objective(w, place, value, row, first, y)
    w = qr._minimum(np.zeros(51), f, steps=2000)
    assert np.abs(f(w)[1]).max() < 2e-4
    step = rng.standard_normal(51) * 1e-6
    assert f(w + step)[0] - f(w - step)[0] == pytest.approx(2 * f(w)[1] @ step, abs=1e-13)
