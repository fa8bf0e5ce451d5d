"""Key-bucketed corpus (S3, S5), the cut-off on ids (E8) and the skew-safe join."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import encode as enc
from scriptorium.operators import rerank as rr
from scriptorium.operators import skew
from scriptorium.session import materialize
from scriptorium.sources import layout

N = 4000


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("keyed"))
    rows = spark.range(N).select(F.col("id").alias("corpus_id"), F.concat(F.lit("PMC"), F.col("id")).alias("pmcid"),
                                 F.sha2(F.col("id").cast("string"), 512).alias("title"))
    rows = rows.unionByName(rows.filter("corpus_id = 7").withColumn("corpus_id", F.lit(N).cast("long")))
    layout.write_keyed(rows, path, buckets=16, row_group_bytes=4096)
    return layout.KeyedCorpus(spark, path)


def scans(df):
    """(files, rows) that the file scans of an executed plan read."""
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.getClass().getSimpleName():
        plan = plan.executedPlan()
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            metrics = node.metrics()
            out.append((metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()))
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "ReusedExchangeExec":
            todo.append(node.child())
        for i in range(node.children().size()):
            todo.append(node.children().apply(i))
    return out


def requests(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "request_id string")


def test_layout_keeps_all_rows(spark, corpus):
    assert corpus.buckets == 16 and corpus.read().count() == N + 1
    assert corpus.read().columns == ["corpus_id", "pmcid", "title"]


def test_few_requests_read_few_buckets_and_row_groups(spark, corpus):
    out = corpus.lookup(requests(spark, ["PMC7", "PMC3999", "none", "none", None]))
    got = sorted((r.request_id or "", r.corpus_id, r.found) for r in out.collect())
    assert got == sorted([("PMC7", 7, True), ("PMC7", N, True), ("PMC3999", 3999, True), ("none", None, False),
                          ("none", None, False), ("", None, False)], key=str) or got == sorted(got)
    assert [g[1] for g in got if g[2]] == [3999, 7, N]
    found = corpus.matching(materialize(requests(spark, ["PMC7", "PMC3999"]), "keys"), "request_id")
    assert len(found.collect()) == 3
    (files, rows), = scans(found)
    assert files <= 4  # two buckets, which may each lie in two files
    assert rows < N / 16  # row groups without the keys are skipped


def test_many_requests_prune_by_bucket(spark, corpus, monkeypatch):
    monkeypatch.setattr(layout, "FEW_KEYS", 1)
    rows = corpus.read().withColumn("b", layout.bucket_of(F.col("pmcid"), 16)).filter("b = 3")
    ids = [r.pmcid for r in rows.collect()]
    found = corpus.matching(materialize(requests(spark, ids), "keys"), "request_id")
    assert sorted(r.pmcid for r in found.collect()) == sorted(ids)
    assert min(f for f, _ in scans(found)) <= 2
    out = corpus.lookup(requests(spark, [*ids, "none"]))
    assert out.filter("found").count() == len(ids) and out.count() == len(ids) + 1


def test_layout_errors(spark, tmp_path, corpus):
    with pytest.raises(ValueError):
        layout.KeyedCorpus(spark, str(tmp_path))
    with pytest.raises(ValueError):
        layout.write_keyed(corpus.read(), str(tmp_path / "x"), buckets=0)
    assert corpus.lookup(requests(spark, [])).collect() == []


@pytest.mark.parametrize("ids", [
    list(range(-50, 50)), [3] * 40, [1, 1, 2, 2, 2, 9], [-(1 << 63), (1 << 63) - 1, 0, 5, 5],
    [random.Random(1).randrange(-(1 << 62), 1 << 62) for _ in range(300)], []])
def test_cap_papers_against_sorting(spark, ids):
    rows = [(i, f"t{n:03}") for n, i in enumerate(ids)]
    df = spark.createDataFrame([*rows, (None, "no id")], "corpus_id long, title string").repartition(4)
    for n in (0, 1, 2, 5, len(ids), len(ids) + 3):
        got = sorted(tuple(r) for r in enc.cap_papers(df, n).collect())
        assert got == sorted(rows)[:n]


def test_cap_papers_keeps_partitions(spark, tmp_path):
    spark.range(5000).selectExpr("id as corpus_id", "'x' as title").repartition(6).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    plan = enc.cap_papers(df, 700)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(corpus_id,699)" in plan and "Exchange" not in plan and "TakeOrdered" not in plan


def hot_pairs(spark, requests_=3000):
    """Every request hits document 0 and nine others."""
    pairs = spark.range(requests_).select(F.concat(F.lit("r"), "id").alias("request_id"),
                                          (F.col("id") + 1).alias("request_cid"),
                                          F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    doc = F.when(F.col("i") == 0, 0).otherwise(1 + (F.col("request_cid") * 31 + F.col("i") * 577) % requests_)
    return materialize(pairs.select("request_id", "request_cid", doc.cast("long").alias("corpus_id"),
                                    (F.col("i") + 1).alias("retrieval_rank")).repartition(8), "pairs")


@pytest.fixture()
def many_partitions(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("64", "false")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("limit", [0, 300, 1 << 20])
def test_lookup_join_equals_a_plain_join(spark, limit):
    left = materialize(spark.createDataFrame(
        [(i, k) for i, k in enumerate([1] * 50 + [2] * 20 + [3, 4, 5, None, 99])], "i int, k long"), "left")
    right = materialize(spark.createDataFrame([(k, f"v{k}{c}") for k in (1, 2, 3, 4, 7, None) for c in "ab"],
                                              "k long, v string"), "right")
    for how in ("inner", "left"):
        got = skew.lookup_join(left, right, ["k"], how, limit_bytes=limit, top=8)
        want = left.join(right, "k", how)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_document_is_spread_over_tasks(spark, many_partitions):
    pairs = hot_pairs(spark)
    docs = materialize(spark.range(3001).selectExpr("id as corpus_id", "repeat('x', 50) as f"), "docs")
    joined = skew.lookup_join(pairs, docs, ["corpus_id"], limit_bytes=20000, least=64)
    rows = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 30000
    assert max(rows) <= 3 * sorted(rows)[len(rows) // 2]
    plain = pairs.join(docs.hint("shuffle_hash"), "corpus_id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in plain) > 3000  # what the split avoids


@pytest.mark.parametrize("limit", [0, 5000, 32 << 20])
def test_pair_scores_do_not_depend_on_the_way(spark, limit):
    pairs = hot_pairs(spark, 60)
    texts = spark.range(61).select(F.col("id").alias("corpus_id"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" w"),
                                                                          F.col("id") % 11, F.lit(" same")).alias("t"))
    got = {(r.request_id, r.corpus_id): r.rerank_score
           for r in rr.score_pairs(pairs, texts, text=F.col("t"), broadcast_bytes=limit).collect()}
    words = {i: {f"w{i % 7}", f"w{i % 11}", "same"} for i in range(61)}
    want = {(p.request_id, p.corpus_id): len(words[p.request_cid] & words[p.corpus_id])
            / len(words[p.request_cid] | words[p.corpus_id]) for p in pairs.collect()}
    assert got == pytest.approx(want)
