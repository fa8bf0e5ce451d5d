import re

import corpus_pipeline as cp
import sentencepiece
from scriptorium.llm import decontaminate as dc, sentencepiece_sampler as ss

import test_jaccard_join as near
from llm_tables import SF01


def bare(t):
    return [w for w in (x.strip(dc._PUNCT).lower() for x in t.split()) if w]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "exact", "near", "benchmark", "encode"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    first = cp.quality_stage(spark, docs, SF01)
    assert first.columns == docs.columns
    left = {r.doc_id: r.text for r in first.collect()}  # the model itself is tested in test_quality
    good = {r.doc_id for r in spark.read.parquet(f"{SF01}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & set(left)) > 0.98 * len(good & set(rows)) and len(left) < len(rows)
    groups = {}
    for i, t in left.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    left = {min(g)[1]: left[min(g)[1]] for g in groups.values()}
    keep = {c for _, c, _ in near.brute(sorted(left.items()))}
    left = {i: t for i, t in left.items() if i in keep}
    grams = {tuple(w[p:p + 13]) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()
             for w in [bare(r.text)] for p in range(len(w) - 12)}
    left = {i: t for i, t in left.items()
            if not any(tuple(w[p:p + 13]) in grams for w in [bare(t)] for p in range(len(w) - 12))}
    out = cp.run(spark, SF01).collect()
    assert sorted(r.doc_id for r in out) == sorted(left)
    sp = sentencepiece.SentencePieceProcessor(model_file=ss.MODEL)
    assert all(r.lossless and sp.decode(r.ids) == left[r.doc_id] for r in out)


def test_stages_keep_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF01)
        assert out.columns == docs.columns and out.collect() == []
    assert cp.encode_stage(spark, docs, SF01).collect() == []


def test_quality_stage_tells_letters_of_any_script(spark, tmp_path):
    """Every letter but the Latin ones was one symbol, so that junk in them looked like text."""
    words = {"ru": "быстрая коричневая лиса прыгает через ленивую собаку".split(),
             "el": "η γρήγορη καφέ αλεπού πηδάει πάνω από τον σκύλο".split()}
    rows = [(100 * k + n, " ".join(own[(n * (j + 3) + j * j) % len(own)] for j in range(25 + n % 7)), lang)
            for k, (lang, own) in enumerate(words.items()) for n in range(40)]
    junk = [(1000 + k, " ".join("".join(chr(base + (7 * i * i + j * 13 + k) % 24) for j in range(len(w)))
                                for i, w in enumerate(rows[40 * k][1].split())), lang)
            for k, (lang, base) in enumerate((("ru", 0x0430), ("el", 0x03B1)))]
    spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    assert sorted(map(tuple, cp.quality_stage(spark, docs, str(tmp_path)).collect())) == sorted(rows)
