"""Many small XML files: how they are written, listed and parsed."""

import os

from pyspark.sql import functions as F

from scriptorium.sources import articles as src
from scriptorium.sources import files


def test_files_lie_in_few_folders_and_are_listed_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FOLDER_FILES", 50)
    rows = [(i % 280, f"<a>{i} é</a>") for i in range(300)] + [(300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, xml string").repartition(2)
    files.write_files(docs, str(tmp_path / "x"), "doc_id", "xml", "xml")
    found = {os.path.join(d, n) for d, _, names in os.walk(tmp_path / "x") for n in names}
    assert len(found) == 301 and len({os.path.dirname(f) for f in found}) <= 8
    texts = sorted(open(f, encoding="utf-8").read() for f in found)
    assert texts == sorted(f"{x or ''}\n" for _, x in rows)
    calls = []
    listing = src.list_xml_files
    monkeypatch.setattr(src, "list_xml_files", lambda *a: calls.append(a) or listing(*a))
    scan = src.scan_articles(spark, str(tmp_path / "x"), max_file_bytes=11)
    reasons = [r.reason.split(":")[0] for r in scan.rejects.collect()]
    assert len(reasons) == 301 and len(calls) == 1
    assert reasons.count("too long") == sum(len((x or "").encode()) + 1 > 11 for _, x in rows)
    assert scan.parsed.rdd.getNumPartitions() < 10


def test_runs_leave_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(src, "PARSE_BYTES", 1000)
    xml = "<article><article-id>P</article-id><body>" + "b" * 400 + "</body></article>"
    docs = spark.createDataFrame([(str(i), xml) for i in range(20)] + [("n", None)], "path string, x string").coalesce(1)
    runs = src.parse_documents(docs.select("path", F.encode("x", "UTF-8").alias("content")))
    assert runs.count() == 21 and runs.filter("error is null").count() == 20
    assert {r.path for r in runs.collect()} == {*map(str, range(20)), "n"}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in (str(8 << 20), f"{8 << 20}b")


def test_the_driver_lists_a_group_of_folders_at_a_time(spark, tmp_path, monkeypatch):
    xml = "<article><article-id>P{}</article-id><title-group><article-title>t</article-title></title-group><abstract>a</abstract><body>b</body></article>"
    root = tmp_path / "x"
    places = ["a/0", "a/1", "a [2],{3}", "b/c/0", "b/c/1", "", "b", "_hidden", ".hidden", "k=1"]
    for p, place in enumerate(places):
        (root / place).mkdir(parents=True, exist_ok=True)
        for i in range(6):
            (root / place / f"{p}-{i}.xml").write_text(xml.format(f"{p}-{i}") if i else "<broken" + "x" * 1000 * (p % 2))
        (root / place / "note.txt").write_text("no article")
    whole = src.scan_articles(spark, str(root), max_file_bytes=900)
    seen, listing = [], src.list_xml_files

    def listed(session, source):
        out = listing(session, source)
        seen.append(out.count())
        return out
    monkeypatch.setattr(src, "list_xml_files", listed)
    monkeypatch.setattr(files, "LISTED_FILES", 15)
    scan = src.scan_articles(spark, str(root), max_file_bytes=900)
    assert max(seen) <= 15 and sum(seen) == 48 and len(seen) > 3
    for one, other in ((scan.articles, whole.articles), (scan.rejects, whole.rejects), (scan.parsed, whole.parsed)):
        assert one.columns == other.columns and one.count() > 0
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert scan.articles.count() == 40 and scan.rejects.count() == 8
