"""S1 / E1 on the XML fixtures of FIXTURES.md."""

from scriptorium.functions import xml_runs
from scriptorium.functions.xml_runs import parse_runs
from scriptorium.sources import articles as src

FULL = ("<article><front><article-meta><article-id>{pid}</article-id>"
        "<title-group><article-title>{title}</article-title></title-group>"
        "<abstract><p>{abstract}</p></abstract></article-meta></front>"
        "<body><p>{body}</p></body></article>")


def full(pid="PMC1", title="T", abstract="A", body="B"):
    return FULL.format(pid=pid, title=title, abstract=abstract, body=body)


def write(root, rel, content, encoding="utf-8"):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(content.encode(encoding) if isinstance(content, str) else content)


def test_parse_rules():
    runs, err = parse_runs(full(title="A <italic>b</italic> c").encode())
    assert err is None and runs["title"] == ["A "]
    runs, _ = parse_runs(full(title="<italic>b</italic> c").encode())
    assert runs["title"] == [" c"]
    runs, _ = parse_runs(b"<a><p><article-id>X</article-id><article-id>Y</article-id></p></a>")
    assert runs["pmcid"] == ["X"]
    runs, _ = parse_runs(b"<a><body>three<!--c-->four</body></a>")
    assert runs["body_text"] == ["three", "four"]
    runs, _ = parse_runs(b"<a><body>x<![CDATA[ y<z ]]>w</body></a>")
    assert runs["body_text"] == ["x y<z w"]  # CDATA " y<z " keeps both spaces
    runs, _ = parse_runs(b"<a><body>o<body>i</body>t</body></a>")
    assert runs["body_text"] == ["o", "i", "t"]
    assert parse_runs(b"<a><b></a>")[0] is None
    assert parse_runs(b"<a>&foo;</a>")[0] is None


def test_places_and_splits():
    runs, _ = parse_runs(b"<a><article-id><b>in</b>late<!--c-->later</article-id><article-id>no</article-id>"
                         b"<p><article-id/><article-id>second</article-id></p><q><article-id>Z</article-id></q></a>")
    assert runs["pmcid"] == ["late", "Z"]
    runs, _ = parse_runs(b"<a><title-group><x/><article-title>one</article-title><article-title>two</article-title>"
                         b"</title-group><title-group><article-title>three</article-title></title-group>"
                         b"<article-title>four</article-title></a>")
    assert runs["title"] == ["one"]
    runs, _ = parse_runs(b"<a><abstract>x<?pi y?>z<body>both</body></abstract>out<body/></a>")
    assert runs["abstract"] == ["x", "z", "both"] and runs["body_text"] == ["both"]
    runs, _ = parse_runs(b'<a xmlns="urn:n"><body>other name</body><b xmlns=""><body>plain</body></b></a>')
    assert runs["body_text"] == ["plain"]
    runs, _ = parse_runs(b'<!DOCTYPE a [<!ENTITY e "in &lt; out">]><a><body>x &e; y &amp;</body></a>')
    assert runs["body_text"] == ["x in < out y &"]
    for bad in (b"", b"<a/><b/>", b"text", b"<a>\x00</a>", b'<?xml version="1.0" encoding="none"?><a/>',
                b'<!DOCTYPE a SYSTEM "x.dtd"><a><body>&foo;</body></a>', "<a>\ud7ff".encode()):
        assert parse_runs(bad)[0] is None and parse_runs(bad)[1].startswith("malformed: ")


def test_text_over_feed_borders(monkeypatch):
    text = "".join(chr(0x100 + n % 5000) for n in range(30000))
    data = full(body=f"{text}<!--c-->{text}", title=text).encode()
    whole, _ = parse_runs(data)
    for size in (1, 777):
        monkeypatch.setattr(xml_runs, "FEED_BYTES", size)
        assert parse_runs(data) == (whole, None)
    assert whole["body_text"] == [text, text] and whole["title"] == [text]


def test_a_long_file_needs_memory_for_its_runs_only():
    import tracemalloc

    back = b"<ref><p>" + b"words of a reference " * 50 + b"</p></ref>"
    data = (full()[:-len("</article>")].encode() + b"<back>" + back * (200_000_000 // len(back)) + b"</back></article>")
    tracemalloc.start()
    runs, err = parse_runs(data)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert err is None and runs["body_text"] == ["B"] and len(data) > 199_000_000
    assert peak < 4_000_000


def test_a_file_over_the_limit_is_a_reject(spark, tmp_path):
    root = tmp_path / "xml"
    write(root, "small.xml", full(pid="PMC1"))
    write(root, "big.xml", full(pid="PMC2", body="b" * 5000))
    res = src.scan_articles(spark, str(root), max_file_bytes=4000)
    assert [r["pmcid"] for r in res.articles.collect()] == ["PMC1"]
    (reject,) = res.rejects.collect()
    assert reject["path"].endswith("big.xml") and reject["reason"].startswith("too long: ")
    # Without a limit of its own, the scan takes what binaryFile can read.
    name = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(name, "4000")
    try:
        res = src.scan_articles(spark, str(root))
        assert [r["pmcid"] for r in res.articles.collect()] == ["PMC1"] and res.rejects.count() == 1
    finally:
        spark.conf.unset(name)


def test_numbering_moves_keys_only(spark, tmp_path):
    rows = [(f"/f{i:03}", f"PMC{i % 7}", "t", "a", "body " * 50, None) for i in range(100)]
    spark.createDataFrame(rows, src.PARSED_SCHEMA).write.parquet(str(tmp_path / "parsed"))
    seen = []
    plain = src.assign_ids
    try:
        src.assign_ids = lambda df, *a, **k: (seen.append(df.columns), plain(df, *a, **k))[1]
        out = src.number_articles(spark.read.parquet(str(tmp_path / "parsed")))
    finally:
        src.assign_ids = plain
    assert seen == [["pmcid", "path"]]
    got = {(r.pmcid, r.path): r.corpus_id for r in out.collect()}
    assert got == {k: n for n, k in enumerate(sorted((r[1], r[0]) for r in rows))}


def test_scan_articles(spark, tmp_path):
    root = tmp_path / "xml"
    write(root, "a/plain.xml", full(pid="PMC1"))
    write(root, "a/b/nested_dir.xml", full(pid="PMC2"))
    write(root, "a/skip.txt", full(pid="PMC3"))
    write(root, "malformed.xml", "<a><b></a>")
    write(root, "missing_abstract.xml", full(pid="PMC4").replace("<abstract><p>A</p></abstract>", ""))
    write(root, "blank_title.xml", full(pid="PMC5", title=" \t "))
    write(root, "italic_title.xml", full(pid="PMC6", title="A <italic>b</italic> c"))
    write(root, "sub_article.xml",
          "<article><front><article-id>PMC7</article-id><title-group><article-title>T"
          "</article-title></title-group><abstract>A</abstract></front><body>b1</body>"
          "<sub-article><front><article-id>S9</article-id></front><body>b2</body></sub-article></article>")
    write(root, "comment.xml", full(pid="PMC8", body="three<!--c-->four"))
    write(root, "cdata.xml", full(pid="PMC9", body="x<![CDATA[ y<z ]]>w"))
    write(root, "doctype.xml", '<!DOCTYPE article PUBLIC "-//X//DTD X//EN" "http://example.invalid/x.dtd">'
          + full(pid="PMC10"))
    write(root, "bad_entity.xml", full(pid="PMC11", body="&foo;"))
    write(root, "encoding.xml", '<?xml version="1.0" encoding="ISO-8859-1"?>' + full(pid="PMC12", title="Café"),
          encoding="latin-1")
    res = src.scan_articles(spark, str(root), materialize_to=str(tmp_path / "runs"))
    arts = {r["pmcid"]: r for r in res.articles.collect()}
    rejects = {r["path"].rsplit("/", 1)[-1] for r in res.rejects.collect()}
    assert set(arts) == {"PMC1", "PMC2", "PMC6", "PMC7 S9", "PMC8", "PMC9", "PMC10", "PMC12"}
    assert rejects == {"malformed.xml", "missing_abstract.xml", "blank_title.xml", "bad_entity.xml"}
    assert arts["PMC6"]["title"] == "A"
    assert arts["PMC7 S9"]["body_text"] == "b1 b2"
    assert arts["PMC8"]["body_text"] == "three four"
    assert arts["PMC9"]["body_text"] == "x y<z w"
    assert arts["PMC12"]["title"] == "Café"
    ids = sorted(r["corpus_id"] for r in arts.values())
    assert ids == list(range(len(arts)))
    # ids follow (pmcid, path) order
    by_id = sorted(arts.values(), key=lambda r: r["corpus_id"])
    assert [r["pmcid"] for r in by_id] == sorted(arts)


def test_pages_all_rejected(spark):
    import __spark_entry__ as E

    rows = E.queries()["q01_scan_articles"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["status"] == "reject" for r in rows)
