"""Registered queries over the driver tables and their DuckDB oracles.

Every query reads whole tables: all documents become articles, every article
with a vector is a request. Scores are rounded to 6 places and ranked on the
rounded value, ties by id, in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import dot_score
from ..operators import answers as ans
from ..operators import cache as ch
from ..operators import encode as enc
from ..operators import index
from ..operators import prompts as pr
from ..operators import rerank as rr
from ..operators import retrieve as rt
from ..sources import articles as src
from ..sources import config as cfg
from ..sources import layout
from ..sources import tables
from ..sources.files import write_files
from ..session import materialize, scratch_path
from . import pipeline as pl

TOP_K = cfg.RETRIEVAL_TOP_K
RERANK_K = cfg.RERANK_TOP_K
CAP_PAPERS = 100
SPLIT = "en"  # the split that q24 imports
ROLES = ("user", "assistant", "system")  # answer the audiences in their order
DIGITS = 6  # both engines rank on scores rounded to this many places


def _t(spark, sf, name):
    return tables.read_table(spark, sf, name)


def _articles(spark, sf):
    return tables.read_articles(spark, sf)


def _stored_articles(spark, sf):
    """The corpus as a stored table: computed once per query, then read back."""
    return materialize(tables.read_articles(spark, sf), "articles")


def _all_requests(articles: DataFrame) -> DataFrame:
    return articles.select(F.col("pmcid").alias("request_id"))


# --------------------------------------------------------------------------- Spark

def q01_scan_articles(spark, sf):
    pages = _t(spark, sf, "pages").select(
        F.col("page_id"), F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    runs = src.parse_documents(pages, keep=["page_id"])
    done = src.finish_runs(runs)
    return done.select("page_id", F.when(F.col("reason").isNull(), F.lit("article"))
                       .otherwise(F.lit("reject")).alias("status"))


def q02_load_corpus(spark, sf):
    return _articles(spark, sf).select(*src.CORPUS_SCHEMA.fieldNames())


def q03_lookup_articles(spark, sf):
    docs = _t(spark, sf, "documents").select(
        F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("request_id"))
    return src.lookup_articles(docs, _articles(spark, sf))


def q04_clean_text(spark, sf):
    return _t(spark, sf, "pages").select("page_id", tx.clean_text("html").alias("cleaned"))


def q05_join_runs(spark, sf):
    lines = F.split(F.col("text"), "\n", -1)
    return _t(spark, sf, "documents").select("doc_id", tx.join_runs(lines).alias("joined"))


def q06_require_fields(spark, sf):
    runs = tables.article_runs_from_documents(_t(spark, sf, "documents"))
    kept = tables.require_fields(tables.articles_from_runs(runs))
    return kept.select("corpus_id", "pmcid")


def q07_article_text(spark, sf):
    return _articles(spark, sf).select("corpus_id", tx.article_text().alias("article_text"))


def q08_article_text_keyed(spark, sf):
    return _articles(spark, sf).select("corpus_id", tx.article_text_keyed().alias("article_text"))


def q09_embedding_text(spark, sf):
    return _articles(spark, sf).select("corpus_id", tx.embedding_text().alias("embedding_text"))


def q10_cap_papers(spark, sf):
    return enc.cap_papers(_articles(spark, sf), CAP_PAPERS).select("corpus_id", "pmcid")


def q11_encode_hashing(spark, sf):
    texts = _articles(spark, sf).select("corpus_id", tx.embedding_text().alias("_text"))
    counts = enc.hashed_counts(texts, "corpus_id", "_text")
    vec = counts.select("corpus_id", "counts", enc.normalize_counts(F.col("counts")).alias("v"))
    exploded = vec.select("corpus_id", F.posexplode(F.arrays_zip("counts", "v")).alias("bucket", "z"))
    return exploded.filter(F.col("z.counts") != 0).select(
        "corpus_id", "bucket", F.col("z.counts").alias("cnt"),
        F.round(F.col("z.v"), 6).alias("weight"))


def _given_vectors(spark, sf):
    return tables.read_corpus_embeddings(spark, sf)


def q13_retrieve_top_k(spark, sf):
    vecs = _given_vectors(spark, sf)
    req = vecs.select(F.col("corpus_id").alias("request_id"), "embedding")
    return rt.retrieve_top_k(req, vecs, TOP_K, digits=DIGITS)


def q12_dot_score(spark, sf):
    vecs = _given_vectors(spark, sf)
    hits = q13_retrieve_top_k(spark, sf).select("request_id", "corpus_id")
    q = vecs.select(F.col("corpus_id").alias("request_id"), F.col("embedding").alias("_q"))
    c = vecs.select("corpus_id", F.col("embedding").alias("_c"))
    pairs = hits.join(q, "request_id").join(c, "corpus_id")
    return pairs.select("request_id", "corpus_id", F.round(dot_score("_q", "_c"), 6).alias("score"))


def _corpus_given(spark, sf, articles):
    vecs = _given_vectors(spark, sf)
    return vecs.join(articles.select("corpus_id"), "corpus_id", "left_semi")


def q14_supporting_docs(spark, sf):
    arts = tables.read_articles(spark, sf, _given_vectors(spark, sf))
    keys = materialize(arts.select("corpus_id", "pmcid"), "article-keys")
    return _given_docs(spark, sf, keys).select(
        "request_id", "corpus_id", "score", "retrieval_rank", "pmcid")


def _given_docs(spark, sf, arts):
    corpus = _corpus_given(spark, sf, arts)
    req = corpus.join(arts.select("corpus_id", "pmcid"), "corpus_id").select(
        F.col("pmcid").alias("request_id"), F.col("corpus_id").alias("request_cid"), "embedding")
    hits = rt.retrieve_top_k(req.select("request_id", "embedding"), corpus, TOP_K, digits=DIGITS)
    hits = hits.withColumnRenamed("rank", "retrieval_rank")
    docs = rt.exclude_self(rt.lookup_hits(hits, arts.select("corpus_id", "pmcid")))
    return docs.join(req.select("request_id", "request_cid"), "request_id")


def _scored_given(spark, sf):
    # Requests and hits all have a given vector: other articles need no cleaning.
    arts = materialize(tables.read_articles(spark, sf, _given_vectors(spark, sf)), "articles")
    docs = materialize(_given_docs(spark, sf, arts).select(
        "request_id", "request_cid", "corpus_id", "retrieval_rank"), "hits")
    return rr.score_pairs(docs, arts)


def q15_score_pairs(spark, sf):
    return _scored_given(spark, sf).select(
        "request_id", "corpus_id", "retrieval_rank", F.round("rerank_score", 6).alias("rerank_score"))


def q16_rerank_top_k(spark, sf):
    ranked = rr.rerank_top_k(_scored_given(spark, sf), RERANK_K, DIGITS)
    return ranked.select("request_id", "corpus_id", "retrieval_rank", "rerank_score", "rerank_rank")


def _hashed_corpus(arts):
    return enc.build_corpus_embeddings(arts)


def q17_retrieve_and_rerank(spark, sf):
    arts = _stored_articles(spark, sf)
    return pl.retrieve_and_rerank(_all_requests(arts), arts, _hashed_corpus(arts), digits=DIGITS)


def q18_assemble_context(spark, sf):
    arts = _stored_articles(spark, sf)
    reqs = _all_requests(arts)
    reranked, texts = pl.retrieve_and_rerank_with_texts(reqs, arts, _hashed_corpus(arts), digits=DIGITS)
    return pr.assemble_context(reqs, reranked, texts)


def q19_render_prompt(spark, sf):
    arts = _stored_articles(spark, sf)
    reqs = _all_requests(arts)
    reranked, texts = pl.retrieve_and_rerank_with_texts(reqs, arts, _hashed_corpus(arts), digits=DIGITS)
    return pl.build_prompts(reqs, texts, reranked)


def q20_attach_answers(spark, sf):
    return ans.attach_answers(q19_render_prompt(spark, sf), ans.echo_responder)


def q21_pivot_answers(spark, sf):
    return ans.pivot_answers(q20_attach_answers(spark, sf))


def q22_get_or_create(spark, sf):
    arts = _articles(spark, sf)

    def ids(name):
        return _t(spark, sf, name).select(
            F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("request_id"))

    requests = ids("documents").unionByName(ids("labels"))
    stored = ids("labels").select(F.col("request_id").alias(ch.STORE_KEY))
    return ch.plan_requests(requests, stored, arts)


def _pmc(col):
    return F.concat(F.lit("PMC"), F.col(col).cast("string"))


def q23_article_records(spark, sf):
    docs = _t(spark, sf, "documents").select(_pmc("doc_id").alias("request_id"))
    return src.lookup_articles(docs, _articles(spark, sf), ("title", "abstract", "body_text"))


def q24_import_store_load(spark, sf):
    """One split of the documents, stored as a corpus and loaded."""
    root = scratch_path(spark, "root")
    docs = src.import_corpus(_t(spark, sf, "documents"), SPLIT, "lang")
    src.write_corpus(tables.articles_from_documents(docs), src.data_path(root, "corpus", "dataset"))
    return src.load_local(spark, root, "corpus", "dataset")


def q25_stored_embeddings(spark, sf):
    """Vectors are built and stored by the first call; the second only loads them."""
    root = scratch_path(spark, "root")
    src.load_or_create_embeddings(spark, root, "corpus", lambda: _hashed_corpus(_articles(spark, sf)))
    vecs = src.load_or_create_embeddings(spark, root, "corpus", lambda: None)
    return vecs.select("corpus_id", F.posexplode("embedding").alias("bucket", "v")).filter(
        "v <> 0").select("corpus_id", "bucket", F.round("v", 6).alias("weight"))


def q26_table_answers(spark, sf):
    """A4 with given answers: the last turn of each role answers one audience."""
    roles = F.create_map(*[F.lit(x) for pair in zip(ROLES, cfg.AUDIENCES) for x in pair])
    said = _t(spark, sf, "conversations").groupBy("conv_id", "role").agg(
        F.max_by("text", "turn").alias("summary")).select(
        _pmc("conv_id").alias("request_id"), roles[F.col("role")].alias("audience"), "summary")
    papers = _articles(spark, sf).select(F.col("pmcid").alias("request_id"),
                                         tx.article_text_keyed().alias("paper"),
                                         F.lit("").alias("supporting_docs"))
    return ans.attach_answers(pr.render_prompts(papers), ans.table_responder(said))


def _stored_answers(spark, sf):
    store = ch.SummaryStore(spark, scratch_path(spark, "answers"))

    def rows(df, text):
        return df.select(F.col("request_id").alias(ch.STORE_KEY),
                         *[F.concat(F.lit(f"{k} "), text).alias(k + ans.SUMMARY_SUFFIX) for k in cfg.AUDIENCES])

    labels = _t(spark, sf, "labels").select(_pmc("doc_id").alias("request_id"), "quality", "toxic")
    docs = _t(spark, sf, "documents").select(_pmc("doc_id").alias("request_id"))
    store.save(rows(labels, F.lit("first")))
    store.save(rows(labels.filter("quality = 1"), F.lit("second")))
    arts = _stored_articles(spark, sf)
    titles = arts.select(F.col("pmcid").alias("request_id"), "title")
    out = ch.get_or_create(store, docs.unionByName(labels.select("request_id")), arts,
                           lambda todo: rows(todo.join(titles, "request_id"), F.col("title")))
    return out["answers"]


def q27_answer_store(spark, sf):
    """The last version saved wins; ids that are not stored are computed and stored."""
    return _stored_answers(spark, sf)


def q28_unpivot_answers(spark, sf):
    return ans.unpivot_answers(_stored_answers(spark, sf))


def q29_summarize(spark, sf):
    arts = _stored_articles(spark, sf)
    return pl.summarize(_all_requests(arts), arts, _hashed_corpus(arts), digits=DIGITS)


def _article_xml(escapes):
    """The article XML of a document: title, abstract and body are its lines 1, 2 and the rest."""
    line = F.split(F.coalesce("text", F.lit("")), "\n", 3)
    part = [F.coalesce(F.get(line, F.lit(i)), F.lit("")) for i in range(3)]
    for sign, name in escapes:
        part = [F.replace(p, F.lit(sign), F.lit(f"&{name};")) for p in part]
    return F.concat(
        F.lit("<article><article-id>PMC"), F.col("doc_id").cast("string"),
        F.lit("</article-id><title-group><article-title>"), part[0],
        F.lit("<italic>i</italic>after</article-title></title-group><abstract><p>"), part[1],
        F.lit("</p></abstract><body><p>"), part[2],
        F.lit("<!-- no text --><![CDATA[ x<y ]]></p></body></article>"))


def q30_parse_articles(spark, sf):
    """An article XML file made of each document, and the pages, which are no XML."""
    xml = _article_xml([("&", "amp"), ("<", "lt")])
    docs = _t(spark, sf, "documents").select(_pmc("doc_id").alias("path"), F.encode(xml, "UTF-8").alias("content"))
    pages = _t(spark, sf, "pages").select(
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("path"),
        F.encode("html", "UTF-8").alias("content"))
    done = src.finish_runs(src.parse_documents(docs.unionByName(pages)))
    kept = F.col("reason").isNull()
    return done.select("path", *[F.when(kept, F.col(f)).alias(f) for f in tx.ARTICLE_FIELDS],
                       kept.alias("kept"))


def q31_scan_xml_files(spark, sf):
    """S1 from files: every document is written as an XML file of its own, then all are scanned."""
    folder = scratch_path(spark, "article-files")
    # Line ends and quotes are written as references, so that any writer's file holds the XML alone.
    xml = _article_xml([("&", "amp"), ("<", "lt"), ('"', "quot"), ("\n", "#10"), ("\r", "#13")])
    docs = tables.spread(_t(spark, sf, "documents").select("doc_id", xml.alias("xml")))
    write_files(docs, folder, "doc_id", "xml", "xml")
    scan = src.scan_articles(spark, folder)

    def doc_id(path):
        return F.regexp_extract(path, "doc_id=([0-9]+)", 1).cast("long").alias("doc_id")

    rejects = scan.rejects.select(doc_id("path"), F.substring_index("reason", ":", 1).alias("status"))
    return scan.articles.select(
        F.regexp_extract("pmcid", "[0-9]+", 0).cast("long").alias("doc_id"), F.lit("article").alias("status"),
        *src.CORPUS_SCHEMA.fieldNames()).unionByName(rejects, allowMissingColumns=True)


def q32_keyed_lookup(spark, sf):
    """S5 on the key-bucketed corpus (S3): the articles of the documents labelled as bad."""
    path = scratch_path(spark, "keyed-corpus")
    layout.write_keyed(_articles(spark, sf), path)
    bad = _t(spark, sf, "labels").filter("quality = 0").select(_pmc("doc_id").alias("request_id"))
    return layout.KeyedCorpus(spark, path).lookup(bad, ("title", "abstract"))


def q33_indexed_top_k(spark, sf):
    """R4 on a stored index of vector blocks: every vector against all, as in q13."""
    vecs = _given_vectors(spark, sf)
    blocks = index.build_index(vecs, scratch_path(spark, "vector-index"))
    return index.search_index(vecs.select(F.col("corpus_id").alias("request_id"), "embedding"), blocks, TOP_K,
                              digits=DIGITS)


QUERIES = {
    "q01_scan_articles": q01_scan_articles,
    "q02_load_corpus": q02_load_corpus,
    "q03_lookup_articles": q03_lookup_articles,
    "q04_clean_text": q04_clean_text,
    "q05_join_runs": q05_join_runs,
    "q06_require_fields": q06_require_fields,
    "q07_article_text": q07_article_text,
    "q08_article_text_keyed": q08_article_text_keyed,
    "q09_embedding_text": q09_embedding_text,
    "q10_cap_papers": q10_cap_papers,
    "q11_encode_hashing": q11_encode_hashing,
    "q12_dot_score": q12_dot_score,
    "q13_retrieve_top_k": q13_retrieve_top_k,
    "q14_supporting_docs": q14_supporting_docs,
    "q15_score_pairs": q15_score_pairs,
    "q16_rerank_top_k": q16_rerank_top_k,
    "q17_retrieve_and_rerank": q17_retrieve_and_rerank,
    "q18_assemble_context": q18_assemble_context,
    "q19_render_prompt": q19_render_prompt,
    "q20_attach_answers": q20_attach_answers,
    "q21_pivot_answers": q21_pivot_answers,
    "q22_get_or_create": q22_get_or_create,
    "q23_article_records": q23_article_records,
    "q24_import_store_load": q24_import_store_load,
    "q25_stored_embeddings": q25_stored_embeddings,
    "q26_table_answers": q26_table_answers,
    "q27_answer_store": q27_answer_store,
    "q28_unpivot_answers": q28_unpivot_answers,
    "q29_summarize": q29_summarize,
    "q30_parse_articles": q30_parse_articles,
    "q31_scan_xml_files": q31_scan_xml_files,
    "q32_keyed_lookup": q32_keyed_lookup,
    "q33_indexed_top_k": q33_indexed_top_k,
}


# --------------------------------------------------------------------------- SQL

def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CLEAN = _lit(tx.CLEAN_PATTERN_RE2)
STRIP = _lit(tx.STRIP_PATTERN)
TOKEN = _lit(tx.TOKEN_SPLIT)


def _join_runs_sql(lst: str) -> str:
    return (f"CASE WHEN len({lst}) = 0 THEN NULL ELSE regexp_replace(array_to_string("
            f"list_transform({lst}, lambda r: regexp_replace(r, {CLEAN}, ' ', 'g')), ' '), "
            f"{STRIP}, '', 'g') END")


ARTICLES_CTE = f"""
docs_ AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
),
runs_ AS (
  SELECT doc_id AS corpus_id, ['PMC' || CAST(doc_id AS VARCHAR)] AS p,
         lines[1:1] AS t, lines[2:2] AS a, lines[3:] AS b
  FROM docs_
),
fields_ AS (
  SELECT corpus_id, {_join_runs_sql('p')} AS pmcid, {_join_runs_sql('t')} AS title,
         {_join_runs_sql('a')} AS abstract, {_join_runs_sql('b')} AS body_text
  FROM runs_
),
articles AS (
  SELECT * FROM fields_
  WHERE coalesce(pmcid, '') <> '' AND coalesce(title, '') <> ''
    AND coalesce(abstract, '') <> '' AND coalesce(body_text, '') <> ''
)"""


def _tokens_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), {TOKEN}), lambda x: x <> '')"


def _article_text_sql(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return f"concat_ws(' ', {p}pmcid, {p}title, {p}abstract, {p}body_text)"


def _keyed_sql(alias: str = "") -> str:
    p = f"{alias}." if alias else ""
    return ("concat_ws(chr(10), " + ", ".join(f"'{f}: ' || {p}{f}" for f in tx.ARTICLE_FIELDS) + ")")


EMB_TEXT_SQL = "concat_ws('[SEP]', title, abstract, body_text)"


def _hash_counts_cte(name: str, id_expr: str, text_expr: str, src: str) -> str:
    """(id, bucket, cnt) non-zero signed hashed counts, plus norm2 per id."""
    return f"""
{name}_tok AS (
  SELECT {id_expr} AS id, unnest({_tokens_sql(text_expr)}) AS t FROM {src}
),
{name}_h AS (
  SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM {name}_tok
),
{name} AS (
  SELECT id, h % 64 AS bucket,
         sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS cnt
  FROM {name}_h GROUP BY id, h % 64 HAVING sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) <> 0
),
{name}_n AS (
  SELECT id, sum(cnt * cnt) AS n2 FROM {name} GROUP BY id
)"""


GIVEN_TOPK_CTE = f"""
{ARTICLES_CTE},
vecs_ AS (SELECT vec_id AS corpus_id, embedding::DOUBLE[] AS e FROM embeddings),
corpus_ AS (SELECT v.* FROM vecs_ v WHERE v.corpus_id IN (SELECT corpus_id FROM articles)),
req_ AS (SELECT a.pmcid AS request_id, c.e FROM corpus_ c JOIN articles a USING (corpus_id)),
hits_ AS (
  SELECT request_id, corpus_id, score, retrieval_rank FROM (
    SELECT r.request_id, c.corpus_id, round(list_dot_product(r.e, c.e), 6) AS score,
           row_number() OVER (PARTITION BY r.request_id
                              ORDER BY round(list_dot_product(r.e, c.e), 6) DESC, c.corpus_id)
             AS retrieval_rank
    FROM req_ r, corpus_ c
  ) WHERE retrieval_rank <= {TOP_K}
),
docs14_ AS (
  SELECT h.request_id, h.corpus_id, h.score, h.retrieval_rank::INTEGER AS retrieval_rank, a.pmcid
  FROM hits_ h JOIN articles a USING (corpus_id)
  WHERE a.pmcid <> h.request_id
),
scored_ AS (
  SELECT d.request_id, d.corpus_id, d.retrieval_rank,
         CASE WHEN len(list_distinct(list_concat(qa.tk, da.tk))) = 0 THEN 0.0 ELSE
           len(list_intersect(qa.tk, da.tk))::DOUBLE / len(list_distinct(list_concat(qa.tk, da.tk)))
         END AS rerank_score
  FROM docs14_ d
  JOIN (SELECT corpus_id, list_distinct({_tokens_sql(_article_text_sql())}) AS tk FROM articles) da
    USING (corpus_id)
  JOIN (SELECT pmcid AS request_id, list_distinct({_tokens_sql(_article_text_sql())}) AS tk
        FROM articles) qa USING (request_id)
)"""


PIPELINE_CTE = f"""
{ARTICLES_CTE},
{_hash_counts_cte('cv_', 'corpus_id', EMB_TEXT_SQL, 'articles')},
{_hash_counts_cte('rv_', 'pmcid', _article_text_sql(), 'articles')},
pair_ AS (
  SELECT r.id AS request_id, c.id AS corpus_id, sum(r.cnt * c.cnt) AS dot
  FROM rv_ r JOIN cv_ c USING (bucket) GROUP BY r.id, c.id
),
allpairs_ AS (
  SELECT rn.id AS request_id, cn.id AS corpus_id,
         round(coalesce(p.dot, 0) / sqrt(rn.n2 * cn.n2), 6) AS score
  FROM rv__n rn CROSS JOIN cv__n cn
  LEFT JOIN pair_ p ON p.request_id = rn.id AND p.corpus_id = cn.id
),
hits_ AS (
  SELECT * FROM (
    SELECT request_id, corpus_id, score,
           row_number() OVER (PARTITION BY request_id ORDER BY score DESC, corpus_id) AS retrieval_rank
    FROM allpairs_
  ) WHERE retrieval_rank <= {TOP_K}
),
docs_p AS (
  SELECT h.request_id, h.corpus_id, h.retrieval_rank::INTEGER AS retrieval_rank
  FROM hits_ h JOIN articles a USING (corpus_id) WHERE a.pmcid <> h.request_id
),
tk_ AS (SELECT corpus_id, pmcid, list_distinct({_tokens_sql(_article_text_sql())}) AS tk FROM articles),
scored_p AS (
  SELECT d.request_id, d.corpus_id, d.retrieval_rank,
         round(CASE WHEN len(list_distinct(list_concat(q.tk, t.tk))) = 0 THEN 0.0 ELSE
           len(list_intersect(q.tk, t.tk))::DOUBLE / len(list_distinct(list_concat(q.tk, t.tk)))
         END, 6) AS rerank_score
  FROM docs_p d JOIN tk_ t ON t.corpus_id = d.corpus_id JOIN tk_ q ON q.pmcid = d.request_id
),
reranked_ AS (
  SELECT * FROM (
    SELECT request_id, corpus_id, retrieval_rank, rerank_score,
           (row_number() OVER (PARTITION BY request_id
                               ORDER BY rerank_score DESC, retrieval_rank))::INTEGER AS rerank_rank
    FROM scored_p
  ) WHERE rerank_rank <= {RERANK_K}
),
context_ AS (
  SELECT r.pmcid AS request_id,
         coalesce((SELECT string_agg({_keyed_sql('d')}, chr(10) ORDER BY x.rerank_rank)
                   FROM reranked_ x JOIN articles d ON d.corpus_id = x.corpus_id
                   WHERE x.request_id = r.pmcid), '') AS supporting_docs
  FROM articles r
),
aud_ AS (
  SELECT * FROM (VALUES {", ".join(f"({_lit(k)}, {_lit(v)}, {i})" for i, (k, v) in enumerate(cfg.AUDIENCES.items()))})
    AS t(audience, description, ord)
),
prompts_ AS (
  SELECT c.request_id, a.audience,
         {_lit(cfg.PROMPT_SYSTEM)} AS system,
         replace(replace(replace(replace({_lit(cfg.PROMPT_TEMPLATE)},
           '{{audience}}', a.description), '{{max_words}}', '{cfg.MAX_WORDS}'),
           '{{supporting_docs}}', c.supporting_docs),
           '{{paper}}', {_keyed_sql('p')}) AS text
  FROM context_ c JOIN articles p ON p.pmcid = c.request_id, aud_ a
)"""


def _wide_sql() -> str:
    cols = ", ".join(f"max(CASE WHEN audience = {_lit(k)} THEN text END) AS {k}_summary"
                     for k in cfg.AUDIENCES)
    return f"WITH {PIPELINE_CTE} SELECT request_id AS pmc_id, {cols} FROM prompts_ GROUP BY request_id"


_KEYS = list(cfg.AUDIENCES)

ANSWERS_CTE = f"""{ARTICLES_CTE},
saved_ AS (
  SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS pmc_id,
         CASE WHEN bool_or(quality = 1) THEN 'second' ELSE 'first' END AS said
  FROM labels GROUP BY 1
),
answers_ AS (
  SELECT pmc_id, said FROM saved_
  UNION ALL SELECT pmcid, title FROM articles WHERE pmcid NOT IN (SELECT pmc_id FROM saved_)
)"""


def _parsed_cte() -> str:
    def fields(title, abstract, body):
        return ", ".join(f"{_join_runs_sql(x)} AS {f}" for f, x in
                         (("title", title), ("abstract", abstract), ("body_text", body)))

    return f"""
        l_ AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l,
                           regexp_matches(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') AS bad
                    FROM documents),
        p_ AS (SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS pmcid, bad, coalesce(l[1], '') AS t,
                      coalesce(l[2], '') AS a, array_to_string(l[3:], chr(10)) AS b FROM l_),
        f_ AS (SELECT pmcid, bad, {fields("[CASE WHEN t = '' THEN 'after' ELSE t END]",
                                          "CASE WHEN a = '' THEN [] ELSE [a] END",
                                          "CASE WHEN b = '' THEN [' x<y '] ELSE [b, ' x<y '] END")} FROM p_),
        k_ AS (SELECT *, NOT bad AND title <> '' AND coalesce(abstract, '') <> '' AND body_text <> '' AS kept FROM f_)"""


def _parse_sql() -> str:
    return f"""
        WITH {_parsed_cte()}
        SELECT pmcid AS path, CASE WHEN kept THEN pmcid END AS pmcid, CASE WHEN kept THEN title END AS title,
               CASE WHEN kept THEN abstract END AS abstract, CASE WHEN kept THEN body_text END AS body_text, kept
        FROM k_
        UNION ALL SELECT 'page' || CAST(page_id AS VARCHAR), NULL, NULL, NULL, NULL, FALSE FROM pages"""


ORACLE_SQL = {
    "q02_load_corpus": f"WITH {ARTICLES_CTE} SELECT corpus_id, pmcid, title, abstract, body_text FROM articles",
    "q03_lookup_articles": f"""WITH {ARTICLES_CTE}
        SELECT r.request_id, a.corpus_id, a.title, a.corpus_id IS NOT NULL AS found
        FROM (SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS request_id FROM documents) r
        LEFT JOIN articles a ON a.pmcid = r.request_id""",
    "q04_clean_text": f"SELECT page_id, regexp_replace(html, {CLEAN}, ' ', 'g') AS cleaned FROM pages",
    "q05_join_runs": f"SELECT doc_id, {_join_runs_sql('string_split(text, chr(10))')} AS joined FROM documents",
    "q06_require_fields": f"WITH {ARTICLES_CTE} SELECT corpus_id, pmcid FROM articles",
    "q07_article_text": f"WITH {ARTICLES_CTE} SELECT corpus_id, {_article_text_sql()} AS article_text FROM articles",
    "q08_article_text_keyed": f"WITH {ARTICLES_CTE} SELECT corpus_id, {_keyed_sql()} AS article_text FROM articles",
    "q09_embedding_text": f"WITH {ARTICLES_CTE} SELECT corpus_id, {EMB_TEXT_SQL} AS embedding_text FROM articles",
    "q10_cap_papers": f"WITH {ARTICLES_CTE} SELECT corpus_id, pmcid FROM articles ORDER BY corpus_id LIMIT {CAP_PAPERS}",
    "q11_encode_hashing": f"""WITH {ARTICLES_CTE}, {_hash_counts_cte('hv_', 'corpus_id', EMB_TEXT_SQL, 'articles')}
        SELECT h.id AS corpus_id, h.bucket::INTEGER AS bucket, h.cnt::BIGINT AS cnt,
               round(h.cnt / sqrt(n.n2), 6) AS weight
        FROM hv_ h JOIN hv__n n USING (id)""",
    "q12_dot_score": f"""SELECT request_id, corpus_id, score FROM (
        SELECT q.vec_id AS request_id, c.vec_id AS corpus_id,
               round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY
                 round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC,
                 c.vec_id) AS rk
        FROM embeddings q, embeddings c) WHERE rk <= {TOP_K}""",
    "q13_retrieve_top_k": f"""SELECT request_id, corpus_id, score, rk::INTEGER AS rank FROM (
        SELECT q.vec_id AS request_id, c.vec_id AS corpus_id,
               round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY
                 round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC,
                 c.vec_id) AS rk
        FROM embeddings q, embeddings c) WHERE rk <= {TOP_K}""",
    "q14_supporting_docs": f"WITH {GIVEN_TOPK_CTE} SELECT * FROM docs14_",
    "q15_score_pairs": f"""WITH {GIVEN_TOPK_CTE}
        SELECT request_id, corpus_id, retrieval_rank, round(rerank_score, 6) AS rerank_score FROM scored_""",
    "q16_rerank_top_k": f"""WITH {GIVEN_TOPK_CTE}
        SELECT * FROM (
          SELECT request_id, corpus_id, retrieval_rank, round(rerank_score, 6) AS rerank_score,
                 (row_number() OVER (PARTITION BY request_id
                   ORDER BY round(rerank_score, 6) DESC, retrieval_rank))::INTEGER AS rerank_rank
          FROM scored_) WHERE rerank_rank <= {RERANK_K}""",
    "q17_retrieve_and_rerank": f"WITH {PIPELINE_CTE} SELECT * FROM reranked_",
    "q18_assemble_context": f"WITH {PIPELINE_CTE} SELECT request_id, supporting_docs FROM context_",
    "q19_render_prompt": f"WITH {PIPELINE_CTE} SELECT request_id, audience, system, text FROM prompts_",
    "q20_attach_answers": f"WITH {PIPELINE_CTE} SELECT request_id, audience, text AS summary FROM prompts_",
    "q21_pivot_answers": _wide_sql(),
    "q22_get_or_create": f"""WITH {ARTICLES_CTE},
        req_ AS (SELECT DISTINCT request_id FROM (
          SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS request_id FROM documents
          UNION ALL SELECT 'PMC' || CAST(doc_id AS VARCHAR) FROM labels)
          WHERE request_id IS NOT NULL AND length(request_id) > 0),
        keys_ AS (SELECT DISTINCT 'PMC' || CAST(doc_id AS VARCHAR) AS k FROM labels)
        SELECT request_id,
               CASE WHEN request_id IN (SELECT k FROM keys_) THEN 'cached'
                    WHEN request_id IN (SELECT pmcid FROM articles) THEN 'compute'
                    ELSE 'unknown' END AS status
        FROM req_""",
    "q23_article_records": f"""WITH {ARTICLES_CTE}
        SELECT r.request_id, a.corpus_id, a.title, a.abstract, a.body_text, a.corpus_id IS NOT NULL AS found
        FROM (SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS request_id FROM documents) r
        LEFT JOIN articles a ON a.pmcid = r.request_id""",
    "q24_import_store_load": f"""WITH {ARTICLES_CTE}
        SELECT corpus_id, pmcid, title, abstract, body_text FROM articles
        WHERE corpus_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""",
    "q25_stored_embeddings": f"""WITH {ARTICLES_CTE}, {_hash_counts_cte('hv_', 'corpus_id', EMB_TEXT_SQL, 'articles')}
        SELECT h.id AS corpus_id, h.bucket::INTEGER AS bucket, round(h.cnt / sqrt(n.n2), 6) AS weight
        FROM hv_ h JOIN hv__n n USING (id)""",
    "q26_table_answers": f"""WITH {ARTICLES_CTE},
        who_ AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{k}')" for r, k in zip(ROLES, _KEYS))}) t(role, audience)),
        said_ AS (SELECT 'PMC' || CAST(conv_id AS VARCHAR) AS request_id, audience, arg_max(text, turn) AS summary
                  FROM conversations JOIN who_ USING (role) GROUP BY 1, 2)
        SELECT a.pmcid AS request_id, w.audience, s.summary
        FROM articles a CROSS JOIN who_ w
        LEFT JOIN said_ s ON s.request_id = a.pmcid AND s.audience = w.audience""",
    "q27_answer_store": f"""WITH {ANSWERS_CTE}
        SELECT pmc_id, {", ".join(f"'{k} ' || said AS {k}_summary" for k in _KEYS)} FROM answers_""",
    "q28_unpivot_answers": f"WITH {ANSWERS_CTE} " + " UNION ALL ".join(
        f"SELECT pmc_id AS request_id, '{k}' AS audience, '{k} ' || said AS summary FROM answers_" for k in _KEYS),
    "q29_summarize": _wide_sql(),
    "q30_parse_articles": _parse_sql(),
    "q31_scan_xml_files": f"""WITH {_parsed_cte()}
        SELECT substr(pmcid, 4)::BIGINT AS doc_id,
               CASE WHEN kept THEN 'article' WHEN bad THEN 'malformed' ELSE 'missing' END AS status,
               CASE WHEN kept THEN row_number() OVER (PARTITION BY kept ORDER BY pmcid) - 1 END AS corpus_id,
               CASE WHEN kept THEN pmcid END AS pmcid, CASE WHEN kept THEN title END AS title,
               CASE WHEN kept THEN abstract END AS abstract, CASE WHEN kept THEN body_text END AS body_text
        FROM k_""",
    "q32_keyed_lookup": f"""WITH {ARTICLES_CTE}
        SELECT 'PMC' || CAST(l.doc_id AS VARCHAR) AS request_id, a.corpus_id, a.title, a.abstract,
               a.corpus_id IS NOT NULL AS found
        FROM labels l LEFT JOIN articles a ON a.corpus_id = l.doc_id WHERE l.quality = 0""",
}
ORACLE_SQL["q33_indexed_top_k"] = ORACLE_SQL["q13_retrieve_top_k"]
