"""Queries of lexical, dense and hybrid retrieval. The stated query set of a search is every row
whose id is divisible by 50; every row of the other side is searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.scorers import scorer
from evidentia.operators.retrieval import STOP_WORDS, Bm25Index, fuse, merged_hits, nearest, pair_cosine, reranked, tfidf_ranking, top_k
from evidentia.plans import sql
from evidentia.session import first_of_each, table

K = 10


def _index(spark: SparkSession, sf_dir: str) -> Bm25Index:
    return Bm25Index(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "examples", "example_id", "question").where("example_id % 50 = 0")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_each(table(spark, sf_dir, "evidence_docs", "evid_id", "question_id", "context_text"), "evid_id").where("question_id IS NOT NULL")


def _one_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for each id: that of the least example."""
    rows = table(spark, sf_dir, "examples", "example_id", "question_id", "question").where("question_id IS NOT NULL AND question IS NOT NULL")
    return rows.groupBy("question_id").agg(F.min_by("question", "example_id").alias("question"))


def R1_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def R13_index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Bm25Index(_passages(spark, sf_dir), "evid_id", "context_text", "question_id")
    return index.summary().select("n_docs", "n_groups", "n_terms", "n_postings", F.round("avg_length", 6).alias("avg_length"))


def R4_bm25_global_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _index(spark, sf_dir).search(_asked(spark, sf_dir), "example_id", "question", K)
    return hits.select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def R3_bm25_group_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = Bm25Index(_passages(spark, sf_dir), "evid_id", "context_text", "question_id")
    asked = _one_question(spark, sf_dir).withColumn("query", F.col("question_id"))
    hits = index.search(asked, "query", "question", 3, "question_id")
    return hits.select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _bm25(docs: str, asked: str, group: bool) -> str:
    """CTEs up to ``scored(query, grp, doc, score)`` from ``docs(doc, grp, text)`` and ``asked(query, grp, text)``."""
    on = "USING (term, grp)" if group else "USING (term)"
    mean = "(SELECT grp, avg(dl) AS avgdl FROM lens GROUP BY grp)" if group else "(SELECT avg(dl) AS avgdl FROM lens)"
    with_mean = f"JOIN {mean} m ON m.grp = p.grp" if group else f"CROSS JOIN {mean} m"
    return f"""d AS ({docs}), q AS ({asked}), toks AS (SELECT doc, grp, unnest({sql.tokens('text')}) AS term FROM d),
    posts AS (SELECT doc, grp, term, count(*) AS tf FROM toks GROUP BY ALL), total AS (SELECT count(*) AS n FROM d),
    terms AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM total) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts GROUP BY term),
    lens AS (SELECT d.doc, d.grp, coalesce(sum(tf), 0) AS dl FROM d LEFT JOIN posts p ON p.doc = d.doc AND p.grp IS NOT DISTINCT FROM d.grp GROUP BY ALL),
    ask AS (SELECT query, grp, term, count(*) AS qtf FROM (SELECT query, grp, unnest({sql.tokens('text')}) AS term FROM q) GROUP BY ALL),
    scored AS (SELECT a.query, p.grp, p.doc, sum(t.idf * p.tf * 2.5 / greatest(p.tf + 1.5 * (0.25 + 0.75 * l.dl / greatest(m.avgdl, 1e-6)), 1e-6) * a.qtf) AS score
        FROM posts p JOIN ask a {on} JOIN terms t ON t.term = p.term JOIN lens l ON l.doc = p.doc AND l.grp = p.grp {with_mean} GROUP BY ALL)"""


_DOCS = "SELECT doc_id AS doc, '' AS grp, text FROM documents"
_ASKED = "SELECT example_id AS query, '' AS grp, question AS text FROM examples WHERE example_id % 50 = 0"
_GROUP_DOCS = f"SELECT evid_id AS doc, question_id AS grp, context_text AS text FROM {sql.once('evidence_docs', 'evid_id', 'question_id', 'context_text')} WHERE question_id IS NOT NULL"
_ONE = "SELECT question_id, arg_min(question, example_id) AS question FROM examples WHERE question_id IS NOT NULL AND question IS NOT NULL GROUP BY 1"
_GROUP_ASKED = f"SELECT question_id AS query, question_id AS grp, question AS text FROM ({_ONE})"
_TOP = "SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM {0} QUALIFY rank <= {1}"


def _hybrid(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    # One more than fused, as a document may find itself.
    lexical = _index(spark, sf_dir).search(asked, "doc_id", "asked", 25 + 1).where("doc <> query")
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    dense = nearest(vectors, "vec_id", "embedding", vectors.where("vec_id % 50 = 0"), 25)
    fused = fuse(top_k(lexical, ["query"], "score", "doc", 25), dense)
    return top_k(fused, ["query"], "score", "doc", K).select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def R8_hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and dense ranks of the same documents, fused; vectors and documents share ids. A query
    document asks with its question, whole, and with its vector; one without question with its vector only."""
    docs = table(spark, sf_dir, "documents", "doc_id", "question_id").where("doc_id % 50 = 0")
    return _hybrid(spark, sf_dir, docs.join(_one_question(spark, sf_dir), "question_id").select("doc_id", F.col("question").alias("asked")))


def R8_hybrid_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``R8_hybrid_fusion``, with the whole text of each query document as the lexical query."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where("doc_id % 50 = 0 AND text IS NOT NULL")
    return _hybrid(spark, sf_dir, docs.select("doc_id", F.col("text").alias("asked")))


def R8_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    hits = nearest(vectors, "vec_id", "embedding", vectors.where("vec_id % 50 = 0"), K)
    return hits.select("query", "doc", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def R7_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each question by a second score, where there are more than two."""
    pairs = _passages(spark, sf_dir).join(_one_question(spark, sf_dir), "question_id")
    ranked = reranked(pairs, ["question_id"], F.round(scorer("coverage")(F.col("context_text"), F.col("question")), 9), "evid_id", 2)
    return ranked.select("question_id", "evid_id", F.col("rank").cast("bigint").alias("rank"))


def R9_merged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a question over fetches, each document where it first came."""
    rows = first_of_each(table(spark, sf_dir, "evidence_docs", "evid_id", "question_id", "doc_id", "rank", "fetched_at"), "evid_id").where("question_id IS NOT NULL")
    return merged_hits(rows, ["question_id"], "doc_id", "fetched_at", "evid_id").select("question_id", "doc_id", "evid_id")


QUERIES = {
    "R1_index_terms": R1_index_terms,
    "R3_bm25_group_topk": R3_bm25_group_topk,
    "R4_bm25_global_topk": R4_bm25_global_topk,
    "R7_reranked": R7_reranked,
    "R8_dense_topk": R8_dense_topk,
    "R8_hybrid_fusion": R8_hybrid_fusion,
    "R8_hybrid_whole_text": R8_hybrid_whole_text,
    "R9_merged_hits": R9_merged_hits,
    "R13_index_summary": R13_index_summary,
}
_COSINE = """(SELECT q.vec_id AS query, v.vec_id AS doc, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])
    / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS score
    FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)"""
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TFIDF_TOKENS = lambda x: rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOPS}))"
_TITLED_DOCS = f"""SELECT evid_id AS doc, question_id AS grp, coalesce(title, '') || '. ' || coalesce(context_text, '') AS text
    FROM {sql.once('evidence_docs', 'evid_id', 'question_id', 'title', 'context_text')} WHERE question_id IS NOT NULL"""
ORACLES = {
    "R1_index_terms": f"WITH {_bm25(_DOCS, _ASKED, False)} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "R4_bm25_global_topk": f"WITH {_bm25(_DOCS, _ASKED, False)} {_TOP.format('scored', K)}",
    "R3_bm25_group_topk": f"WITH {_bm25(_GROUP_DOCS, _GROUP_ASKED, True)}, f AS (SELECT q.query, d.doc, coalesce(s.score, 0.0) AS score FROM q JOIN d USING (grp) LEFT JOIN scored s ON s.query = q.query AND s.doc = d.doc) {_TOP.format('f', 3)}",
    "R13_index_summary": f"""WITH {_bm25(_GROUP_DOCS, _GROUP_ASKED, True)} SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT count(DISTINCT grp) FROM d) AS n_groups, (SELECT count(*) FROM terms) AS n_terms,
        (SELECT count(*) FROM posts) AS n_postings, (SELECT round(avg(dl), 6) FROM lens) AS avg_length""",
    "R8_dense_topk": f"SELECT query, doc, round(score, 5) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM {_COSINE} QUALIFY rank <= {K}",
    "R8_hybrid_fusion": f"""WITH {_bm25(_DOCS, f"SELECT doc_id AS query, '' AS grp, question AS text FROM documents JOIN ({_ONE}) USING (question_id) WHERE doc_id % 50 = 0", False)},
        r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM scored WHERE doc <> query QUALIFY rank <= 25
        UNION ALL SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM {_COSINE} QUALIFY rank <= 25),
        f AS (SELECT query, doc, sum(1.0 / (60 + rank)) AS score FROM r GROUP BY ALL) {_TOP.format('f', K)}""",
    "R9_merged_hits": f"""SELECT question_id, doc_id, evid_id FROM {sql.once('evidence_docs', 'evid_id', 'question_id', 'doc_id', 'rank', 'fetched_at')} WHERE question_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY fetched_at NULLS FIRST, evid_id) = 1""",
    "R7_reranked": f"""WITH p AS (SELECT d.grp AS question_id, d.doc AS evid_id, {sql.official_words('d.text')} AS p, {sql.official_words('q.text')} AS h FROM ({_GROUP_DOCS}) d JOIN ({_GROUP_ASKED}) q ON q.grp = d.grp),
        s AS (SELECT question_id, evid_id, CASE WHEN len(h) = 0 THEN 0.0 ELSE {sql.overlap('h', 'p')} / len(h) END AS score, count(*) OVER (PARTITION BY question_id) AS n FROM p)
        SELECT question_id, evid_id, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN n > 2 THEN round(score, 9) END DESC NULLS LAST, evid_id) AS rank FROM s QUALIFY rank <= 2""",
    "R10_tfidf_ranking": f"""WITH d AS ({_TITLED_DOCS}), q AS ({_GROUP_ASKED}), t AS (SELECT grp, CAST(doc AS VARCHAR) AS doc, unnest({_TFIDF_TOKENS('text')}) AS term FROM d
        UNION ALL SELECT grp, '' AS doc, unnest({_TFIDF_TOKENS('text')}) AS term FROM q), tf AS (SELECT grp, doc, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT grp, count(*) + 1 AS n FROM d GROUP BY grp),
        df AS (SELECT grp, term, count(*) AS df FROM tf GROUP BY ALL), v AS (SELECT tf.grp, doc, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (grp, term) JOIN n USING (grp)),
        norm AS (SELECT grp, doc, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL), dots AS (SELECT v.grp, v.doc, sum(v.w * a.w) AS dot FROM v JOIN v a ON a.grp = v.grp AND a.term = v.term AND a.doc = '' WHERE v.doc <> '' GROUP BY ALL),
        s AS (SELECT dots.grp, dots.doc, dot / (x.norm * y.norm) AS score FROM dots JOIN norm x ON x.grp = dots.grp AND x.doc = dots.doc JOIN norm y ON y.grp = dots.grp AND y.doc = '')
        SELECT d.grp AS question_id, d.doc AS evid_id, round(CASE WHEN n = 2 THEN 1.0 ELSE coalesce(score, 0.0) END, 6) AS score FROM d JOIN q USING (grp) JOIN n USING (grp) LEFT JOIN s ON s.grp = d.grp AND s.doc = CAST(d.doc AS VARCHAR)""",
}

ORACLES["R8_hybrid_whole_text"] = f"""WITH {_bm25(_DOCS, "SELECT doc_id AS query, '' AS grp, text FROM documents WHERE doc_id % 50 = 0", False)},
    lexical AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM scored WHERE doc <> query QUALIFY rank <= 25),
    dense AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM {_COSINE} QUALIFY rank <= 25),
    f AS (SELECT query, doc, sum(1.0 / (60 + rank)) AS score FROM (FROM lexical UNION ALL FROM dense) GROUP BY ALL) {_TOP.format('f', K)}"""


# ---- further searches ------------------------------------------------------------------------


def R6_overfetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    hits = _index(spark, sf_dir).overfetched(_asked(spark, sf_dir), "example_id", "question", 5, scorer("coverage"), docs, "doc_id", "text")
    return hits.select("query", "doc", F.col("rank").cast("bigint").alias("rank"))


QUERIES |= {"R6_overfetched": R6_overfetched}
ORACLES["R6_overfetched"] = f"""WITH {_bm25(_DOCS, _ASKED, False)}, w AS ({_TOP.format('scored', 25)}), p AS (SELECT w.query, w.doc, {sql.official_words('d.text')} AS p, {sql.official_words('q.text')} AS h FROM w JOIN d ON d.doc = w.doc JOIN q ON q.query = w.query),
    s AS (SELECT query, doc, CASE WHEN len(h) = 0 THEN 0.0 ELSE {sql.overlap('h', 'p')} / len(h) END AS score, count(*) OVER (PARTITION BY query) AS n FROM p)
    SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN n > 5 THEN round(score, 9) END DESC NULLS LAST, doc) AS rank FROM s QUALIFY rank <= 5"""
ORACLES["R11_tfidf_topk"] = ORACLES["R10_tfidf_ranking"].replace("round(CASE WHEN n = 2 THEN 1.0 ELSE coalesce(score, 0.0) END, 6) AS score", "row_number() OVER (PARTITION BY d.grp ORDER BY round(CASE WHEN n = 2 THEN 1.0 ELSE coalesce(score, 0.0) END, 9) DESC, d.doc) AS rank") + " QUALIFY rank <= 2"
ORACLES["R12_pair_cosine"] = f"""WITH r AS {sql.once('trajectories', 'result_id', 'question', 'pred_answer_raw')}, t AS (SELECT result_id, 0 AS d, unnest({_TFIDF_TOKENS("coalesce(question, '')")}) AS term FROM r
    UNION ALL SELECT result_id, 1 AS d, unnest({_TFIDF_TOKENS("coalesce(pred_answer_raw, '')")}) AS term FROM r), v AS (SELECT result_id, term, count(*) FILTER (d = 0) AS x, count(*) FILTER (d = 1) AS y FROM t GROUP BY ALL),
    w AS (SELECT result_id, x * i AS x, y * i AS y FROM (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS i FROM v)),
    s AS (SELECT result_id, CASE WHEN sum(x * x) > 0 AND sum(y * y) > 0 THEN sum(x * y) / sqrt(sum(x * x) * sum(y * y)) ELSE 0.0 END AS c FROM w GROUP BY 1) SELECT r.result_id, round(coalesce(c, 0.0), 6) AS cosine FROM r LEFT JOIN s USING (result_id)"""


# ---- TF-IDF -----------------------------------------------------------------------------------


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_of_each(table(spark, sf_dir, "evidence_docs", "evid_id", "question_id", "title", "context_text"), "evid_id").where("question_id IS NOT NULL")
    return rows.select("evid_id", "question_id", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("context_text", F.lit(""))).alias("titled"))


def _titled_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = tfidf_ranking(_titled(spark, sf_dir), "question_id", "evid_id", "titled", _one_question(spark, sf_dir), "question")
    return ranked.withColumn("evid_id", F.col("evid_id").cast("bigint"))


def R10_tfidf_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled_ranking(spark, sf_dir).select("question_id", "evid_id", F.round("score", 6).alias("score"))


def R11_tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_k(_titled_ranking(spark, sf_dir), ["question_id"], "score", "evid_id", 2)
    return best.select("question_id", "evid_id", F.col("rank").cast("bigint").alias("rank"))


def R12_pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_of_each(table(spark, sf_dir, "trajectories", "result_id", "question", "pred_answer_raw"), "result_id")
    return pair_cosine(rows, "result_id", "question", "pred_answer_raw").select("result_id", F.round("cosine", 6).alias("cosine"))


QUERIES |= {"R10_tfidf_ranking": R10_tfidf_ranking, "R11_tfidf_topk": R11_tfidf_topk, "R12_pair_cosine": R12_pair_cosine}
