"""Queries of lexical and dense search, fusion and score adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import query as qf
from millrace.operators import retrieval
from millrace.plans.common import EVERY, HITS, INDEX, MANIFEST, SCORED, TOKENS, asked, hits, index, lexical_hits, manifest, questions
from millrace.sources.tables import table


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", retrieval.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def doc_length_stats(spark: SparkSession, folder: str) -> DataFrame:
    return index(spark, folder).lengths.agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean_length"), F.max("length").alias("max_length"), F.count_if(F.col("length") == 0).alias("n_empty"))


def bm25_idf(spark: SparkSession, folder: str) -> DataFrame:
    return index(spark, folder).idf().select("token", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_hits(spark, folder, 10)


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return retrieval.dense_topk(vectors.where(F.col("vec_id") % EVERY == 0), vectors, "vec_id", "vec_id", "embedding", 10)


def minmax_normalize(spark: SparkSession, folder: str) -> DataFrame:
    rows = retrieval.min_max(hits(spark, folder), "query_id", "score_bm25", "normal")
    return rows.select("hit_id", F.round("normal", 6).alias("normal"))


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    found = hits(spark, folder).where("stage = 'recall'")
    best = lambda c: found.where(F.col(c).isNotNull()).groupBy("query_id", "chunk_id").agg(F.max(c).alias("score"))
    return best("score_vector"), best("score_bm25")


def hybrid_fusion_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.weighted_fusion(*_sides(spark, folder), 5)


def _searched(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The questions searched for, with stored vectors as theirs; the vectors of passages; facts of the documents.

    A stored vector stands for the document and for the question of its id, as no encoder is at hand.
    """
    stored = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    wanted = asked(spark, folder).join(stored.withColumnRenamed("vec_id", "query_id"), "query_id", "left")
    rows = wanted.select("query_id", "query", F.coalesce("query_type", F.lit("factual")).alias("query_type"), "stock_code", "vector", qf.sub_queries(F.col("query")).alias("subs"))
    kind = F.when(F.coalesce(F.col("text").rlike("可比公司|PE估值"), F.lit(False)), "comparable_table").otherwise("text")
    facts = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "stock_code", kind.alias("content_type"))
    return rows, stored.withColumnRenamed("vec_id", "chunk_id"), facts


def _routed(spark: SparkSession, folder: str, rows: DataFrame, vectors: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    return retrieval.route_search(rows, index(spark, folder), vectors, facts, k)


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Dense and lexical pools of the questions searched for, fused, adjusted and cut to ten; comparisons in one pass."""
    rows, vectors, facts = _searched(spark, folder)
    found = _routed(spark, folder, rows.withColumn("route", F.lit("hybrid")).withColumn("subs", F.slice("subs", 1, 0)), vectors, facts)
    return found.select("query_id", "chunk_id", "score", "rank")


def route_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the route of each question: dense alone, lexical alone, or both."""
    rows, vectors, facts = _searched(spark, folder)
    number = (F.col("query_id") / EVERY).cast("long") % 3
    routed = rows.withColumn("route", F.when(number == 0, "vector").when(number == 1, "bm25").otherwise("hybrid")).withColumn("subs", F.slice("subs", 1, 0))
    return _routed(spark, folder, routed, vectors, facts).select("query_id", "chunk_id", "score", "rank")


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    lists = [retrieval.ranked(side, "query_id", "chunk_id", F.col("score")).withColumn("list_id", F.lit(i)) for i, side in enumerate(_sides(spark, folder), 1)]
    return retrieval.reciprocal_rank_fusion(lists[0].unionByName(lists[1]), 5)


def fill_short(spark: SparkSession, folder: str) -> DataFrame:
    dense, lexical = _sides(spark, folder)
    top = retrieval.ranked(dense, "query_id", "chunk_id", F.col("score"), 3)
    return retrieval.fill_with_lexical(top, retrieval.ranked(lexical, "query_id", "chunk_id", F.col("score")), 6)


def stock_boost(spark: SparkSession, folder: str) -> DataFrame:
    found = hits(spark, folder).where("stage = 'recall'").join(manifest(spark, folder).select("doc_id", "stock_code"), "doc_id", "left")
    wanted = hits(spark, folder).where("stage = 'recall' AND rank = 2").join(manifest(spark, folder).select("doc_id", F.col("stock_code").alias("want")), "doc_id").groupBy("query_id").agg(F.min("want").alias("want"))
    rows = found.select("query_id", "hit_id", "chunk_id", "score", "stock_code").join(wanted, "query_id")
    return retrieval.boost_stock(rows.where("score IS NOT NULL"), "score", "stock_code", F.array("want")).select("query_id", "hit_id", "score")


def comparable_penalty(spark: SparkSession, folder: str) -> DataFrame:
    found = hits(spark, folder).where("stage = 'recall' AND score IS NOT NULL").withColumn("content_type", F.when(F.contains("section_title", F.lit("可比公司")), "comparable_table").otherwise("text"))
    return retrieval.penalize_comparable(found.select("query_id", "hit_id", "chunk_id", "score", "content_type"), "score", "content_type").select("query_id", "hit_id", "score")


def query_expand(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("row_id", qf.widened(F.col("query"), F.col("stock_code")).alias("widened"))


def compare_entities(spark: SparkSession, folder: str) -> DataFrame:
    names = questions(spark, folder).select("row_id", qf.compared(F.col("query")).alias("names"))
    return names.select("row_id", F.size("names").alias("n_names"), F.array_join("names", "|").alias("names"))


def comparative_sub_queries(spark: SparkSession, folder: str) -> DataFrame:
    subs = questions(spark, folder).where("query_type = 'comparative'").select("row_id", F.posexplode(qf.sub_queries(F.col("query"))).alias("pos", "sub"))
    return subs.select("row_id", "pos", "sub.entity", "sub.query")


def vector_weight(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("row_id", qf.dense_weight(F.col("query_type"), F.col("query"), 0.35).alias("weight"))


def comparative_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Comparisons searched for once per compared name, dense and lexical, the lists fused by reciprocal rank."""
    rows, vectors, facts = _searched(spark, folder)
    compared = rows.where("size(subs) >= 2").withColumn("route", F.lit("hybrid")).withColumn("query_type", F.lit("comparative"))
    return _routed(spark, folder, compared, vectors, facts).select("query_id", "chunk_id", "score", "rank")


QUERIES = [
    bm25_topk, tokenize, doc_length_stats, bm25_idf, cosine_topk, minmax_normalize, hybrid_fusion_topk, hybrid_search, route_search, rrf_fusion, fill_short, stock_boost,
    comparable_penalty, query_expand, compare_entities, comparative_sub_queries, vector_weight, comparative_rrf,
]

_DENSE = "dense AS (SELECT query_id, chunk_id, max(score_vector) AS score FROM hits WHERE stage = 'recall' AND score_vector IS NOT NULL GROUP BY ALL)"
_LEXICAL = "lexical AS (SELECT query_id, chunk_id, max(score_bm25) AS score FROM hits WHERE stage = 'recall' AND score_bm25 IS NOT NULL GROUP BY ALL)"
_NORMAL = "CASE WHEN score IS NULL THEN NULL WHEN max(score) OVER q <= min(score) OVER q THEN 1.0 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END"
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id)"
_ANY = " OR ".join


def _has(column: str, words) -> str:
    return "(" + _ANY(f"contains({column}, '{w}')" for w in words) + ")"


_WIDENED = "concat_ws(' ', trim(coalesce(query, '')), nullif(coalesce(stock_code, ''), ''), " + ", ".join(f"CASE WHEN {_has('query', words)} THEN '{more}' END" for words, more in qf.EXPANSIONS) + ")"


def _hybrid_sql(route: str) -> str:
    """Both pools of each question by its route, fused, lowered and raised, in SQL."""
    scored = SCORED.replace(TOKENS.format("query"), TOKENS.format(_WIDENED))
    return f"""WITH {scored},
        routes AS (SELECT row_id AS query_id, {route} AS route, CASE WHEN query_type = 'comparative' THEN 0.45 WHEN query_type = 'summary' THEN 0.5 WHEN {_has("query", qf.NUMERIC_WORDS)} THEN 0.35 ELSE 0.5 END AS weight, trim(coalesce(stock_code, '')) AS code FROM eval_generation_detail WHERE row_id % {EVERY} = 0),
        pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % {EVERY} = 0),
        dense AS (SELECT * FROM (SELECT query_id, chunk_id, score, {_TOP} AS r FROM pairs JOIN routes USING (query_id) WHERE route <> 'bm25') WHERE r <= 200),
        lexical AS (SELECT * FROM (SELECT query_id, chunk_id, score, {_TOP} AS r FROM scored JOIN routes USING (query_id) WHERE route <> 'vector' AND score > 0) WHERE r <= 200),
        a AS (SELECT query_id, chunk_id, {_NORMAL} AS normal FROM dense WINDOW q AS (PARTITION BY query_id)), b AS (SELECT query_id, chunk_id, {_NORMAL} AS normal FROM lexical WINDOW q AS (PARTITION BY query_id)),
        f AS (SELECT query_id, chunk_id, round(weight * coalesce(a.normal, 0) + (1 - weight) * coalesce(b.normal, 0), 6) AS score FROM a FULL JOIN b USING (query_id, chunk_id) JOIN routes USING (query_id) WHERE route = 'hybrid'),
        e AS (SELECT * FROM f UNION ALL SELECT query_id, chunk_id, score FROM dense JOIN routes USING (query_id) WHERE route = 'vector' UNION ALL SELECT query_id, chunk_id, score FROM lexical JOIN routes USING (query_id) WHERE route = 'bm25'),
        t AS (SELECT * FROM (SELECT query_id, chunk_id, score, {_TOP} AS r FROM e) WHERE r <= 10),
        l AS (SELECT t.*, code, trim(coalesce(stock_code, '')) AS own, round(CASE WHEN regexp_matches(coalesce(text, ''), '可比公司|PE估值') THEN greatest(0, score - 0.1) ELSE score END, 6) AS low FROM t JOIN routes USING (query_id) LEFT JOIN documents ON doc_id = chunk_id),
        s AS (SELECT query_id, chunk_id, round(low + CASE WHEN code <> '' AND own = code THEN 0.12 ELSE 0 END, 6) AS score FROM l)
        SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_TOP} AS rank FROM s)"""


SQL = {
    "tokenize": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)",
    "doc_length_stats": f"WITH {INDEX} SELECT count(*) AS n, round(avg(length), 6) AS mean_length, CAST(max(length) AS INTEGER) AS max_length, count(*) FILTER (length = 0) AS n_empty FROM lengths",
    "bm25_idf": f"WITH {INDEX} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {SCORED} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_TOP} AS rank FROM scored WHERE score > 0) WHERE rank <= 10",
    "cosine_topk": f"""WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings q JOIN embeddings v ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id)
        SELECT chunk_id, query_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_TOP} AS rank FROM pairs) WHERE rank <= 10""",
    "minmax_normalize": f"WITH {HITS}, s AS (SELECT hit_id, query_id, score_bm25 AS score FROM hits) SELECT hit_id, round({_NORMAL}, 6) AS normal FROM s WINDOW q AS (PARTITION BY query_id)",
    "hybrid_fusion_topk": f"""WITH {HITS}, {_DENSE}, {_LEXICAL},
        a AS (SELECT query_id, chunk_id, score, {_NORMAL} AS normal FROM dense WINDOW q AS (PARTITION BY query_id)),
        b AS (SELECT query_id, chunk_id, score, {_NORMAL} AS normal FROM lexical WINDOW q AS (PARTITION BY query_id)),
        f AS (SELECT query_id, chunk_id, round(0.35 * coalesce(a.normal, 0) + (1 - 0.35) * coalesce(b.normal, 0), 6) AS score, coalesce(a.score, 0) AS score_vector, coalesce(b.score, 0) AS score_bm25 FROM a FULL JOIN b USING (query_id, chunk_id))
        SELECT query_id, chunk_id, score, score_vector, score_bm25, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_TOP} AS rank FROM f) WHERE rank <= 5""",
    "hybrid_search": _hybrid_sql("'hybrid'"),
    "route_search": _hybrid_sql(f"CASE (row_id // {EVERY}) % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'bm25' ELSE 'hybrid' END"),
    "rrf_fusion": f"""WITH {HITS}, {_DENSE}, {_LEXICAL}, lists AS (SELECT query_id, chunk_id, 1 AS list_id, {_TOP} AS rank FROM dense UNION ALL SELECT query_id, chunk_id, 2, {_TOP} FROM lexical),
        f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, max(list_id) AS last_list FROM lists GROUP BY query_id, chunk_id)
        SELECT query_id, chunk_id, score, last_list, CAST(rank AS INTEGER) AS rank FROM (SELECT *, {_TOP} AS rank FROM f) WHERE rank <= 5""",
    "fill_short": f"""WITH {HITS}, {_DENSE}, {_LEXICAL}, d AS (SELECT * FROM (SELECT query_id, chunk_id, {_TOP} AS rank FROM dense) WHERE rank <= 3), l AS (SELECT query_id, chunk_id, {_TOP} AS rank FROM lexical),
        b AS (SELECT query_id, chunk_id, rank, 0 AS tier FROM d UNION ALL SELECT query_id, chunk_id, rank, 1 FROM l ANTI JOIN d USING (query_id, chunk_id))
        SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, chunk_id) AS rank FROM b) WHERE rank <= 6""",
    "stock_boost": f"""WITH {HITS}, {MANIFEST}, w AS (SELECT query_id, min(stock_code) AS want FROM hits JOIN manifest USING (doc_id) WHERE stage = 'recall' AND rank = 2 GROUP BY query_id)
        SELECT query_id, hit_id, round(score + CASE WHEN trim(stock_code) = trim(want) AND trim(want) <> '' THEN 0.12 ELSE 0 END, 6) AS score
        FROM hits LEFT JOIN manifest USING (doc_id) JOIN w USING (query_id) WHERE stage = 'recall' AND score IS NOT NULL""",
    "comparable_penalty": f"WITH {HITS} SELECT query_id, hit_id, round(CASE WHEN contains(section_title, '可比公司') THEN greatest(0, score - 0.1) ELSE score END, 6) AS score FROM hits WHERE stage = 'recall' AND score IS NOT NULL",
    "query_expand": "SELECT row_id, concat_ws(' ', trim(coalesce(query, '')), nullif(coalesce(stock_code, ''), ''), "
    + ", ".join(f"CASE WHEN {_has('query', words)} THEN '{more}' END" for words, more in qf.EXPANSIONS)
    + ") AS widened FROM eval_generation_detail",
    "compare_entities": f"""WITH t AS (SELECT row_id, trim(coalesce(query, '')) AS q FROM eval_generation_detail),
        p AS (SELECT row_id, trim(regexp_extract(q, '{qf.COMPARE}', 1)) AS a1, trim(regexp_replace(regexp_extract(q, '{qf.COMPARE}', 2), '[0-9０-９].*$', '')) AS b1,
            trim(regexp_extract(q, '{qf.COMPARE_OPEN}', 1)) AS a2, trim(regexp_replace(regexp_extract(q, '{qf.COMPARE_OPEN}', 2), '[0-9０-９].*$', '')) AS b2 FROM t),
        c AS (SELECT row_id, CASE WHEN length(a1) >= 2 AND length(b1) >= 2 THEN a1 || '|' || b1 WHEN length(a2) >= 2 AND length(b2) >= 2 THEN a2 || '|' || b2 ELSE '' END AS names FROM p)
        SELECT row_id, CASE WHEN names = '' THEN 0 ELSE 2 END AS n_names, names FROM c""",
    "vector_weight": f"SELECT row_id, CAST(CASE WHEN query_type = 'comparative' THEN 0.45 WHEN query_type = 'summary' THEN 0.5 WHEN {_has('query', qf.NUMERIC_WORDS)} THEN 0.35 ELSE 0.5 END AS DOUBLE) AS weight FROM eval_generation_detail",
}
