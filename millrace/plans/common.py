"""Tables as the queries see them, and the same in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import text_or_empty
from millrace.operators import evidence, retrieval
from millrace.session import checkpoint_dir, delete_on_exit
from millrace.sources.tables import table

#: Searches take as queries every row whose id is divisible by this, against all rows.
EVERY = 100


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieved chunks, each hit once, as hits of requests."""
    rows = table(spark, folder, "retrieved_chunks").withColumnRenamed("request_id", "query_id")
    return rows.dropDuplicates(["hit_id"])


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, each once."""
    return table(spark, folder, "doc_manifest").drop("updated_at").dropDuplicates(["doc_id"])


def units(spark: SparkSession, folder: str) -> DataFrame:
    """Content units, each once, in the order of their ids."""
    return table(spark, folder, "content_units").drop("loaded_at").dropDuplicates(["unit_id"]).withColumn("pos", F.col("unit_id"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_generation_detail")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """The questions that are searched for."""
    return questions(spark, folder).where(F.col("row_id") % EVERY == 0).withColumn("query_id", F.col("row_id"))


def gated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All requests as questions of their first hit's section, and their reranked hits with what the gate looks at.

    Every third request compares, every seventh asks for the stock code of request and hit 2, so that codes and names
    may fail to fit; every eleventh has lost its hits' sources, every thirteenth their texts.
    """
    found = hits(spark, folder).where("stage = 'rerank'")
    codes = manifest(spark, folder).select("doc_id", F.col("stock_code").alias("stock_code_hit"))
    ranked = found.join(codes, "doc_id", "left")
    bare, silent = F.col("query_id") % 11 == 0, F.col("query_id") % 13 == 0
    for c in ("page_start", "page_end", "display_name", "doc_id"):
        ranked = ranked.withColumn(c, F.when(~bare, F.col(c)))
    body = evidence.passage(F.when(~silent, F.col("company_name")), F.col("section_title"), F.when(~silent, F.col("text")))
    ranked = ranked.withColumn("passage", body)
    asking = found.where("rank = 1").select("query_id", F.concat_ws(" ", text_or_empty(F.col("company_name")), text_or_empty(F.col("section_title"))).alias("query"))
    asking = asking.groupBy("query_id").agg(F.min("query").alias("query"))
    second = found.where("rank = 2").groupBy("query_id").agg(F.min("company_name").alias("other"))
    wanted = manifest(spark, folder).where("stock_code <> ''").agg(F.min("stock_code").alias("want"))  # one row
    kind = F.when(F.col("query_id") % 3 == 0, "comparative").when(F.col("query_id") % 3 == 1, "factual").otherwise("summary")
    every = table(spark, folder, "rag_requests").select(F.col("id").alias("query_id")).distinct()
    rows = every.join(asking, "query_id", "left").join(second, "query_id", "left").join(F.broadcast(wanted), how="left")
    names = F.when((kind == "comparative") & (text_or_empty(F.col("other")) != ""), F.array(F.substring_index("query", " ", 1), F.col("other"))).otherwise(F.array().cast("array<string>"))
    code = F.when(F.col("query_id") % 7 == 0, F.coalesce("want", F.lit(""))).otherwise(F.lit(""))
    queries = rows.select("query_id", F.coalesce("query", F.lit("")).alias("query"), kind.alias("query_type"), code.alias("stock_code"), names.alias("name_list"), F.size(names).alias("names"))
    chosen = queries.select("query_id", "query_type", F.col("name_list").alias("names"), evidence.intents(F.col("query"), F.col("query_type")).alias("intents"))
    typed = ranked.join(chosen, "query_id")
    score = evidence.selection_score(F.col("score_rerank"), F.col("intents"), F.col("section_title"), F.col("passage"), F.lit(""), F.col("query_type"))
    return queries.drop("name_list"), typed.withColumn("score_selected", score).drop("query_type", "intents")


def best_chunks(spark: SparkSession, folder: str, k: int = 3) -> DataFrame:
    """The ``k`` chunks of each document of the greatest rerank score they ever had, with ``rank``, each chunk once."""
    found = hits(spark, folder).where("stage = 'rerank'")
    fields = ("doc_id", "page_start", "page_end", "display_name", "company_name", "section_title", "text")
    once = found.groupBy("chunk_id").agg(F.max("score_rerank").alias("score_rerank"), *[F.min(c).alias(c) for c in fields])
    w = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("score_rerank"), "chunk_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


TOKENS = """flatten(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[㐀-䶿一-鿿]+|[a-z0-9]+'),
    lambda r: CASE WHEN length(r) > 1 AND regexp_matches(r, '^[㐀-䶿一-鿿]') THEN list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) ELSE [r] END))"""

INDEX = f"""bags AS (SELECT doc_id AS chunk_id, {TOKENS.format('text')} AS toks FROM documents),
    lengths AS (SELECT chunk_id, len(toks) AS length FROM bags),
    postings AS (SELECT token, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS token FROM bags) GROUP BY token, chunk_id),
    facts AS (SELECT count(*) AS n, avg(length) AS mean_length FROM lengths),
    raw AS (SELECT token, count(*) AS df, ln((SELECT n FROM facts) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings GROUP BY token),
    idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""

HITS = "hits AS (SELECT DISTINCT hit_id, request_id AS query_id, stage, rank, chunk_id, doc_id, company_name, section_title, page_start, page_end, display_name, text, score, score_recall, score_rerank, score_vector, score_bm25 FROM retrieved_chunks)"
BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score_rerank DESC NULLS LAST, chunk_id) AS rank FROM (SELECT chunk_id, max(score_rerank) AS score_rerank, min(doc_id) AS doc_id, min(page_start) AS page_start, min(page_end) AS page_end, min(display_name) AS display_name, min(company_name) AS company_name, min(section_title) AS section_title, min(text) AS text FROM hits WHERE stage = 'rerank' GROUP BY chunk_id)) WHERE rank <= 3)"
MANIFEST = "manifest AS (SELECT DISTINCT ON (doc_id) * FROM doc_manifest ORDER BY doc_id, updated_at)"
UNITS = "units AS (SELECT DISTINCT ON (unit_id) * FROM content_units ORDER BY unit_id, loaded_at)"

#: BM25 for the questions searched for, over documents.
SCORED = f"""{INDEX},
    asked AS (SELECT row_id AS query_id, unnest({TOKENS.format('query')}) AS token FROM eval_generation_detail WHERE row_id % {EVERY} = 0),
    wanted AS (SELECT query_id, token, count(*) AS qtf FROM asked GROUP BY ALL),
    scored AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT mean_length FROM facts)))), 6) AS score
        FROM wanted JOIN idf USING (token) JOIN postings USING (token) JOIN lengths USING (chunk_id) GROUP BY query_id, chunk_id)"""


def index(spark: SparkSession, folder: str) -> retrieval.LexicalIndex:
    """The lexical index of the documents of ``folder``, written once for an application."""
    path = f"{checkpoint_dir(spark)}/lexical-{spark.sparkContext.applicationId}-{hashlib.md5(folder.encode()).hexdigest()}"
    delete_on_exit(spark, path)
    return retrieval.LexicalIndex.saved(spark, path, lambda: retrieval.LexicalIndex(table(spark, folder, "documents"), "doc_id", "text"))


def lexical_hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return index(spark, folder).search(asked(spark, folder), "query_id", "query", k)
