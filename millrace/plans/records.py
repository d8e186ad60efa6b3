"""Queries of chunk records, tables as text, prompts, encoders and the cache's codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import query as qf
from millrace.functions import text as tx
from millrace.operators import cache, chunking, evidence, metrics, models, records, retrieval
from millrace.plans.common import BEST, HITS, MANIFEST, UNITS, asked, best_chunks, hits, manifest, questions, units
from millrace.plans.ingest import _markers, _strip
from millrace.plans.quality import _CUT
from millrace.session import cut
from millrace.sources.tables import table


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    return units(spark, folder).where("unit_type = 'table' AND table_header IS NOT NULL")


def rating_headlines(spark: SparkSession, folder: str) -> DataFrame:
    return records.rating_headlines(manifest(spark, folder)).select("doc_id", "chunk_id", "text")


def table_sections(spark: SparkSession, folder: str) -> DataFrame:
    title = records.table_section(F.col("section_title"), F.col("table_caption"), tx.table_header(F.col("text")))
    return _tables(spark, folder).select("unit_id", title.alias("title"))


def table_kinds(spark: SparkSession, folder: str) -> DataFrame:
    c, h, r, s = F.col("table_caption"), F.col("table_header"), F.col("table_rows"), F.col("section_title")
    rows = _tables(spark, folder).select(tx.is_comparable_table(c, h).alias("comparable"), records.is_unit_column_table(h).alias("unit_column"), records.is_complex_table(c, h, r, s).alias("complex"), tx.is_rating_standard_table(F.col("text"), s, c, h).alias("rating_standard"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def table_readings(spark: SparkSession, folder: str) -> DataFrame:
    """What each table says, by its kind."""
    said = records.narratives(_tables(spark, folder), "unit_id")
    return said.select("unit_id", F.length("narrative").alias("n_chars"), F.md5("narrative").alias("digest"))


def _context(spark: SparkSession, folder: str) -> DataFrame:
    rows = _tables(spark, folder).join(manifest(spark, folder).select("doc_id", "company_name", "stock_code", "broker", "report_title"), "doc_id", "left")
    unit = tx.unit_named_in(F.col("table_caption"))
    block = records.table_context(*[F.col(c) for c in ("company_name", "stock_code", "broker", "report_title", "section_title", "table_caption")], unit, F.col("table_header"), F.col("page_number"))
    return rows.withColumn("context", block)


def table_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each table in parts that fit their budget with the context before them."""
    rows = _context(spark, folder).withColumn("context_tokens", chunking.token_count(F.col("context")))
    parts = records.table_parts(rows, "unit_id", cut(records.sentences(rows, "unit_id")), 240)
    return parts.select("unit_id", "part_index", "part_count", F.size("rows").alias("n_rows"))


def table_embedding_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = _context(spark, folder)
    raw = records.table_raw(F.col("table_caption"), F.col("table_header"), F.col("table_rows"))
    said = records.narratives(rows, "unit_id")
    body = F.coalesce(F.nullif("narrative", F.lit("")), raw)
    text = F.concat_ws("\n\n", "context", body)
    return rows.join(said, "unit_id", "left").select("unit_id", F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


def chunk_records(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks of all documents: packed text, tables in parts, noise, merged appendices, rating headlines."""
    rows = records.document_chunks(units(spark, folder), manifest(spark, folder))
    return rows.select("chunk_id", "doc_id", "content_type", "is_retrievable", "section_title", "page_start", "page_end", "unit_count", "table_part_index", "table_part_count", "char_count", "token_count", "embedding_token_count", F.md5("text").alias("digest"), F.md5("embedding_text").alias("embedding_digest"))


def chunk_types(spark: SparkSession, folder: str) -> DataFrame:
    """How many chunks there are of each type."""
    rows = records.document_chunks(units(spark, folder), manifest(spark, folder))
    return rows.groupBy("content_type", "industry_label").agg(F.count("*").alias("n"), F.sum("char_count").alias("n_chars"), F.max("embedding_token_count").alias("longest"), F.count_if("contains_table").alias("n_tables"))


def appendix_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive units of appendix sections joined within their document."""
    rows = chunking.islands(units(spark, folder), "doc_id", "pos", F.coalesce(F.col("section_title").rlike(records.APPENDIX), F.lit(False)))
    return chunking.merge_islands(rows, "doc_id", "pos", "text").where("n_rows > 1").select("doc_id", "island", "n_rows", F.length("text").alias("n_chars"))


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """For each question the prompt with its document's first three reranked passages, which are chosen once for each document."""
    wanted = questions(spark, folder).select(F.col("row_id").alias("query_id"), "doc_id", "query", F.col("query_type").alias("kind"))
    top = wanted.join(best_chunks(spark, folder).withColumnRenamed("rank", "idx"), "doc_id")
    page = evidence.page_label(F.col("page_start"), F.col("page_end"))
    text = evidence.passage(F.col("company_name"), F.col("section_title"), F.col("text"))
    block = records.context_block(F.col("idx"), F.col("company_name"), F.col("section_title"), page, text)
    parts = top.groupBy("query_id", "query", "kind").agg(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))).alias("p"))
    whole = records.prompt(F.col("query"), F.col("kind"), F.col("p.b"), qf.compared(F.col("query")))
    return parts.select("query_id", F.size("p").alias("n_blocks"), F.length(whole).alias("n_chars"))


def encoded_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Dense search of the questions searched for over documents, with vectors of the deterministic encoder."""
    passages = table(spark, folder, "documents").where("length(text) > 1").select("doc_id", models.embed(F.col("text")).alias("v"))
    wanted = asked(spark, folder).select((-F.col("query_id")).alias("doc_id"), models.embed(F.col("query"), prefix="query: ").alias("v"))
    return retrieval.dense_topk(wanted, passages, "doc_id", "doc_id", "v", 10)


def company_hints(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("row_id", qf.company_hint(F.col("query")).alias("company"), qf.report_year(F.col("query")).alias("report_year"))


def paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    """Each question in six ways, and whether an exact cache would still find it."""
    rows = questions(spark, folder).where("query IS NOT NULL").select("row_id", "query", F.explode(F.array(*map(F.lit, qf.PARAPHRASES))).alias("variant"))
    said = rows.withColumn("said", qf.paraphrase(F.col("query"), F.col("variant")))
    same = qf.cache_text(F.col("query")) == qf.cache_text(F.col("said"))
    return said.withColumn("same", same).groupBy("variant").agg(F.count("*").alias("n"), F.count_if("same").alias("n_exact"), F.count_if(F.col("said") == F.col("query")).alias("n_unchanged"))


def cache_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Entries as they come back from their JSON form."""
    rows = questions(spark, folder).select(F.md5("query").alias("storage_key"), "query", F.lit("chat").alias("scope"), "stock_code", "query_type", F.lit(60).alias("ttl_s"), "refused", F.array("top1_chunk_id").alias("chunk_ids"), "row_id")
    back = rows.withColumn("e", cache.entry_from_json(cache.entry_to_json(*[F.col(c) for c in rows.columns if c != "row_id"])))
    return back.select("row_id", "e.storage_key", "e.query", "e.stock_code", "e.query_type", "e.refused", "e.ttl_s", F.array_join("e.chunk_ids", ",").alias("chunks"))


def missing_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Cached answers whose first chunk the store of hits does not know."""
    entries = questions(spark, folder).where("top1_chunk_id IS NOT NULL").select(F.col("row_id").alias("entry_id"), F.array("top1_chunk_id").alias("chunk_ids"))
    return cache.missing_chunks(entries, hits(spark, folder).select("chunk_id")).select("entry_id", F.array_join("missing", ",").alias("missing"))


def token_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """How many hits hold a metric by any of its names."""
    names = F.explode(F.array(*map(F.lit, metrics.ALIASES))).alias("token")
    rows = hits(spark, folder).select("text", names)
    return rows.groupBy("token").agg(F.count_if(metrics.any_token(F.col("text"), F.array("token"))).alias("n"))


QUERIES = [
    rating_headlines, table_sections, table_kinds, table_readings, table_parts, table_embedding_text, chunk_records, chunk_types, appendix_chunks, prompts, encoded_topk, company_hints, paraphrases,
    cache_codec, missing_chunks, token_aliases,
]

_PAGE = "CASE WHEN coalesce(page_start, 0) <= 0 THEN '' WHEN coalesce(page_end, 0) > page_start THEN '第' || page_start || '-' || page_end || '页' ELSE '第' || page_start || '页' END"
_PAIR = "CASE WHEN length(trim(regexp_extract({0}, '{1}', 1))) >= 2 AND length(trim(regexp_replace(regexp_extract({0}, '{1}', 2), '[0-9０-９].*$', ''))) >= 2 THEN trim(regexp_extract({0}, '{1}', 1)) || '、' || trim(regexp_replace(regexp_extract({0}, '{1}', 2), '[0-9０-９].*$', '')) END"
_NAMES = f"coalesce({_PAIR.format('trim(query)', qf.COMPARE)}, {_PAIR.format('trim(query)', qf.COMPARE_OPEN)}, '')"

_HEAD = "coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: " + _strip("x") + "), lambda x: x <> '')[1], '')"
_NAMED = f"{records.FINANCIAL_TABLE}|{records.SELF_TITLED}"

SQL = {
    "table_sections": f"""WITH {UNITS}, t AS (SELECT unit_id, {_markers("coalesce(section_title, '')")} AS current, {_markers("coalesce(table_caption, '')")} AS caption, {_strip(_HEAD)} AS head FROM units WHERE unit_type = 'table' AND table_header IS NOT NULL)
        SELECT unit_id, CASE WHEN caption <> '' AND regexp_matches(caption, '{_NAMED}') THEN caption WHEN head <> '' AND regexp_matches(head, '{_NAMED}') THEN head WHEN regexp_matches(current, '{records.MISLEADING_SECTION}') AND coalesce(nullif(caption, ''), nullif(head, '')) IS NOT NULL THEN coalesce(nullif(caption, ''), nullif(head, ''))
        ELSE coalesce(nullif(current, ''), caption) END AS title FROM t""",
    "rating_headlines": f"""WITH {MANIFEST} SELECT doc_id, doc_id || '_rating_headline' AS chunk_id, coalesce(nullif(company_name, ''), nullif(report_title, ''), '该公司') || CASE WHEN coalesce(stock_code, '') <> '' THEN '（' || stock_code || '）' ELSE '' END
        || ' 研报投资评级：' || rating || '。' || CASE WHEN coalesce(broker, '') <> '' THEN ' 券商：' || broker || '。' ELSE '' END AS text FROM manifest WHERE coalesce(rating, '') <> ''""",
    "appendix_chunks": f"""WITH {UNITS}, m AS (SELECT *, coalesce(regexp_matches(section_title, '附录|三大报表|财务报表预测|盈利预测与估值'), false) AS own FROM units),
        f AS (SELECT doc_id, unit_id, coalesce(text, '') AS t, CASE WHEN own AND coalesce(lag(own) OVER w, false) THEN 0 ELSE 1 END AS s FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY unit_id)),
        g AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY unit_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f)
        SELECT doc_id, island, CAST(count(*) AS INTEGER) AS n_rows, CAST(length(string_agg(t, chr(10) ORDER BY unit_id)) AS INTEGER) AS n_chars FROM g GROUP BY doc_id, island HAVING count(*) > 1""",
    "cache_codec": "SELECT row_id, md5(query) AS storage_key, query, stock_code, query_type, refused, 60 AS ttl_s, coalesce(top1_chunk_id, '') AS chunks FROM eval_generation_detail",
    "token_aliases": f"WITH {HITS}, t AS (SELECT unnest([" + ", ".join(f"{{'token': '{k}', 'words': [{', '.join(chr(39) + w + chr(39) for w in v)}]}}" for k, v in metrics.ALIASES.items()) + "], recursive := true)) SELECT token, count(*) FILTER (len(list_filter(words, lambda w: contains(coalesce(text, ''), w))) > 0) AS n FROM hits, t GROUP BY token",
    "prompts": f"""WITH {HITS}, {BEST}, w AS (SELECT row_id AS query_id, doc_id, coalesce(query, '') AS query, coalesce(query_type, 'factual') AS kind FROM eval_generation_detail),
        p AS (SELECT query_id, query, kind, rank, length('[' || rank || '] 公司：' || coalesce(nullif(trim(coalesce(company_name, '')), ''), '未知公司') || ' | 章节：' || coalesce(nullif(trim(coalesce(section_title, '')), ''), '未知章节') || ' | 页码：' || {_PAGE}) + 1 + least(length({_CUT}), 1200) AS n FROM w JOIN best USING (doc_id)),
        g AS (SELECT query_id, query, kind, count(*) AS n_blocks, sum(n) + 2 * (count(*) - 1) AS n FROM p GROUP BY ALL),
        h AS (SELECT *, CASE kind {" ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in records.TYPE_HINTS.items())} ELSE {len(records.TYPE_HINTS["factual"])} END AS hint, {_NAMES} AS names FROM g)
        SELECT query_id, CAST(n_blocks AS INTEGER) AS n_blocks, CAST(3 + length(query) + 1 + 3 + length(kind) + 1 + CASE WHEN names = '' THEN 0 ELSE 5 + length(names) + 1 END + 5 + hint + 1 + 5 + n AS INTEGER) AS n_chars FROM h""",
    "missing_chunks": "SELECT row_id AS entry_id, top1_chunk_id AS missing FROM eval_generation_detail WHERE top1_chunk_id IS NOT NULL AND top1_chunk_id NOT IN (SELECT chunk_id FROM retrieved_chunks WHERE chunk_id IS NOT NULL)",
}
