"""Queries of reranking, evidence, citations, relevance, metrics and the result cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import query as qf
from millrace.functions.text import stripped, text_or_empty
from millrace.operators import cache, evidence, metrics, retrieval
from millrace.plans.common import BEST, EVERY, HITS, MANIFEST, SCORED, TOKENS, asked, best_chunks, gated, hits, lexical_hits, manifest, questions
from millrace.plans.search import _has
from millrace.sources.tables import table


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Reranked hits with a deterministic score: how much of the first hit's section title a passage holds."""
    found = hits(spark, folder).where("stage = 'rerank'")
    first = found.where("rank = 1").groupBy("query_id").agg(F.min(text_or_empty(F.col("section_title"))).alias("query"))
    return found.join(first, "query_id")


def rerank_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder)
    score = evidence.lexical_overlap(retrieval.tokens(F.col("query")), retrieval.tokens(F.col("text")))
    best = rows.groupBy("query_id", "chunk_id").agg(F.max(score).alias("overlap"))
    return evidence.rerank(best, F.col("overlap"), 3).select("query_id", "chunk_id", "score_rerank", "rank")


def comparative_quota(spark: SparkSession, folder: str) -> DataFrame:
    """For each request the companies of its first two ranks as compared names, each with places of its own."""
    found = hits(spark, folder).where("stage = 'rerank'")
    best = found.groupBy("query_id", "chunk_id").agg(F.max("score_rerank").alias("score_rerank"), F.min("company_name").alias("company_name"))
    names = found.where("rank <= 2 AND company_name IS NOT NULL").groupBy("query_id", F.col("rank").alias("pos")).agg(F.min("company_name").alias("entity"))
    two = names.groupBy("query_id").agg(F.countDistinct("entity").alias("c")).where("c = 2").select("query_id")
    return evidence.comparative_quota(best, names.join(two, "query_id"), 5).select("query_id", "chunk_id", "rank")


def distinct_sources_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = hits(spark, folder).where("rank <= 5 AND trim(company_name) <> ''")
    return found.groupBy("query_id", "stage").agg(F.countDistinct(F.trim("company_name")).alias("companies"))


def evidence_intents(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("row_id", F.array_join(evidence.intents(F.col("query"), F.col("query_type")), ",").alias("intents"))


def evidence_select(spark: SparkSession, folder: str) -> DataFrame:
    _, found = gated(spark, folder)
    return evidence.select_evidence(found, 3).select("query_id", "hit_id", "score_selected", "place")


def evidence_gate(spark: SparkSession, folder: str) -> DataFrame:
    queries, found = gated(spark, folder)
    return evidence.gate(queries, found.drop("names")).select("query_id", "n_hits", "top_score", "reason", "passed")


def refusal_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return evidence_gate(spark, folder).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("top_score"), 6).alias("mean_top_score"))


def refusal_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = questions(spark, folder).where("refusal_reason IS NOT NULL")
    return rows.select("row_id", evidence.refusal_message(F.col("refusal_reason"), F.col("top_rerank_score")).alias("message"))


def citations(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.citations(hits(spark, folder).where("stage = 'rerank'"), 3).select("query_id", "idx", "chunk_id", "line")


def passages(spark: SparkSession, folder: str) -> DataFrame:
    text = evidence.passage(F.col("company_name"), F.col("section_title"), F.col("text"))
    return hits(spark, folder).select("hit_id", F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


def extractive_answers(spark: SparkSession, folder: str) -> DataFrame:
    found = hits(spark, folder).where("stage = 'rerank' AND rank <= 3").dropDuplicates(["query_id", "chunk_id"])
    return evidence.extractive_answer(found, evidence.citations(found, 3))


def _judged(spark: SparkSession, folder: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The questions searched for, and their lexical hits with their relevance: the stock code fits."""
    none = F.lit(None).cast("array<string>")
    empty = F.lit(None).cast("string")
    found = lexical_hits(spark, folder, k)
    have = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "stock_code", "text", "broker", *[empty.alias(c) for c in ("doc_id", "industry_label", "section_title", "embedding_text", "display_name", "company_name", "report_title", "rating")])
    lists = [none.alias(c) for c in ("negative_stock_codes", "gold_chunk_ids", "section_keywords", "must_contain_any")]
    wanted = asked(spark, folder).select("query_id", "query_type", "category", "stock_code", F.lit("-").alias("doc_id"), empty.alias("industry_label"), *lists)
    rows = found.join(have, "chunk_id").alias("h").join(wanted.alias("q"), F.col("h.query_id") == F.col("q.query_id"))
    return wanted.select("query_id", "query_type"), rows.select("h.query_id", "h.chunk_id", "h.rank", metrics.relevant("h", "q").alias("relevant"))


def _graded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All questions, and the three best reranked chunks of each one's document, chosen once for each document, with the hit's fields.

    The gold chunk is the question's first chunk; figures of the gold answer are its wanted tokens; questions about
    ratings name their section; the last code of the list of companies is never wanted.
    """
    docs = manifest(spark, folder).select("doc_id", "stock_code", "industry_label", "report_title", "broker", "rating")
    best = best_chunks(spark, folder).join(docs, "doc_id", "left")
    best = best.select("doc_id", "chunk_id", "rank", "page_start", "display_name", "company_name", "section_title", "text", F.lit("").alias("embedding_text"), "stock_code", "industry_label", "report_title", "broker", "rating")
    figures = F.slice(F.array_distinct(F.regexp_extract_all(text_or_empty(F.col("gold_answer")), F.lit(r"[0-9]+(?:\.[0-9]+)?%?"), F.lit(0))), 1, 3)
    never = table(spark, folder, "companies").agg(F.max("stock_code").alias("never"))  # one row
    rows = questions(spark, folder).join(F.broadcast(never), how="left").select(
        F.col("row_id").alias("query_id"), "query_type", "category", "strategy", "stock_code", "doc_id", F.lit("").alias("industry_label"), "answer", "refused", "citation_count", "top_rerank_score",
        F.array("never").alias("negative_stock_codes"), F.array_compact(F.array("top1_chunk_id")).alias("gold_chunk_ids"), F.when(F.col("category") == "rating", F.array(F.lit("投资评级"))).alias("section_keywords"), figures.alias("must_contain_any"),
    )
    return rows, best


def relevance(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the best chunks of each question's document answer it, by kind of question."""
    rows, best = _graded(spark, folder)
    judged = best.alias("h").join(rows.alias("q"), F.col("h.doc_id") == F.col("q.doc_id")).select("q.query_type", "q.category", metrics.relevant("h", "q").alias("relevant"))
    return judged.groupBy("query_type", "category").agg(F.count("*").alias("n"), F.count_if("relevant").alias("n_relevant"))


def recall_mrr_by_route(spark: SparkSession, folder: str) -> DataFrame:
    """Per question: recall, precision and reciprocal rank of lexical search."""
    return metrics.per_question(*_judged(spark, folder))


def _routes(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of each request's recall and rerank stage as routes; relevant is the company of the first reranked hit."""
    found = hits(spark, folder)
    want = found.where("stage = 'rerank' AND rank = 1").groupBy("query_id").agg(F.min("company_name").alias("want"))
    rows = found.join(want, "query_id").select(F.concat_ws(":", "stage", "query_id").alias("query_id"), "rank", F.coalesce(F.col("company_name") == F.col("want"), F.lit(False)).alias("relevant"), "stage")
    kinds = rows.select("query_id", F.col("stage").alias("route")).distinct()
    number = F.substring_index("query_id", ":", -1).cast("long")
    kinds = kinds.withColumn("query_type", F.when(number % 3 == 0, "comparative").when(number % 3 == 1, "factual").otherwise("summary"))
    return metrics.per_question(kinds, rows)


def metrics_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.means_by_route(_routes(spark, folder))


def context_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _routes(spark, folder).groupBy("route").agg(F.round(F.avg("precision_at_5"), 6).alias("p5"), F.round(F.avg("precision_at_10"), 6).alias("p10"))


def weight_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion at six weights in one pass: how often the first reranked chunk is among the first three fused."""
    found = hits(spark, folder)
    pairs = found.where("stage = 'rerank'").groupBy("query_id", "chunk_id").agg(F.max("score_vector").alias("v"), F.max("score_bm25").alias("b"), F.min("rank").alias("r"))
    both = retrieval.min_max(retrieval.min_max(pairs, "query_id", "v", "nv"), "query_id", "b", "nb")
    weights = F.explode(F.array(*[F.lit(w) for w in (0.3, 0.35, 0.4, 0.5, 0.6, 0.7)])).alias("weight")
    swept = both.select("query_id", "chunk_id", "r", "nv", "nb", weights)
    score = F.round(F.col("weight") * F.coalesce("nv", F.lit(0.0)) + (1 - F.col("weight")) * F.coalesce("nb", F.lit(0.0)), 6)
    keyed = swept.withColumn("score", score).withColumn("q", F.concat_ws("@", "query_id", F.col("weight").cast("string")))
    top = retrieval.ranked(keyed, "q", "chunk_id", F.col("score"))
    first = top.where("r = 1")
    return first.groupBy("weight").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("rank") <= 3, 1.0).otherwise(0.0)), 6).alias("recall_at_3"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"))


def citation_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """The seven checks of each answer's citations: the best chunks of its document, as many as it counts."""
    rows, best = _graded(spark, folder)
    cited = best.join(rows.select("query_id", "doc_id", "citation_count"), "doc_id").where("rank <= citation_count").withColumn("in_rerank", F.lit(True))
    checked = metrics.citation_checks(rows, cited).join(rows.select("query_id", "query_type"), "query_id")
    return checked.groupBy("query_type", "applicable").agg(F.count("*").alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"), *[F.count_if(c).alias(f"n_{c}") for c in metrics.CITATION_CHECKS])


def refusal_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """How often the refusal column agrees with the threshold on the best score."""
    rows = questions(spark, folder).where("refused IS NOT NULL AND top_rerank_score IS NOT NULL")
    should = F.col("top_rerank_score") < evidence.REFUSAL_THRESHOLD
    return rows.groupBy("strategy").agg(F.count("*").alias("n"), F.count_if("refused").alias("n_refused"), F.round(F.avg((F.col("refused") == should).cast("double")), 6).alias("accuracy"))


def answer_support(spark: SparkSession, folder: str) -> DataFrame:
    ok = metrics.supported(F.col("answer"), F.array().cast("array<string>"), F.col("gold_answer"), F.col("refused"))
    return questions(spark, folder).groupBy("query_type", "strategy").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_supported"))


def answer_bodies(spark: SparkSession, folder: str) -> DataFrame:
    body = stripped(F.substring_index(text_or_empty(F.col("answer")), "\n参考来源", 1))
    return questions(spark, folder).select("row_id", F.length(body).alias("n_chars"), F.md5(body).alias("digest"))


def gold_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """For each question the three chunks of its document that hold most of its gold answer's pairs of letters.

    A document that holds a tenth of the rows is spread: the join is by document and token.
    """
    wanted = questions(spark, folder).select(F.col("row_id").alias("query_id"), "doc_id", F.explode(F.array_distinct(retrieval.tokens(F.col("gold_answer")))).alias("token"))
    have = hits(spark, folder).select("doc_id", "chunk_id", "text").dropDuplicates(["chunk_id"]).select("doc_id", "chunk_id", F.explode(F.array_distinct(retrieval.tokens(F.col("text")))).alias("token"))
    counted = wanted.join(have, ["doc_id", "token"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("score"))
    return retrieval.ranked(counted, "query_id", "chunk_id", F.col("score"), 3)


def missing_gold_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Questions whose first chunk was never retrieved."""
    known = hits(spark, folder).select("chunk_id").distinct()
    return questions(spark, folder).where("top1_chunk_id IS NOT NULL").join(known, F.col("top1_chunk_id") == F.col("chunk_id"), "left_anti").select("row_id", "top1_chunk_id")


def normalize_query(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("row_id", qf.cache_text(F.col("query")).alias("form"))


_GENERATION = "model=local|prompt=v1|ctx=8192|pred=2048"
_CONFIG = "route=hybrid|rtk=30|rrk=5|ref=0.3500|hw=0.3500|pool=200"


def _entries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Questions as cache entries (the first of each key stored) and as requests a day later."""
    rows = questions(spark, folder)
    meta = cache.metadata_fingerprint(F.col("stock_code"), F.col("query_type"), qf.company_hint(F.col("query")), qf.report_year(F.col("query")))
    key = cache.storage_key(F.lit("chat"), F.col("query"), F.lit(_CONFIG), F.lit("v1"), F.lit(_GENERATION), meta)
    keyed = rows.select("row_id", "query_type", "refused", "created_at", key.alias("storage_key"))
    entries = keyed.where(cache.may_store(F.col("query_type"), F.col("refused"))).withColumn("ttl_s", cache.ttl(F.lit("chat"), F.col("refused"), F.col("query_type"))).withColumnRenamed("row_id", "entry_id")
    return keyed.withColumnRenamed("row_id", "request_id"), entries


_NOW = "2026-06-30 12:00:00"


def cache_key(spark: SparkSession, folder: str) -> DataFrame:
    return _entries(spark, folder)[0].select("request_id", "storage_key")


def cache_ttl(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)[1]
    old = cache.expired(F.col("created_at"), F.col("ttl_s"), F.lit(_NOW).cast("timestamp_ntz"))
    return entries.groupBy("query_type", "ttl_s").agg(F.count("*").alias("n"), F.count_if(old).alias("n_expired"))


def cache_l1_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every question looked up among the entries that never expire but by 400 days."""
    requests, entries = _entries(spark, folder)
    found = cache.exact_lookup(requests.select("request_id", "storage_key"), entries.withColumn("ttl_s", F.lit(34_560_000)), F.lit(_NOW).cast("timestamp_ntz"))
    return found.select("request_id", "entry_id")


def cache_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Every question looked up in both levels among the stored answers of questions, by key, then by similar vectors of its kind.

    Stored vectors stand for questions; every fifth entry was made by another index, every seventh by another model,
    and entries whose first chunk is not known any more are not served.
    """
    rows = questions(spark, folder)
    vector = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    number = F.col("row_id")
    meta = cache.metadata_fingerprint(F.col("stock_code"), F.col("query_type"))
    made = rows.join(vector, "row_id", "left").select(
        "row_id", "query", "stock_code", "query_type", "refused", "created_at", "vector", meta.alias("metadata"), F.col("doc_id"), F.array_compact(F.array("top1_chunk_id")).alias("chunk_ids"), F.lit("").alias("company_name"), F.lit("chat").alias("scope"),
        qf.report_year(F.col("query")).alias("report_year"), F.lit("v1").alias("doc_version"), F.lit(_CONFIG).alias("config_fingerprint"), F.md5(F.concat_ws("|", F.trim("query"), meta)).alias("storage_key"), F.md5(meta).alias("bucket"),
    )
    requests = made.withColumns({"index_fingerprint": F.lit("v1"), "generation_fingerprint": F.lit(_GENERATION)}).withColumnRenamed("row_id", "request_id")
    entries = made.where(cache.may_store(F.col("query_type"), F.col("refused")) & (number % 3 == 0)).withColumns({
        "index_fingerprint": F.when(number % 5 == 0, "v0").otherwise("v1"), "generation_fingerprint": F.when(number % 7 == 0, "other").otherwise(_GENERATION), "ttl_s": F.lit(34_560_000),
    }).withColumnRenamed("row_id", "entry_id")
    requests = requests.withColumn("doc_id", F.lit(""))
    return cache.two_level_lookup(requests, entries, F.lit(_NOW).cast("timestamp_ntz"), hits(spark, folder).select("chunk_id"))


def cache_l2_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Stated vectors looked up among all vectors of their label as bucket, at a threshold that random vectors reach."""
    vectors = table(spark, folder, "embeddings")
    entries = vectors.where(F.col("vec_id") % EVERY != 0).select(F.col("vec_id").alias("entry_id"), F.col("label").alias("bucket"), F.col("embedding").alias("vector"), F.lit("2026-06-30 00:00:00").cast("timestamp_ntz").alias("created_at"), F.lit(86_400).alias("ttl_s"))
    requests = vectors.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("request_id"), F.col("label").alias("bucket"), F.col("embedding").alias("vector"))
    return cache.similar_lookup(requests, entries, F.lit(_NOW).cast("timestamp_ntz"), 0.1)


def cache_stats(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    rows = events.select((F.col("event_type") != "error").alias("hit"), F.when(F.col("event_type") == "click", "L1").when(F.col("event_type") == "view", "L2").otherwise("-").alias("layer"), F.col("value").alias("latency_ms"), F.col("event_type").isin("error", "signup").alias("llm_called"))
    return cache.statistics(rows)


def cache_invalidate(spark: SparkSession, folder: str) -> DataFrame:
    """Entries left when the documents of one industry have changed."""
    rows = questions(spark, folder).select(F.col("row_id").alias("entry_id"), F.array("doc_id").alias("entry_docs"), "query_type")
    changed = manifest(spark, folder).where("industry_label = '电力'").select("doc_id")
    return cache.invalidate(rows, doc_ids=changed).groupBy("query_type").agg(F.count("*").alias("n"))


QUERIES = [
    rerank_topk, comparative_quota, distinct_sources_topk, evidence_intents, evidence_select, evidence_gate, refusal_breakdown, refusal_messages, citations, passages, extractive_answers,
    recall_mrr_by_route, relevance, metrics_grouping_sets, context_precision, weight_sweep, citation_accuracy, refusal_accuracy, answer_support, answer_bodies, gold_candidates, missing_gold_anti,
    normalize_query, cache_key, cache_ttl, cache_l1_lookup, cache_flow, cache_l2_lookup, cache_stats, cache_invalidate,
]

_E = "eval_generation_detail"
_PASSAGE = "trim(concat_ws(chr(10), nullif(coalesce(company_name, ''), ''), nullif(coalesce(section_title, ''), ''), nullif(coalesce(text, ''), '')), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8199) || chr(8201) || chr(8239) || chr(12288))"
_CUT = f"CASE WHEN length({_PASSAGE}) > 1200 THEN substring({_PASSAGE}, 1, 1200) || '…' ELSE {_PASSAGE} END"


def _intent(query: str, kind: str) -> str:
    forced = {"core_view": "summary", "financial_metric": "comparative"}
    cases = ", ".join(f"CASE WHEN {_has(query, r[0])}" + (f" OR {kind} = '{forced[n]}'" if n in forced else "") + f" THEN '{n}' END" for n, r in evidence.INTENTS.items())
    return f"coalesce(nullif(concat_ws(',', {cases}), ''), 'core_view')"


def _selected(intents: str, section: str, text: str, kind: str) -> str:
    parts = ["score_rerank"]
    for n, (_, good, bad, up, down) in evidence.INTENTS.items():
        has = f"contains({intents}, '{n}')"
        parts.append(f"CASE WHEN {has} AND ({_has(section, good)} OR {_has(f'substring({text}, 1, 200)', good)}) THEN {up} ELSE 0 END")
        parts.append(f"CASE WHEN {has} AND {_has(section, bad)} THEN -{down} ELSE 0 END")
    legend = _has(section, ("评级说明",))
    parts.append(f"CASE WHEN contains({intents}, 'risk') AND {_has(section, ('评级说明', '投资评级摘要'))} THEN -0.25 ELSE 0 END")
    parts.append(f"CASE WHEN NOT contains({intents}, 'rating') AND {legend} THEN -0.12 ELSE 0 END")
    parts.append(f"CASE WHEN NOT contains({intents}, 'financial_metric') AND {_has(section, evidence.GENERIC_SECTIONS)} THEN -0.08 ELSE 0 END")
    parts.append(f"CASE WHEN contains({intents}, 'actual_period') AND regexp_matches({section} || substring({text}, 1, 120), '202[6-9]E') THEN -0.06 ELSE 0 END")
    return "round(" + " + ".join(parts) + ", 6)"


_GATED = f"""{HITS}, {MANIFEST}, h0 AS (SELECT * EXCLUDE (company_name, text, doc_id, page_start, display_name), company_name AS company, CASE WHEN query_id % 13 <> 0 THEN company_name END AS company_name, CASE WHEN query_id % 13 <> 0 THEN text END AS text,
        doc_id, CASE WHEN query_id % 11 <> 0 THEN doc_id END AS doc, CASE WHEN query_id % 11 <> 0 THEN page_start END AS page, CASE WHEN query_id % 11 <> 0 THEN display_name END AS display FROM hits WHERE stage = 'rerank'),
    r AS (SELECT h0.*, trim(coalesce(stock_code, '')) AS code_hit, {_CUT} AS passage, coalesce(section_title, '') AS section FROM h0 LEFT JOIN (SELECT doc_id, stock_code FROM manifest) USING (doc_id)),
    one AS (SELECT query_id, min(concat_ws(' ', coalesce(company, ''), section)) AS query FROM r WHERE rank = 1 GROUP BY query_id), two AS (SELECT query_id, min(company) AS other FROM r WHERE rank = 2 GROUP BY query_id),
    q AS (SELECT query_id, coalesce(query, '') AS query, CASE query_id % 3 WHEN 0 THEN 'comparative' WHEN 1 THEN 'factual' ELSE 'summary' END AS query_type, CASE WHEN query_id % 7 = 0 THEN coalesce((SELECT min(stock_code) FROM manifest WHERE stock_code <> ''), '') ELSE '' END AS code,
        CASE WHEN query_id % 3 = 0 AND coalesce(other, '') <> '' THEN [split_part(query, ' ', 1), other] ELSE [] END AS names FROM (SELECT DISTINCT id AS query_id FROM rag_requests) LEFT JOIN one USING (query_id) LEFT JOIN two USING (query_id)),
    i AS (SELECT *, {_intent('query', 'query_type')} AS intents FROM q),
    s AS (SELECT r.*, i.query, i.query_type, i.intents, i.names, i.code, concat_ws(' ', coalesce(company, ''), coalesce(display, ''), passage) AS blob, {_selected('i.intents', 'section', 'passage', 'i.query_type')} AS score_selected FROM r JOIN i USING (query_id)),
    best AS (SELECT * FROM (SELECT query_id, section, score_rerank, score_selected, row_number() OVER (PARTITION BY query_id ORDER BY score_selected DESC NULLS LAST, rank) AS b FROM s WHERE rank <= 10) WHERE b = 1),
    per AS (SELECT query_id, count(chunk_id) AS n_hits, max(coalesce(score_rerank, score)) FILTER (rank = 1) AS top_score, max(length(passage)) FILTER (rank = 1) AS top_chars, bool_or(coalesce(page, 0) > 0 OR coalesce(trim(display), '') <> '' OR coalesce(trim(doc), '') <> '') FILTER (rank = 1) AS anchored,
        bool_or((code_hit <> '' AND (contains(code, code_hit) OR contains(code_hit, code))) OR contains(blob, code)) FILTER (rank <= 3) AS code_found, count(DISTINCT trim(company)) FILTER (rank <= 5 AND trim(company) <> '') AS companies FROM s GROUP BY query_id),
    gate AS (SELECT query_id, coalesce(n_hits, 0) AS n_hits, round(coalesce(top_score, 0), 6) AS top_score, CASE WHEN coalesce(n_hits, 0) = 0 THEN 'no_hits' WHEN coalesce(top_score, 0) < 0.35 THEN 'low_rerank_score' WHEN coalesce(top_chars, 0) < 40 THEN 'insufficient_passage'
        WHEN NOT coalesce(anchored, false) THEN 'missing_source_page' WHEN code <> '' AND NOT coalesce(code_found, false) THEN 'stock_mismatch'
        WHEN (query_type = 'comparative' OR len(names) >= 2 OR {_has('query', evidence.COMPARE_HINTS)} OR regexp_matches(query, '{evidence.COMPARE_MANY}')) AND companies < 2 THEN 'comparative_insufficient'
        WHEN {' OR '.join(f"contains(intents, '{n}') AND {_has('section', s)}" for n, s in evidence.BLOCKED_SECTIONS.items())} OR score_selected < round(score_rerank - 0.18, 6) THEN 'weak_evidence_intent' ELSE '' END AS reason FROM i LEFT JOIN per USING (query_id) LEFT JOIN best USING (query_id))"""

_GRADED = f"""{HITS}, {MANIFEST}, {BEST}, h AS (SELECT best.*, trim(coalesce(stock_code, '')) AS code, trim(coalesce(rating, '')) AS rated, array_to_string(list_filter([section_title, best.text, display_name, best.company_name, report_title, broker, rating], lambda x: x <> ''), chr(10)) AS blob
        FROM best LEFT JOIN (SELECT doc_id, stock_code, report_title, broker, rating FROM manifest) USING (doc_id)),
    e AS (SELECT row_id, query_type, category, doc_id, coalesce(answer, '') AS answer, coalesce(refused, false) AS refused, citation_count, top1_chunk_id, trim(coalesce(stock_code, '')) AS want, list_slice(list_distinct_in_order, 1, 3) AS tokens
        FROM (SELECT *, list_reduce(list_prepend([], list_transform(regexp_extract_all(coalesce(gold_answer, ''), '[0-9]+(?:\\.[0-9]+)?%?'), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END) AS list_distinct_in_order FROM {_E})),
    j AS (SELECT e.*, h.* EXCLUDE (doc_id), code = (SELECT max(stock_code) FROM companies) AS never, (want = '' OR code = want) AS stock_ok, (len(tokens) = 0 OR len(list_filter(tokens, lambda t: contains(blob, t) OR contains(regexp_replace(blob, '[^0-9.]', '', 'g'), regexp_replace(t, '[^0-9.]', '', 'g')))) > 0) AS token_ok,
        {_has('rated', metrics.RATED)} OR (CASE WHEN len(tokens) > 0 THEN len(list_filter(tokens, lambda t: contains(rated, t) OR contains(regexp_replace(rated, '[^0-9.]', '', 'g'), regexp_replace(t, '[^0-9.]', '', 'g')))) > 0 ELSE {_has('rated', ('评级', '投资评级', '买入', '增持', '推荐', '优于大市'))} END) AS rating_ok FROM e JOIN h ON e.doc_id = h.doc_id),
    rel AS (SELECT *, CASE WHEN never THEN false WHEN chunk_id = top1_chunk_id THEN true WHEN token_ok THEN true ELSE coalesce(category = 'rating' AND stock_ok AND rating_ok, false) END AS relevant FROM j)"""

_ROUTES = f"""{HITS}, want AS (SELECT query_id, min(company_name) AS want FROM hits WHERE stage = 'rerank' AND rank = 1 GROUP BY query_id),
    rel AS (SELECT query_id, stage AS route, rank, coalesce(company_name = want, false) AS relevant FROM hits JOIN want USING (query_id)),
    per AS (SELECT route, CASE query_id % 3 WHEN 0 THEN 'comparative' WHEN 1 THEN 'factual' ELSE 'summary' END AS query_type, min(rank) FILTER (relevant) AS first, count(*) FILTER (relevant AND rank <= 5) AS n5, count(*) FILTER (relevant AND rank <= 10) AS n10 FROM rel GROUP BY route, query_id)"""
_MEANS = ", ".join([f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_at_{k}" for k in (3, 5, 10)] + ["round(avg(n5 / 5), 6) AS precision_at_5", "round(avg(n10 / 10), 6) AS precision_at_10", "round(avg(coalesce(1 / first, 0)), 6) AS mrr"])

_LABEL = "CASE refusal_reason " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in evidence.REFUSALS.items()) + " ELSE '证据不足' END"

SQL = {
    "refusal_messages": f"""SELECT row_id, CASE WHEN refusal_reason = '' THEN '' WHEN refusal_reason = 'low_rerank_score' THEN '我不确定：' || {_LABEL} || '（Top-1 rerank=' || printf('%.3f', top_rerank_score) || '，阈值=0.35），无法基于当前检索结果可靠回答。' WHEN refusal_reason = 'no_hits' THEN '我不确定：' || {_LABEL} || '，无法回答该问题。'
        WHEN refusal_reason = 'missing_source_page' THEN '我不确定：' || {_LABEL} || '，无法生成带页码引用的答案。' WHEN refusal_reason = 'comparative_insufficient' THEN '我不确定：' || {_LABEL} || '（需至少 2 个主体，当前仅 0 个），无法完成对比回答。'
        WHEN refusal_reason = 'stock_mismatch' THEN '我不确定：检索证据未覆盖指定股票（），无法可靠回答。' ELSE '我不确定：' || {_LABEL} || '，无法基于当前检索结果可靠回答。' END AS message FROM {_E} WHERE refusal_reason IS NOT NULL""",
    "answer_bodies": f"WITH b AS (SELECT row_id, regexp_replace(regexp_replace(split_part(coalesce(answer, ''), chr(10) || '参考来源', 1), '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '') AS t FROM {_E}) SELECT row_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM b",
    "comparative_quota": f"""WITH {HITS}, best AS (SELECT query_id, chunk_id, max(score_rerank) AS score, min(company_name) AS company FROM hits WHERE stage = 'rerank' GROUP BY query_id, chunk_id), names AS (SELECT query_id, rank AS pos, min(company_name) AS entity FROM hits WHERE stage = 'rerank' AND rank <= 2 AND company_name IS NOT NULL GROUP BY query_id, rank),
        two AS (SELECT query_id FROM names GROUP BY query_id HAVING count(DISTINCT entity) = 2), n AS (SELECT * FROM names WHERE query_id IN (SELECT query_id FROM two)),
        p AS (SELECT b.*, pos, (trim(coalesce(company, '')) <> '' AND trim(entity) <> '' AND (contains(trim(company), trim(entity)) OR contains(trim(entity), trim(company)))) AS own FROM best b JOIN n USING (query_id)), a AS (SELECT *, bool_or(coalesce(own, false)) OVER (PARTITION BY query_id, pos) AS any_own FROM p),
        f AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY score DESC NULLS LAST, chunk_id) AS place FROM a WHERE coalesce(own, false) OR NOT any_own), g AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS seen FROM f WHERE place <= 2), s AS (SELECT query_id, chunk_id, pos, place FROM g WHERE seen = 1),
        r AS (SELECT query_id, chunk_id, 9 AS pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS place FROM best b WHERE query_id IN (SELECT query_id FROM two) AND NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = b.query_id AND s.chunk_id = b.chunk_id))
        SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, place, chunk_id) AS rank FROM (SELECT * FROM s UNION ALL SELECT * FROM r)) WHERE rank <= 5""",
    "rerank_topk": f"""WITH {HITS}, f AS (SELECT query_id, min(coalesce(section_title, '')) AS query FROM hits WHERE stage = 'rerank' AND rank = 1 GROUP BY query_id),
        t AS (SELECT h.query_id, h.chunk_id, list_distinct({TOKENS.format('f.query')}) AS a, {TOKENS.format('h.text')} AS b FROM hits h JOIN f ON f.query_id = h.query_id WHERE stage = 'rerank'),
        s AS (SELECT query_id, chunk_id, round(max(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END), 6) AS score_rerank FROM t GROUP BY query_id, chunk_id)
        SELECT query_id, chunk_id, CAST(score_rerank AS DOUBLE) AS score_rerank, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_rerank DESC, chunk_id) AS rank FROM s) WHERE rank <= 3""",
    "distinct_sources_topk": f"WITH {HITS} SELECT query_id, stage, count(DISTINCT trim(company_name)) AS companies FROM hits WHERE rank <= 5 AND trim(company_name) <> '' GROUP BY query_id, stage",
    "evidence_intents": f"SELECT row_id, {_intent('query', 'query_type')} AS intents FROM {_E}",
    "evidence_select": f"""WITH {_GATED}, p AS (SELECT *, CASE WHEN key = '' THEN 'unknown' ELSE key END AS k FROM (SELECT *, substring(regexp_replace(trim(section), '^表[0-9]+\\s*', ''), 1, 40) AS key, row_number() OVER (PARTITION BY query_id ORDER BY score_selected DESC NULLS LAST, rank) AS by_score FROM s WHERE rank <= 10)),
        a AS (SELECT *, min(by_score) FILTER (len(names) >= 2 AND length(trim(names[1])) >= 2 AND contains(blob, trim(names[1]))) OVER (PARTITION BY query_id) AS first FROM p),
        b AS (SELECT *, min(by_score) FILTER (len(names) >= 2 AND length(trim(names[2])) >= 2 AND contains(blob, trim(names[2])) AND by_score IS DISTINCT FROM first) OVER (PARTITION BY query_id) AS second FROM a),
        c AS (SELECT *, CASE WHEN by_score = first THEN 0 WHEN by_score = second THEN 1 END AS cover FROM b),
        t AS (SELECT *, CASE WHEN cover IS NOT NULL THEN -1 WHEN row_number() OVER (PARTITION BY query_id, k ORDER BY cover NULLS LAST, by_score) <= 2 THEN 0 ELSE 1 END AS tier FROM c)
        SELECT query_id, hit_id, score_selected, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, cover NULLS LAST, by_score) AS place FROM t) WHERE place <= 3""",
    "relevance": f"WITH {_GRADED} SELECT query_type, category, count(*) AS n, count(*) FILTER (relevant) AS n_relevant FROM rel GROUP BY query_type, category",
    "evidence_gate": f"WITH {_GATED} SELECT query_id, n_hits, top_score, reason, reason = '' AS passed FROM gate",
    "refusal_breakdown": f"WITH {_GATED} SELECT reason, count(*) AS n, round(avg(top_score), 6) AS mean_top_score FROM gate GROUP BY reason",
    "citations": f"""WITH {HITS} SELECT query_id, rank AS idx, chunk_id, '[' || rank || '] ' || concat_ws('，', coalesce(nullif(trim(display_name), ''), nullif(trim(company_name), ''), nullif(trim(doc_id), ''), ''),
        CASE WHEN coalesce(page_start, 0) <= 0 THEN NULL WHEN coalesce(page_end, 0) > page_start THEN '第' || page_start || '-' || page_end || '页' ELSE '第' || page_start || '页' END) AS line FROM hits WHERE stage = 'rerank' AND rank <= 3""",
    "passages": f"WITH {HITS}, p AS (SELECT hit_id, {_CUT} AS t FROM hits) SELECT hit_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM p",
    "recall_mrr_by_route": f"""WITH {SCORED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10),
        rel AS (SELECT query_id, rank FROM top JOIN documents d ON d.doc_id = chunk_id JOIN {_E} e ON e.row_id = query_id WHERE coalesce(trim(e.stock_code), '') = '' OR trim(coalesce(d.stock_code, '')) = trim(e.stock_code)),
        f AS (SELECT query_id, min(rank) AS first, count(*) FILTER (rank <= 5) AS n5, count(*) AS n10 FROM rel GROUP BY query_id)
        SELECT row_id AS query_id, query_type, CAST(first AS INTEGER) AS first, CAST(CASE WHEN first <= 3 THEN 1 ELSE 0 END AS DOUBLE) AS recall_at_3, CAST(CASE WHEN first <= 5 THEN 1 ELSE 0 END AS DOUBLE) AS recall_at_5, CAST(CASE WHEN first <= 10 THEN 1 ELSE 0 END AS DOUBLE) AS recall_at_10,
        coalesce(n5, 0) / 5 AS precision_at_5, coalesce(n10, 0) / 10 AS precision_at_10, coalesce(1 / first, 0) AS mrr FROM {_E} LEFT JOIN f ON row_id = query_id WHERE row_id % {EVERY} = 0""",
    "metrics_grouping_sets": f"WITH {_ROUTES} SELECT route, query_type, CAST(grouping(query_type) AS TINYINT) AS level, count(*) AS n, {_MEANS} FROM per GROUP BY GROUPING SETS ((route), (route, query_type))",
    "context_precision": f"WITH {_ROUTES} SELECT route, round(avg(n5 / 5), 6) AS p5, round(avg(n10 / 10), 6) AS p10 FROM per GROUP BY route",
    "weight_sweep": f"""WITH {HITS}, p AS (SELECT query_id, chunk_id, max(score_vector) AS v, max(score_bm25) AS b, min(rank) AS r FROM hits WHERE stage = 'rerank' GROUP BY query_id, chunk_id),
        n AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN max(v) OVER q <= min(v) OVER q THEN 1 ELSE (v - min(v) OVER q) / (max(v) OVER q - min(v) OVER q) END AS nv, CASE WHEN b IS NULL THEN NULL WHEN max(b) OVER q <= min(b) OVER q THEN 1 ELSE (b - min(b) OVER q) / (max(b) OVER q - min(b) OVER q) END AS nb FROM p WINDOW q AS (PARTITION BY query_id)),
        w AS (SELECT *, round(weight * coalesce(nv, 0) + (1 - weight) * coalesce(nb, 0), 6) AS score FROM n, (SELECT unnest([0.3::DOUBLE, 0.35, 0.4, 0.5, 0.6, 0.7]) AS weight)),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id, weight ORDER BY score DESC, chunk_id) AS rank FROM w)
        SELECT weight, count(*) AS n, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3, round(avg(1 / rank), 6) AS mrr FROM t WHERE r = 1 GROUP BY weight""",
    "citation_accuracy": f"""WITH {_GRADED}, c AS (SELECT *, coalesce(nullif(trim(coalesce(display_name, '')), ''), nullif(trim(coalesce(company_name, '')), ''), trim(coalesce(doc_id, ''))) AS source, coalesce(page_start, 0) AS page FROM rel WHERE rank <= citation_count),
        k AS (SELECT row_id, count(*) AS n, bool_and(page > 0) AS paged, bool_and(source <> '') AS sourced, bool_or(relevant OR chunk_id = top1_chunk_id) AS fits, bool_or((want <> '' AND code <> '' AND code <> want) OR never) AS apart, bool_or((page > 0 AND contains(answer, CAST(page AS VARCHAR))) OR (source <> '' AND contains(answer, substring(source, 1, 8)))) AS named FROM c GROUP BY row_id),
        a AS (SELECT e.*, coalesce(n, 0) > 0 AS has, coalesce(paged, false) AS paged, coalesce(sourced, false) AS sourced, coalesce(fits, false) AS fits, NOT coalesce(apart, false) AS aligned, len(tokens) = 0 OR len(list_filter(tokens, lambda t: contains(answer, t) OR contains(regexp_replace(answer, '[^0-9.]', '', 'g'), regexp_replace(t, '[^0-9.]', '', 'g')))) > 0 AS told,
            coalesce(n, 0) > 0 AND (regexp_matches(answer, '\\[\\d+\\]') OR contains(answer, '参考文献') OR coalesce(named, false)) AS refs FROM e LEFT JOIN k USING (row_id))
        SELECT query_type, NOT refused AS applicable, count(*) AS n, round(avg(CASE WHEN refused THEN CASE WHEN has THEN 0.0 ELSE 1.0 END ELSE (has::INT + paged::INT + sourced::INT + fits::INT + told::INT + aligned::INT + refs::INT) / 7 END), 6) AS accuracy, count(*) FILTER (has) AS n_has_citations, count(*) FILTER (refused OR paged) AS n_pages_present,
            count(*) FILTER (refused OR sourced) AS n_sources_present, count(*) FILTER (refused OR fits) AS n_cited_chunk_relevant, count(*) FILTER (refused OR told) AS n_must_tokens_in_answer, count(*) FILTER (refused OR aligned) AS n_doc_stock_aligned, count(*) FILTER (refused OR refs) AS n_refs_in_answer FROM a GROUP BY query_type, refused""",
    "refusal_accuracy": f"SELECT strategy, count(*) AS n, count(*) FILTER (refused) AS n_refused, round(avg(CASE WHEN refused = (top_rerank_score < 0.35) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {_E} WHERE refused IS NOT NULL AND top_rerank_score IS NOT NULL GROUP BY strategy",
    "answer_support": f"""WITH g AS (SELECT query_type, strategy, coalesce(answer, '') AS a, coalesce(refused, false) AS refused, list_distinct(regexp_extract_all(coalesce(gold_answer, ''), '[\\d.]+%?|[A-Za-z]{{2,}}|[一-鿿]{{2,}}')) AS t FROM {_E})
        SELECT query_type, strategy, count(*) AS n, count(*) FILTER (NOT refused AND CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: contains(a, x))) >= least(2, len(t)) ELSE length(a) > 40 END) AS n_supported FROM g GROUP BY query_type, strategy""",
    "gold_candidates": f"""WITH {HITS}, w AS (SELECT row_id AS query_id, doc_id, unnest(list_distinct({TOKENS.format('gold_answer')})) AS token FROM {_E}),
        h AS (SELECT doc_id, chunk_id, unnest(list_distinct({TOKENS.format('text')})) AS token FROM (SELECT DISTINCT ON (chunk_id) * FROM hits)),
        c AS (SELECT query_id, chunk_id, count(*) AS score FROM w JOIN h USING (doc_id, token) GROUP BY query_id, chunk_id)
        SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM c) WHERE rank <= 3""",
    "missing_gold_anti": f"SELECT row_id, top1_chunk_id FROM {_E} WHERE top1_chunk_id IS NOT NULL AND top1_chunk_id NOT IN (SELECT chunk_id FROM retrieved_chunks WHERE chunk_id IS NOT NULL)",
    "cache_ttl": f"""WITH e AS (SELECT query_type, created_at, CASE WHEN coalesce(refused, false) THEN 900 WHEN query_type = 'summary' THEN 14400 ELSE 43200 END AS ttl_s FROM {_E} WHERE query_type IS DISTINCT FROM 'comparative')
        SELECT query_type, ttl_s, count(*) AS n, count(*) FILTER (coalesce(TIMESTAMP '{_NOW}' >= created_at + to_seconds(ttl_s), true)) AS n_expired FROM e GROUP BY query_type, ttl_s""",
    "cache_flow": f"""WITH m AS (SELECT row_id, query_type, trim(coalesce(stock_code, '')) AS stock, stock_code, coalesce(refused, false) AS refused, created_at, embedding, top1_chunk_id, coalesce(list_filter(regexp_extract_all(coalesce(query, ''), '[0-9]+'), lambda x: length(x) = 4 AND x LIKE '20%')[-1], '') AS year, trim(query) AS asked,
            'stock=' || coalesce(nullif(trim(coalesce(stock_code, '')), ''), '-') || '|qtype=' || coalesce(nullif(trim(coalesce(query_type, '')), ''), 'factual') || '|co=-|yr=-|doc=-|ver=-' AS meta FROM {_E} LEFT JOIN embeddings ON vec_id = row_id),
        k AS (SELECT *, concat_ws('|', asked, meta) AS key FROM m), known AS (SELECT DISTINCT chunk_id FROM retrieved_chunks WHERE chunk_id IS NOT NULL),
        e AS (SELECT * FROM k WHERE row_id % 3 = 0 AND query_type IS DISTINCT FROM 'comparative' AND created_at + to_seconds(34560000) > TIMESTAMP '{_NOW}'), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, row_id DESC) AS n FROM e) WHERE n = 1),
        c AS (SELECT r.row_id AS request_id, f.row_id AS entry_id, 'L1' AS layer, 0 AS place, 1.0 AS similarity, true AS exact, r, f AS e FROM k r JOIN f ON r.key = f.key),
        x AS (SELECT *, CASE WHEN r.stock <> '' AND e.stock_code IS DISTINCT FROM r.stock_code THEN 'stock_code_mismatch' WHEN e.query_type IS DISTINCT FROM r.query_type THEN 'query_type_mismatch' WHEN r.year <> '' AND e.year <> r.year THEN 'report_year_mismatch' WHEN entry_id % 5 = 0 THEN 'index_fingerprint_mismatch'
            WHEN entry_id % 7 = 0 THEN 'generation_fingerprint_mismatch' WHEN e.top1_chunk_id IS NOT NULL AND e.top1_chunk_id NOT IN (SELECT chunk_id FROM known) THEN 'chunk_missing' ELSE '' END AS reason FROM c),
        s AS (SELECT r.row_id AS request_id, e.row_id AS entry_id, round(list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity, r, e FROM k r JOIN e ON r.meta = e.meta WHERE r.row_id NOT IN (SELECT request_id FROM x WHERE reason = '')),
        t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC NULLS LAST, entry_id) AS place FROM s) WHERE place <= 5 AND similarity IS NOT NULL),
        y AS (SELECT request_id, entry_id, 'L2' AS layer, place, similarity, CASE WHEN r.stock <> '' AND e.stock_code IS DISTINCT FROM r.stock_code THEN 'stock_code_mismatch' WHEN e.query_type IS DISTINCT FROM r.query_type THEN 'query_type_mismatch' WHEN r.year <> '' AND e.year <> r.year THEN 'report_year_mismatch' WHEN entry_id % 5 = 0 THEN 'index_fingerprint_mismatch'
            WHEN entry_id % 7 = 0 THEN 'generation_fingerprint_mismatch' WHEN similarity < 0.88 THEN 'similarity_below_threshold' WHEN e.top1_chunk_id IS NOT NULL AND e.top1_chunk_id NOT IN (SELECT chunk_id FROM known) THEN 'chunk_missing' ELSE '' END AS reason FROM t),
        z AS (SELECT request_id, entry_id, layer, place, similarity, reason FROM x UNION ALL SELECT request_id, entry_id, layer, place, similarity, reason FROM y), o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY layer, place) AS n FROM z),
        b AS (SELECT request_id, arg_min(layer, n) FILTER (reason = '') AS layer, arg_min(entry_id, n) FILTER (reason = '') AS entry_id, arg_min(similarity, n) FILTER (reason = '') AS similarity, arg_min(reason, n) AS reason FROM o GROUP BY request_id)
        SELECT row_id AS request_id, coalesce(layer, 'miss') AS layer, entry_id, CAST(coalesce(similarity, 0) AS DOUBLE) AS similarity, CASE WHEN layer IS NOT NULL THEN '' ELSE coalesce(reason, '') END AS reason FROM k LEFT JOIN b ON request_id = row_id""",
    "cache_l2_lookup": f"""WITH p AS (SELECT q.vec_id AS request_id, e.vec_id AS entry_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % {EVERY} = 0 AND e.vec_id % {EVERY} <> 0)
        SELECT request_id, entry_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, entry_id) AS place FROM p) WHERE place = 1 AND similarity >= 0.1""",
    "cache_stats": """SELECT count(*) AS n_requests, count(*) FILTER (event_type <> 'error') AS n_hits, count(*) FILTER (event_type = 'click') AS n_l1, count(*) FILTER (event_type = 'view') AS n_l2, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS hit_rate,
        round(sum(value) FILTER (event_type <> 'error') / count(*) FILTER (event_type <> 'error'), 6) AS avg_hit_ms, round(sum(value) FILTER (event_type = 'error') / count(*) FILTER (event_type = 'error'), 6) AS avg_miss_ms, round(count(*) FILTER (event_type NOT IN ('error', 'signup')) / count(*), 6) AS llm_reduction FROM events""",
    "cache_invalidate": f"WITH {MANIFEST} SELECT query_type, count(*) AS n FROM {_E} WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM manifest WHERE industry_label = '电力') GROUP BY query_type",
}
