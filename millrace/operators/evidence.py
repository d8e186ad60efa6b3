"""Reranking, choice and gating of evidence, citations and refusals, for many queries in one plan.

Hits are rows (query_id, chunk_id, rank, score_rerank, company_name, section_title, text, ...). A query
without hits appears only where queries are given as a table of their own. Null strings are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import any_contained, stripped, text_or_empty

# Passage length, thresholds and sizes of the gate and of the choice.
PASSAGE_CHARS = 1200
REFUSAL_THRESHOLD = 0.35
MIN_PASSAGE = 40
POOL, PER_SECTION = 10, 2
MISMATCH_DROP = 0.18
# Intents, the words of a question that show them, the sections they favour and disfavour, and by how much.
INTENTS = {
    "risk": (("风险", "风险提示", "风险因素"), ("风险因素", "风险提示", "核心风险提示", "主要风险"), ("评级说明", "投资评级摘要", "可比公司", "分析师介绍", "免责声明"), 0.18, 0.22),
    "rating": (("评级", "投资评级", "买入", "增持", "推荐", "优于大市", "中性", "卖出"), ("投资评级摘要", "投资评级", "评级"), ("评级说明", "可比公司", "免责声明"), 0.20, 0.18),
    "financial_metric": (
        ("EPS", "PE", "市盈率", "每股收益", "净利润", "归母", "营收", "收入", "毛利率", "预测", "估值", "盈利"),
        ("盈利预测", "利润表", "三大报表", "附录", "财务", "估值", "PE", "EPS"),
        ("评级说明", "可比公司", "投资要点", "事件点评"), 0.12, 0.10,
    ),
    "core_view": (
        ("核心观点", "投资要点", "看好", "逻辑", "催化剂", "推荐理由", "观点", "摘要"),
        ("投资要点", "核心观点", "报告导读", "事件点评", "摘要", "投资评级摘要"),
        ("评级说明", "可比公司", "附录", "三大报表"), 0.15, 0.12,
    ),
    "actual_period": (
        ("上半年", "H1", "全年", "实际", "2024年", "2025年", "已实现", "业绩"),
        ("核心观点", "事件点评", "业绩", "经营", "财务分析"),
        ("2026E", "2027E", "2028E", "盈利预测", "三大报表预测"), 0.10, 0.08,
    ),
}
GENERIC_SECTIONS = ("评级说明", "分析师介绍", "免责声明", "研究所", "可比公司")
BLOCKED_SECTIONS = {
    "risk": ("评级说明", "投资评级摘要", "可比公司", "分析师介绍"),
    "financial_metric": ("评级说明", "投资要点", "事件点评"),
    "core_view": ("评级说明", "可比公司"),
}
COMPARE_HINTS = ("谁更高", "谁更低", "对比", "比较", "vs", "VS", "孰高", "孰低")
COMPARE_MANY = "和.+?[,，、].+?谁"
# Codes of refusal and what they say.
REFUSALS = {
    "no_hits": "未检索到相关研报片段",
    "low_rerank_score": "检索证据置信度过低",
    "insufficient_passage": "证据正文过短或为空",
    "missing_source_page": "证据缺少可溯源的文档或页码",
    "stock_mismatch": "证据与指定股票代码不匹配",
    "comparative_insufficient": "对比问题缺少多主体证据",
    "weak_evidence_intent": "检索片段与问题意图不匹配",
}


def passage(company: Column, section: Column, body: Column) -> Column:
    """Company, section and body on lines of their own, cut at ``PASSAGE_CHARS`` with an ellipsis."""
    parts = F.filter(F.array(*map(text_or_empty, (company, section, body))), lambda x: x != "")
    text = stripped(F.array_join(parts, "\n"))
    return F.when(F.length(text) > PASSAGE_CHARS, F.concat(F.substring(text, 1, PASSAGE_CHARS), F.lit("…"))).otherwise(text)


def lexical_overlap(query_tokens: Column, passage_tokens: Column) -> Column:
    """The share of a query's distinct tokens that a passage has; a deterministic stand-in for a model's score."""
    asked = F.array_distinct(query_tokens)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, passage_tokens)), F.size(asked)), F.lit(0.0))


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """``hits`` with ``score_rerank`` and ``rank`` by it, ties by chunk id, the top ``k`` of each query."""
    scored = hits.drop("rank").withColumn("score_rerank", F.round(score, 6))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score_rerank"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def same_company(company: Column, name: Column) -> Column:
    """Whether one of two names contains the other; empty names match nothing."""
    a, b = stripped(text_or_empty(company)), stripped(text_or_empty(name))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def comparative_quota(hits: DataFrame, entities: DataFrame, k: int = 5) -> DataFrame:
    """The top ``k`` of each query with places for each compared name, in the order of the names.

    ``entities``: (query_id, pos, entity). Each name gets max(2, k / names) of its company's best hits, or
    of all hits if its company has none; what is then free goes to the best of the rest.
    """
    counted = entities.groupBy("query_id").agg(F.count("*").alias("names"))
    pairs = hits.join(entities, "query_id").join(counted, "query_id").withColumn("own", same_company(F.col("company_name"), F.col("entity")))
    per_name = Window.partitionBy("query_id", "pos")
    pairs = pairs.withColumn("any_own", F.max("own").over(per_name)).where(F.col("own") | ~F.col("any_own"))
    place = F.row_number().over(per_name.orderBy(F.desc_nulls_last("score_rerank"), "chunk_id"))
    slots = F.greatest(F.lit(2), F.floor(F.lit(k) / F.col("names")))
    first = pairs.withColumn("place", place).where(F.col("place") <= slots)
    once = Window.partitionBy("query_id", "chunk_id").orderBy("pos")
    first = first.withColumn("seen", F.row_number().over(once)).where("seen = 1").select("query_id", "chunk_id", "company_name", "score_rerank", "pos", "place")
    rest = hits.join(counted.select("query_id"), "query_id", "left_semi").join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    by_score = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score_rerank"), "chunk_id")
    rest = rest.select("query_id", "chunk_id", "company_name", "score_rerank", F.lit(9).alias("pos"), F.row_number().over(by_score).alias("place"))
    order = Window.partitionBy("query_id").orderBy("pos", "place", "chunk_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("pos", "place")


def intents(query: Column, query_type: Column) -> Column:
    """The intents of a question in fixed order, as an array; the core view if it shows none."""
    query = text_or_empty(query)
    forced = {"core_view": "summary", "financial_metric": "comparative"}
    shown = [
        F.when(any_contained(query, rule[0]) | (query_type.eqNullSafe(F.lit(forced[name])) if name in forced else F.lit(False)), F.lit(name)) for name, rule in INTENTS.items()
    ]
    found = F.array_compact(F.array(*shown))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("core_view")))


def selection_score(score: Column, found: Column, section: Column, text: Column, content_type: Column, query_type: Column) -> Column:
    """The rerank score, raised and lowered by how section and content fit the intents."""
    section, text = text_or_empty(section), text_or_empty(text)
    total = score
    for name, (_, favoured, disfavoured, up, down) in INTENTS.items():
        has = F.array_contains(found, name)
        good = any_contained(section, favoured) | any_contained(F.substring(text, 1, 200), favoured)
        total = total + F.when(has & good, up).otherwise(0.0) - F.when(has & any_contained(section, disfavoured), down).otherwise(0.0)
    has = lambda name: F.array_contains(found, name)
    legend = F.contains(section, F.lit("评级说明"))
    kind = text_or_empty(content_type)
    steps = [
        (kind.eqNullSafe("rating_headline") & has("rating"), 0.25),
        ((kind == "comparable_table") & ~query_type.eqNullSafe("comparative"), -0.15),
        (kind == "noise", -0.30),
        (has("risk") & (legend | F.contains(section, F.lit("投资评级摘要"))), -0.25),
        (~has("rating") & legend, -0.12),
        (~has("financial_metric") & any_contained(section, GENERIC_SECTIONS), -0.08),
        (has("actual_period") & F.concat(section, F.substring(text, 1, 120)).rlike("202[6-9]E"), -0.06),
    ]
    return F.round(reduce(lambda t, s: t + F.when(s[0], s[1]).otherwise(0.0), steps, total), 6)


def section_key(section: Column) -> Column:
    """A section's title without its table number, at most 40 letters, or ``unknown``."""
    bare = F.substring(F.regexp_replace(stripped(text_or_empty(section)), r"^表\d+\s*", ""), 1, 40)
    return F.when(bare == "", "unknown").otherwise(bare)


def holds_name(name: Column, company: Column, display: Column, text: Column) -> Column:
    """Whether a hit names a compared name of two letters or more."""
    name = stripped(text_or_empty(name))
    return (F.length(name) >= 2) & F.contains(F.concat_ws(" ", *map(text_or_empty, (company, display, text))), name)


def select_evidence(hits: DataFrame, k: int = 3, pool: int = POOL) -> DataFrame:
    """The ``k`` best hits of each query's first ``pool`` by ``score_selected``, at most ``PER_SECTION`` of a section.

    Hits beyond a section's places come only when no others are left. Ties keep the rerank order. Where ``hits`` has
    ``names`` (an array; empty but for comparisons), the best hit that holds each of the first two names comes first.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score_selected"), "rank")
    whole = Window.partitionBy("query_id")
    pooled = hits.where(F.col("rank") <= pool).withColumn("section_key", section_key(F.col("section_title"))).withColumn("by_score", F.row_number().over(best))
    if "names" in hits.columns:
        named = F.size("names") >= 2
        holds = lambda i: F.coalesce(named & holds_name(F.get("names", F.lit(i)), F.col("company_name"), F.col("display_name"), F.col("passage")), F.lit(False))
        pooled = pooled.withColumn("_one", F.min(F.when(holds(0), F.col("by_score"))).over(whole))
        pooled = pooled.withColumn("_two", F.min(F.when(holds(1) & ~F.col("by_score").eqNullSafe(F.col("_one")), F.col("by_score"))).over(whole))
        cover = F.when(F.col("by_score") == F.col("_one"), 0).when(F.col("by_score") == F.col("_two"), 1)
    else:
        cover = F.lit(None).cast("int")
    pooled = pooled.withColumn("_cover", cover)
    section = Window.partitionBy("query_id", "section_key").orderBy(F.asc_nulls_last("_cover"), "by_score")
    tier = F.when(F.col("_cover").isNotNull(), -1).when(F.row_number().over(section) <= PER_SECTION, 0).otherwise(1)
    order = Window.partitionBy("query_id").orderBy("tier", F.asc_nulls_last("_cover"), "by_score")
    placed = pooled.withColumn("tier", tier).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed.drop("tier", "by_score", "_cover", "_one", "_two")


def gate(queries: DataFrame, hits: DataFrame, threshold: float = REFUSAL_THRESHOLD) -> DataFrame:
    """(query_id, passed, reason, top_score, n_hits, checks) of each query, by seven rules; the first that fails is the reason.

    ``queries``: (query_id, query, query_type, stock_code, names: the number of compared names). ``hits`` carry
    ``score_selected``, ``passage``, ``page_start``, ``display_name``, ``doc_id`` and ``stock_code_hit``.
    """
    place = F.col("rank")
    code = stripped(text_or_empty(F.col("stock_code")))
    joined = queries.join(hits, "query_id", "left")
    hit_code = stripped(text_or_empty(F.col("stock_code_hit")))
    blob = F.concat_ws(" ", text_or_empty(F.col("company_name")), text_or_empty(F.col("display_name")), text_or_empty(F.col("passage")))
    code_in = ((hit_code != "") & (F.contains(code, hit_code) | F.contains(hit_code, code))) | F.contains(blob, code)
    filed = stripped(text_or_empty(F.col("filename"))) != "" if "filename" in hits.columns else F.lit(False)
    anchor = (F.coalesce("page_start", F.lit(0)) > 0) | filed | (stripped(text_or_empty(F.col("display_name"))) != "") | (stripped(text_or_empty(F.col("doc_id"))) != "")
    company = stripped(text_or_empty(F.col("company_name")))
    top = F.when(place == 1, F.lit(True))
    selected = F.max_by(F.struct("section_title", "score_rerank", "score_selected"), F.when(place <= POOL, F.struct("score_selected", (-place).alias("r"))))
    per = joined.groupBy("query_id", "query", "query_type", "stock_code", "names").agg(
        F.count("chunk_id").alias("n_hits"),
        F.coalesce(F.max(F.when(top, F.coalesce("score_rerank", "score"))), F.lit(0.0)).alias("top_score"),
        F.coalesce(F.max(F.when(top, F.length("passage"))), F.lit(0)).alias("top_chars"),
        F.coalesce(F.bool_or(F.when(top, anchor)), F.lit(False)).alias("anchored"),
        F.coalesce(F.bool_or(F.when(place <= 3, code_in)), F.lit(False)).alias("code_found"),
        F.count_distinct(F.when((place <= 5) & (company != ""), company)).alias("companies"),
        selected.alias("best"),
    )
    comparing = F.col("query_type").eqNullSafe("comparative") | (F.col("names") >= 2) | any_contained(text_or_empty(F.col("query")), COMPARE_HINTS) | text_or_empty(F.col("query")).rlike(COMPARE_MANY)
    found = intents(F.col("query"), F.col("query_type"))
    section = text_or_empty(F.col("best.section_title"))
    blocked = reduce(lambda a, b: a | b, [F.array_contains(found, n) & any_contained(section, s) for n, s in BLOCKED_SECTIONS.items()])
    drop = F.round(F.col("best.score_rerank") - MISMATCH_DROP, 6)
    rules = [
        ("no_hits", F.col("n_hits") == 0),
        ("low_rerank_score", F.col("top_score") < threshold),
        ("insufficient_passage", F.col("top_chars") < MIN_PASSAGE),
        ("missing_source_page", ~F.col("anchored")),
        ("stock_mismatch", (code != "") & ~F.col("code_found")),
        ("comparative_insufficient", comparing & (F.col("companies") < 2)),
        ("weak_evidence_intent", blocked | F.coalesce(F.col("best.score_selected") < drop, F.lit(False))),
    ]
    reason = F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in rules], F.lit(""))
    checks = F.array(*[F.struct(F.lit(name).alias("name"), (~failed).alias("passed")) for name, failed in rules])
    return per.select("query_id", "n_hits", F.round("top_score", 6).alias("top_score"), reason.alias("reason"), (reason == "").alias("passed"), checks.alias("checks"))


def refusal_message(reason: Column, top_score: Column, threshold: float = REFUSAL_THRESHOLD, companies: Column | None = None, stock_code: Column | None = None) -> Column:
    """What a refusal tells its reader; empty for no reason."""
    label = F.coalesce(*[F.when(reason == c, F.lit(t)) for c, t in REFUSALS.items()], F.lit("证据不足"))
    start = F.concat(F.lit("我不确定："), label)
    found = companies if companies is not None else F.lit(0)
    code = stock_code if stock_code is not None else F.lit("")
    return (
        F.when(reason == "", "")
        .when(reason == "low_rerank_score", F.concat(start, F.format_string(f"（Top-1 rerank=%.3f，阈值={threshold:.2f}），无法基于当前检索结果可靠回答。", top_score)))
        .when(reason == "no_hits", F.concat(start, F.lit("，无法回答该问题。")))
        .when(reason == "missing_source_page", F.concat(start, F.lit("，无法生成带页码引用的答案。")))
        .when(reason == "comparative_insufficient", F.concat(start, F.lit("（需至少 2 个主体，当前仅 "), found.cast("string"), F.lit(" 个），无法完成对比回答。")))
        .when(reason == "stock_mismatch", F.concat(F.lit("我不确定：检索证据未覆盖指定股票（"), code, F.lit("），无法可靠回答。")))
        .otherwise(F.concat(start, F.lit("，无法基于当前检索结果可靠回答。")))
    )


def page_label(first: Column, last: Column) -> Column:
    """``第n页``, ``第n-m页``, or empty without a page."""
    a, b = F.coalesce(first, F.lit(0)), F.coalesce(last, F.lit(0))
    return F.when(a <= 0, "").when((b > a), F.concat(F.lit("第"), a.cast("string"), F.lit("-"), b.cast("string"), F.lit("页"))).otherwise(F.concat(F.lit("第"), a.cast("string"), F.lit("页")))


def citations(hits: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, idx, chunk_id, source, pages, line) of each query's first ``k`` hits."""
    source = F.coalesce(*[F.nullif(stripped(text_or_empty(F.col(c))), F.lit("")) for c in ("display_name", "company_name", "doc_id")], F.lit(""))
    pages = page_label(F.col("page_start"), F.col("page_end"))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws("，", source, F.nullif(pages, F.lit(""))))
    return hits.where(F.col("rank") <= k).select("query_id", F.col("rank").alias("idx"), "chunk_id", source.alias("source"), pages.alias("pages"), line.alias("line"))


def extractive_answer(hits: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, answer): the first sentence of each cited hit and the list of citations; a stand-in for a written answer."""
    joined = hits.join(cited, ["query_id", "chunk_id"])
    said = F.concat(F.regexp_extract(text_or_empty(F.col("text")), r"(?s)\A(.*?[。！？!?]|.*)", 1), F.lit(" ["), F.col("idx").cast("string"), F.lit("]"))
    parts = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("idx", said.alias("said"), "line"))).alias("parts"))
    return parts.select("query_id", F.concat(F.array_join("parts.said", "\n"), F.lit("\n参考来源：\n"), F.array_join("parts.line", "\n")).alias("answer"))
