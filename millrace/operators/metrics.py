"""Relevance and quality of hits and answers, per question and over groups of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import any_contained, digits_only, stripped, text_or_empty


# Tokens that several words stand for.
ALIASES = {
    "EPS": ("EPS", "每股收益", "摊薄每股收益", "每股盈利"), "PE": ("PE", "市盈率", "P/E"), "YoY": ("YoY", "同比"), "归母净利润": ("归母净利润", "归母净利", "净利润"), "净利润": ("净利润", "归母净利润"),
    "营收": ("营收", "营业收入", "营业总收入"), "营业收入": ("营业收入", "营收", "营业总收入"), "评级": ("评级", "投资评级"), "买入": ("买入", "增持", "推荐", "优于大市"), "增持": ("增持", "买入", "推荐"),
    "分红": ("分红", "派息", "股利", "股利支付率"), "回购": ("回购",), "毛利率": ("毛利率", "销售毛利率"), "外销": ("外销", "出口", "海外"), "出口": ("出口", "外销", "海外"),
}


def expanded(wanted: Column) -> Column:
    """Wanted tokens with all words that stand for them, each once, in order."""
    table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(wanted, lambda t: F.coalesce(table[t], F.array(t)))))


def blob(*parts: Column) -> Column:
    """The parts that are not empty, on lines of their own."""
    return F.array_join(F.filter(F.array(*map(text_or_empty, parts)), lambda x: x != ""), "\n")


def any_token(text: Column, wanted: Column) -> Column:
    """Whether a text holds any of the wanted tokens or of the words that stand for them; figures also match among the text's digits run together.

    Without wanted tokens every text matches.
    """
    text, tokens = text_or_empty(text), F.filter(wanted, lambda t: stripped(text_or_empty(t)) != "")
    figures = digits_only(text)
    found = F.exists(expanded(tokens), lambda t: F.contains(text, t) | (t.rlike(r"\d") & (F.length(digits_only(t)) > 0) & F.contains(figures, digits_only(t))))
    return F.coalesce(F.size(tokens) == 0, F.lit(True)) | F.coalesce(found, F.lit(False))


# Words of ratings.
RATED, RATING_NAMES = ("买入", "增持", "推荐", "优于大市"), ("评级", "投资评级")
HIT_FIELDS = ("section_title", "embedding_text", "text", "display_name", "company_name", "report_title", "broker", "rating")


def keyword_found(text: Column, rating: Column, keywords: Column) -> Column:
    """Whether a section keyword occurs in a hit's text, or is one of ratings and the hit is rated, or occurs in its rating."""
    rating = stripped(text_or_empty(rating))
    return F.coalesce(F.exists(keywords, lambda k: F.contains(text, k) | (k.isin(*RATING_NAMES) & (rating != "")) | (k.isin("买入", "增持") & F.contains(rating, k))), F.lit(False))


def relevant(hit: str, question: str) -> Column:
    """Whether a hit answers a question; ``hit`` and ``question`` are aliases of two sides of a join.

    ``hit`` has chunk_id, stock_code, doc_id, industry_label and ``HIT_FIELDS``; ``question`` has query_type, category,
    stock_code, doc_id, industry_label and the arrays negative_stock_codes, gold_chunk_ids, section_keywords,
    must_contain_any, each null for none. In order: a negative stock code is never relevant, a gold chunk always; a
    summary without stock code and document goes by industry, keywords and tokens; otherwise stock code or document
    must fit, and then a wanted token, or for ratings the hit's rating, or keywords and tokens together.
    """
    h, q = lambda c: stripped(text_or_empty(F.col(f"{hit}.{c}"))), lambda c: stripped(text_or_empty(F.col(f"{question}.{c}")))
    of = lambda c: F.coalesce(F.col(f"{question}.{c}"), F.array().cast("array<string>"))
    text, wanted, keywords = blob(*[F.col(f"{hit}.{c}") for c in HIT_FIELDS]), of("must_contain_any"), of("section_keywords")
    no_keyword = F.size(keywords) == 0
    by_keyword, by_token = no_keyword | keyword_found(text, F.col(f"{hit}.rating"), keywords), any_token(text, wanted)
    stock_ok, doc_ok = (q("stock_code") == "") | (h("stock_code") == q("stock_code")), (q("doc_id") == "") | (h("doc_id") == q("doc_id"))
    open_summary = (q("query_type") == "summary") & (q("stock_code") == "") & (q("doc_id") == "")
    rated = any_contained(h("rating"), RATED) | any_token(h("rating"), F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit("评级"), F.lit("买入"))))
    return (
        F.when(F.array_contains(of("negative_stock_codes"), h("stock_code")), False)
        .when(F.array_contains(of("gold_chunk_ids"), F.col(f"{hit}.chunk_id").cast("string")), True)
        .when(open_summary, ((q("industry_label") == "") | (h("industry_label") == q("industry_label"))) & by_keyword & by_token)
        .when(~stock_ok & ~doc_ok, False)
        .when(((stock_ok & (h("stock_code") != "")) | (doc_ok & (h("doc_id") != ""))) & by_token, True)
        .when((q("category") == "rating") & stock_ok & rated, True)
        .otherwise(by_keyword & by_token)
    )


CITATION_CHECKS = ("has_citations", "pages_present", "sources_present", "cited_chunk_relevant", "must_tokens_in_answer", "doc_stock_aligned", "refs_in_answer")


def citation_checks(questions: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, applicable, accuracy, ``CITATION_CHECKS``): how far each answer's citations can be followed and fit its question.

    ``questions``: as for ``relevant``, with query_id, answer and refused; ``cited``: a row (query_id, page_start, in_rerank)
    with the hit's fields for each citation. A refused answer is right if it cites nothing; else the accuracy is the
    share of the seven checks that hold. A cited chunk counts as relevant if it was among the reranked, or is gold.
    """
    joined = cited.alias("h").join(questions.alias("q"), F.col("h.query_id") == F.col("q.query_id"))
    c = lambda x: stripped(text_or_empty(F.col(f"h.{x}")))
    text = text_or_empty(F.col("q.answer"))
    gold = F.array_contains(F.coalesce(F.col("q.gold_chunk_ids"), F.array().cast("array<string>")), F.col("h.chunk_id"))
    want = lambda x: stripped(text_or_empty(F.col(f"q.{x}")))
    apart = lambda x: (want(x) != "") & (c(x) != "") & (c(x) != want(x))
    source = F.coalesce(F.nullif(c("display_name"), F.lit("")), F.nullif(c("company_name"), F.lit("")), c("doc_id"))
    page = F.coalesce(F.col("h.page_start"), F.lit(0))
    negative = F.coalesce(F.array_contains(F.col("q.negative_stock_codes"), c("stock_code")), F.lit(False))
    named = ((page > 0) & F.contains(text, page.cast("string"))) | ((source != "") & F.contains(text, F.substring(source, 1, 8)))
    rows = joined.select(
        F.col("q.query_id"), (page > 0).alias("paged"), (source != "").alias("sourced"), (gold | (F.coalesce(F.col("h.in_rerank"), F.lit(False)) & relevant("h", "q"))).alias("fits"),
        (apart("stock_code") | apart("doc_id") | negative).alias("apart"), named.alias("named"),
    )
    per = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.bool_and("paged").alias("paged"), F.bool_and("sourced").alias("sourced"), F.bool_or("fits").alias("fits"), F.bool_or("apart").alias("apart"), F.bool_or("named").alias("named"))
    both = questions.join(per, "query_id", "left")
    has = F.coalesce(F.col("n") > 0, F.lit(False))
    answer = text_or_empty(F.col("answer"))
    marks = answer.rlike(r"\[\d+\]") | F.contains(answer, F.lit("参考文献"))
    tokens_ok = any_token(answer, F.coalesce("must_contain_any", F.array().cast("array<string>")))
    values = [has, has & F.col("paged"), has & F.col("sourced"), has & F.col("fits"), tokens_ok, ~has | ~F.col("apart"), has & (marks | F.col("named"))]
    refused = F.coalesce("refused", F.lit(False))
    checks = [F.coalesce(v, F.lit(False)) for v in values]
    score = sum([v.cast("double") for v in checks[1:]], checks[0].cast("double")) / len(checks)
    accuracy = F.when(refused, F.when(has, 0.0).otherwise(1.0)).otherwise(score)
    shown = [F.when(refused, has if n == "has_citations" else F.lit(True)).otherwise(v).alias(n) for n, v in zip(CITATION_CHECKS, checks, strict=True)]
    return both.select("query_id", (~refused).alias("applicable"), accuracy.alias("accuracy"), *shown)


def per_question(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Recall at 3, 5 and 10, precision at 5 and 10, reciprocal rank of each question, also of those without hits.

    ``hits``: (query_id, rank, relevant). Precision divides by k even where a question has fewer hits.
    """
    found = hits.where("relevant").groupBy("query_id").agg(
        F.min("rank").alias("first"), F.count_if(F.col("rank") <= 5).alias("n5"), F.count_if(F.col("rank") <= 10).alias("n10")
    )
    joined = questions.join(found, "query_id", "left")
    at = lambda k: F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias(f"recall_at_{k}")
    return joined.select(
        *questions.columns, "first", at(3), at(5), at(10),
        (F.coalesce("n5", F.lit(0)) / 5).alias("precision_at_5"), (F.coalesce("n10", F.lit(0)) / 10).alias("precision_at_10"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


METRICS = ("recall_at_3", "recall_at_5", "recall_at_10", "precision_at_5", "precision_at_10", "mrr")


def mean(value: str) -> Column:
    """The mean of what is neither null nor NaN; NaN of nothing."""
    v = F.col(value)
    return F.coalesce(F.avg(F.when(~F.isnan(v), v)), F.lit(float("nan")))


def means(rows: DataFrame, *groups: str) -> DataFrame:
    """Means of all metrics over groups."""
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def means_by_route(rows: DataFrame) -> DataFrame:
    """Means by route, and by route and type of question, in one pass; ``level`` tells which."""
    sets = rows.groupingSets([["route"], ["route", "query_type"]], "route", "query_type")
    return sets.agg(F.grouping("query_type").alias("level"), F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def index_percentile(value: str, percent: int) -> Column:
    """The value at index int(n * percent / 100) - 1 of the sorted values, kept within them; null of nothing.

    For groups whose values fit into a row; use ``ranked_percentile`` for others.
    """
    values = F.array_sort(F.collect_list(value))
    n = F.size(values)
    at = F.least(F.greatest(F.floor(n * percent / 100) - 1, F.lit(0)), n - 1)
    return F.get(values, at.cast("int"))


def ranked_percentile(df: DataFrame, group: str, value: str, percent: int, buckets: int = 1024) -> DataFrame:
    """(group, value) at that same index.

    Values are counted by bands between the approximate quantiles of all groups together, then only the band of a
    group that holds the index is ranked, so that no task sorts a whole group. NaN is left out as null is.
    """
    from pyspark.sql.window import Window

    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(group, value)
    edges = rows.agg(F.percentile_approx(F.col(value).cast("double"), [k / buckets for k in range(1, buckets)], 10_000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))  # at most as many as there are buckets
    # how many edges lie at or below a value, told by the index among them
    spot = F.array_position(F.array_sort(F.array_append(F.array(*map(F.lit, edges)).cast("array<double>"), F.col(value).cast("double"))), F.col(value).cast("double"))
    banded = rows.withColumn("band", spot)
    counts = banded.groupBy(group, "band").agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)  # a row per band
    placed = counts.withColumn("upto", F.sum("c").over(w.orderBy("band").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = F.greatest(F.floor(F.col("n") * percent / 100) - 1, F.lit(0))
    hit = placed.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(F.col(group).alias("_g"), F.col("band").alias("_b"), (at - F.col("upto") + F.col("c")).alias("_at"))
    inside = banded.join(F.broadcast(hit), F.col(group).eqNullSafe(F.col("_g")) & (F.col("band") == F.col("_b")))
    counted = inside.groupBy(group, value, "_at").agg(F.count("*").alias("c"))
    v = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    seen = counted.withColumn("upto", F.sum("c").over(v))
    return seen.where((F.col("upto") > F.col("_at")) & (F.col("upto") - F.col("c") <= F.col("_at"))).select(group, value)


def supported(answer: Column, wanted: Column, gold: Column, refused: Column) -> Column:
    """Whether an answer is borne out: not refused, and with a wanted token, else with two of the gold answer's tokens, else long."""
    text = text_or_empty(answer)
    gold_tokens = F.array_distinct(F.regexp_extract_all(text_or_empty(gold), F.lit(r"[\d.]+%?|[A-Za-z]{2,}|[一-鿿]{2,}"), F.lit(0)))
    matched = F.size(F.filter(gold_tokens, lambda t: F.contains(text, t)))
    has_wanted = F.coalesce(F.size(wanted), F.lit(0)) > 0
    return ~F.coalesce(refused, F.lit(False)) & F.when(has_wanted, any_token(text, wanted)).when(F.size(gold_tokens) > 0, matched >= F.least(F.lit(2), F.size(gold_tokens))).otherwise(F.length(text) > 40)
