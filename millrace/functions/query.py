"""Rewriting of questions, as column expressions; null questions are treated as empty."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import any_contained, let, stripped, text_or_empty

# Words of a question, and what a lexical search is widened by when one of them occurs.
EXPANSIONS = (
    (("EPS", "PE", "市盈率", "每股收益", "净利润", "营收", "预测", "毛利率"), "盈利预测 财务 投资要点"),
    (("评级", "买入", "增持", "推荐"), "投资评级 买入 增持 推荐"),
    (("风险",), "风险提示 风险因素"),
    (("对比", "哪家", "哪个更高", "哪个更", "差异", "比较"), "盈利预测 业绩"),
)
# Metrics that a comparison may be about.
METRICS = ("每股收益", "净利润", "归母净利润", "营业收入", "营收", "毛利率", "市盈率", "EPS", "PE", "发电量", "装机容量", "投资评级", "评级", "预测")
# Words after which the second of two compared names has ended, and words of comparing.
COMPARE = r"^(.+?)(?:和|与)(.+?)(?:\d|哪家|谁|哪个|哪|对比|比较|更高|更低|更积极|更|规模|增速|差异|是否|布局)"
COMPARE_OPEN = r"^(.+?)(?:和|与)(.+?)$"
COMPARE_WORDS = r"(?:对比|比较|哪家|谁更高|谁更低|孰高|孰低|哪个更高|哪个更|差异|是否|怎样|如何|多少|是什么)"
PUNCTUATION = r"[？?。．.!！,，;；:：、的]+"
YEAR = r"(?<!\d)(20\d{2})E?"
# Metrics for which lexical hits weigh more.
NUMERIC_WORDS = ("EPS", "PE", "市盈率", "净利润", "归母", "营收", "预测", "毛利率", "%")


def widened(query: Column, stock_code: Column) -> Column:
    """The question, its stock code and the section words that its words call for."""
    query, code = text_or_empty(query), text_or_empty(stock_code)
    extra = [F.when(any_contained(query, words), F.lit(more)) for words, more in EXPANSIONS]
    return F.concat_ws(" ", stripped(query), F.when(code != "", code), *extra)


def compared(query: Column) -> Column:
    """The two names that a question compares, as an array; empty if there are not two of two letters or more."""

    def pair(text: Column, pattern: str) -> Column:
        left, right = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
        both = F.array(stripped(left), stripped(F.regexp_replace(right, r"[\d０-９].*$", "")))
        return let(both, lambda names: F.when(F.forall(names, lambda x: F.length(x) >= 2), names))

    return let(stripped(text_or_empty(query)), lambda t: F.coalesce(pair(t, COMPARE), pair(t, COMPARE_OPEN), F.array().cast("array<string>")))


def metric_part(query: Column, names: Column) -> Column:
    """The metrics of a comparison without its names, years and words of comparing; its first 40 letters if it has none."""
    bare = F.aggregate(names, stripped(text_or_empty(query)), lambda t, n: F.when(n != "", F.replace(t, n, F.lit(" "))).otherwise(t))
    for pattern in (YEAR, COMPARE_WORDS, PUNCTUATION):
        bare = F.regexp_replace(bare, pattern, " ")
    bare = stripped(F.regexp_replace(bare, r"\s+", " "))
    metrics = F.array(*map(F.lit, METRICS))
    kept = lambda t: F.array_join(F.filter(metrics, lambda m: F.contains(F.upper(t), F.upper(m))), " ")
    return let(bare, lambda t: F.coalesce(F.nullif(kept(t), F.lit("")), F.nullif(stripped(F.substring(t, 1, 40)), F.lit("")), F.lit("盈利预测")))


def sub_queries(query: Column) -> Column:
    """Array of structs (entity, query): a search of its own for each of at most three compared names."""
    year = F.regexp_extract(text_or_empty(query), YEAR, 1)

    def searches(names: Column) -> Column:
        tail = F.concat_ws(" ", F.when(year != "", F.concat(year, F.lit("年"))), metric_part(query, names))
        return let(tail, lambda t: F.transform(names, lambda n: F.struct(n.alias("entity"), let(F.concat_ws(" ", n, t), lambda core: widened(core, F.lit(""))).alias("query"))))

    return let(F.slice(F.array_distinct(compared(query)), 1, 3), searches)


def dense_weight(query_type: Column, query: Column, default: float = 0.4) -> Column:
    """How much dense similarity weighs against lexical score."""
    return F.when(query_type == "comparative", 0.45).when(query_type == "summary", 0.5).when(any_contained(text_or_empty(query), NUMERIC_WORDS), default).otherwise(0.5)


# Phrases that a cache key leaves out, and metrics with several names.
POLITE_PREFIX = r"^(?:请问|请告诉我|请介绍|请说明|请概括|想了解一下|想了解|帮我查一下|帮我|帮忙|能否|能不能|可以|麻烦)"
FILLER_SUFFIX = r"(?:（帮忙查一下）|（请帮忙）|\(帮忙查一下\)|\(请帮忙\)|帮忙查一下|谢谢|多谢)$"
QUESTION_TAIL = r"(?:是多少|是什么|有多少|怎么样|如何|吗|呢|呀|啊|么)([？?]*)$"
METRIC_NAMES = (("每股收益", "EPS"), ("市盈率(?!PE)", "PE"), ("营业收入", "营收"), ("归母净利润", "净利润"))
COMPANY_SUFFIX = "(?:科技|股份|集团|国际|装备|新能|微|技术|核电|易佰|传媒|信息|材料|电子|软件|网络|数据|智能|光电|半导体)?"


@cache
def _compatible() -> tuple[str, str]:
    """All characters of the basic plane whose compatibility form is one other character, and those forms."""
    pairs = {c: form for c in map(chr, range(0x80, 0xFFFE)) if not 0xD800 <= ord(c) < 0xE000 and len(form := unicodedata.normalize("NFKC", c)) == 1 and form != c}
    return "".join(pairs), "".join(pairs.values())


def _narrow(text: Column) -> Column:
    """Compatibility forms of one character as that character: full-width signs, circled numbers, compatibility ideographs."""
    return F.translate(text, *_compatible())


def cache_text(query: Column) -> Column:
    """The form of a question that a cache key holds: without politeness, endings and particles, company before year."""
    text = F.regexp_replace(_narrow(stripped(text_or_empty(query))), r"\s+", " ")
    steps = [
        (POLITE_PREFIX, ""), (r"^\s+|\s+$", ""), (FILLER_SUFFIX, ""), (r"^\s+|\s+$", ""), (QUESTION_TAIL, "$1"), (r"是[？?]*$", ""),
        (r"[？?。．.!！,，;；:：]+$", ""), (r"^\s+|\s+$", ""), *METRIC_NAMES,
        (r"([一-鿿]{2,12})的(EPS|PE|营收|净利润|毛利率)", "$1$2"), (r"(?<=[一-鿿])\s+(?=\d)|(?<=\d)\s+(?=[一-鿿])", ""),
        (r"(20\d{2})年的", "$1年"), (r"的+", "的"), (r"年 ?的", "年"),
    ]
    text = reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)
    first = rf"^([一-鿿]{{2,12}}{COMPANY_SUFFIX})(20\d{{2}})年?(.*)$"
    second = rf"^(20\d{{2}})年([一-鿿]{{2,12}}{COMPANY_SUFFIX})(.*)$"

    def ordered(t: Column) -> Column:
        """Company, year, rest; a year at the end without its sign."""
        led = F.when(t.rlike(first), F.regexp_replace(t, first, "$1$2年$3")).when(t.rlike(second), F.regexp_replace(t, second, "$2$1年$3")).otherwise(t)
        return F.when(F.regexp_extract(t, first, 1) != "", F.when(F.regexp_extract(t, first, 3) == "", F.regexp_replace(led, "年+$", "")).otherwise(led)).otherwise(led)

    return stripped(F.regexp_replace(let(text, ordered), r"\s+", " "))


def report_year(text: Column) -> Column:
    """The last year 20xx that stands alone in a text, or empty."""
    years = F.regexp_extract_all(text_or_empty(text), F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1))
    return F.coalesce(F.try_element_at(years, F.lit(-1)), F.lit(""))


# Words that are no company.
NO_COMPANY = (
    "请问", "请告诉", "想了解", "帮忙", "多少", "是什么", "如何", "预测", "盈利", "财务", "投资", "评级", "风险", "营收", "净利润", "毛利率", "可比", "公司", "主要", "核心", "业务",
)


def company_hint(text: Column) -> Column:
    """The company that a question names: before a year, behind one, or the first plausible run of Han letters."""
    name = rf"([一-鿿]{{2,12}}{COMPANY_SUFFIX})"
    plausible = lambda c: F.length(c).between(2, 14) & ~c.isin(*NO_COMPANY) & ~c.rlike("多少|什么|如何|请问")

    def found(t: Column) -> Column:
        before, behind = F.regexp_extract(t, rf"^{name}\s*(?:20\d{{2}})", 1), F.regexp_extract(t, rf"(?:20\d{{2}})年\s*{name}", 1)
        runs = F.filter(F.regexp_extract_all(t, F.lit(name), F.lit(1)), plausible)
        return F.coalesce(F.when(plausible(before), before), F.when(plausible(behind), behind), F.get(runs, F.lit(0)), F.lit(""))

    return let(cache_text(text), found)


# Six ways to say a question differently; metrics in the order in which they are looked for, and what they are called.
PARAPHRASES = ("polite_prefix", "polite_tell", "synonym_metric", "word_order", "punctuation", "filler_suffix")
TOLD_METRICS = (("EPS", "每股收益"), ("PE", "PE"), ("营收", "营收"), ("净利润", "净利润"), ("毛利率", "毛利率"), ("市盈率", "市盈率"), ("每股收益", "每股收益"), ("营业收入", "营业收入"))
# Names of metrics that are swapped: if the first is there and the second is not, it becomes the third.
SWAPS = (("(?i)EPS", "每股收益", "每股收益"), ("每股收益", None, "EPS"), ("市盈率", "(?i)PE", "PE"), (r"(?i)\bPE\b", "市盈率", "市盈率"), ("营业收入", None, "营收"), ("营收", "营业收入", "营业收入"))


def paraphrase(query: Column, variant: Column) -> Column:
    """A question said in another way; where a way needs a year and a company that are not there, it is the polite one."""
    mark = F.lit("？")
    base = stripped(F.regexp_replace(text_or_empty(query), "[？?]+$", ""))
    polite = F.concat(F.when(base.startswith("请问"), base).otherwise(F.concat(F.lit("请问"), base)), mark)
    form, year, company = cache_text(query), report_year(query), company_hint(query)
    both = (year != "") & (company != "")
    metric = F.coalesce(*[F.when(F.contains(F.upper(form) if word in ("EPS", "PE") else form, F.lit(word)), F.lit(name)) for word, name in TOLD_METRICS], F.lit("相关信息"))
    told = F.concat(F.lit("请告诉我"), year, F.lit("年"), company, F.lit("的"), metric, mark)
    swapped = F.coalesce(*[F.when(base.rlike(there) & (~base.rlike(other) if other else F.lit(True)), F.concat(F.regexp_replace(base, there, new), mark)) for there, other, new in SWAPS])
    lead = F.concat(company, year, F.lit("年"))
    moved = F.concat(year, F.lit("年"), company, F.substring(form, F.length(lead) + 1, F.length(form)))
    short = F.when(base.rlike("(是多少|是什么|有多少)$"), F.concat(F.regexp_replace(base, "(是多少|是什么|有多少)$", ""), F.lit("是"))).when(base.rlike("吗$"), F.regexp_replace(base, "吗$", "")).otherwise(F.concat(base, F.lit("是")))
    return (
        F.when(variant == "polite_prefix", polite)
        .when(variant == "polite_tell", F.when(both, told).otherwise(polite))
        .when(variant == "synonym_metric", F.coalesce(swapped, polite))
        .when(variant == "word_order", F.when(both & F.startswith(form, lead), F.concat(moved)).otherwise(polite))
        .when(variant == "punctuation", F.concat(short, mark))
        .when(variant == "filler_suffix", F.concat(base, F.lit("（帮忙查一下）？")))
        .otherwise(text_or_empty(query))
    )
