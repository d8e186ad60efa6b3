"""Cleaning and reading of report text, as column expressions.

Every function takes and gives string columns unless said otherwise; null text is treated as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section titles that hold no content.
NOISE_SECTIONS = (
    "免责声明", "投资评级说明", "投资评级标准", "资质声明", "特别声明", "分析师声明",
    "分析师介绍", "适当性管理办法", "太平洋证券股份有限公司", "公司概况", "中邮证券研究所",
)
# Patterns of text that is no content.
NOISE_TEXTS = (
    r"(?i)E-MAIL\s*[:：]|Email\s*[:：]|邮\s*箱\s*[:：]",
    r"@[a-zA-Z0-9._-]+\.(?:com|cn)(?:\.cn)?",
    r"分析师登记编号|执业编号|SAC\s*[:：]|S\d{11}",
    r"(?m)^证券分析师\s*[:：]|^分析师\s*[:：]",
    r"(?m)^联系人\s*[:：]",
    r"^<<.+>>",
    r"请务必阅读正文之后的免责条款",
    r"本报告仅供.*客户使用",
    r"太平洋证券股份有限公司.*版权所有",
    r"投资评级说明|投资评级标准|适当性管理办法",
    r"分析师声明|免责声明",
    r"(?m)^\[Table_",
    r"(?m)^上次评级\s*$",
)
# Brokers by the first pattern found.
BROKERS = (
    (r"(?i)太平洋|PACIFIC\s*SECURITIES", "太平洋证券"),
    (r"(?i)華源|华源|HUAYUAN", "华源证券"),
    (r"(?i)国金|SINOLINK", "国金证券"),
    (r"(?i)中邮|CHINA\s*POST", "中邮证券"),
    (r"东海", "东海证券"),
    (r"(?i)信达|CINDA", "信达证券"),
)
# Company with stock code, plain and inside a parser mark.
COMPANY = r"([一-鿿A-Za-z0-9]+)\s*[（(]\s*(\d{6})(?:\.(?:SH|SZ))?\s*[）)]"
COMPANY_LOOSE = r"\[Table_\w*?([一-鿿]+)\s*\(\s*(\d{6})"
# Ratings by the first pattern found.
RATINGS = (
    r"投资评级[：:\s]*(?:\*+)?\s*(买入|增持|持有|减持|卖出)(?:[/／](维持|首次))?",
    r"(?:首次覆盖[,，])?给予[“\"](买入|增持|持有|减持|卖出)[”\"]()",
    r"(买入|增持|持有|卖出)\s*[（(](?:首次|维持|首次覆盖|首次评级)()",
    r"(买入|增持|持有|卖出)\s*[|｜]\s*(?:维持|首次)()",
    r"(?:股票)?投资评级[：:\s]*(买入|增持|持有|减持|卖出)()",
)
RATING_CONCLUSION = (
    r"给予[“\"](?:买入|增持|持有|卖出)[”\"]评级|投资评级[：:\s]*(?:\*+)?\s*(?:买入|增持|持有|卖出)|首次覆盖.*?(?:买入|增持|持有|卖出)"
)
# Lines that name analysts.
ANALYST_LINE = (
    r"(?i)证券分析师|分析师[：:]|执业编号|SAC\s*[:：]|Email\s*[:：]|邮\s*箱\s*[:：]|分析师登记编号|联系人\s*[:：]|@[a-zA-Z0-9._-]+\.(?:com|cn)(?:\.cn)?"
)
# Titles that say nothing of a report, and parts that mark legal titles.
GENERIC_TITLES = (
    "证券研究报告", "公司研究", "公司点评报告", "公司深度报告", "公司深度研究", "文档摘要", "个股表现",
    "市场表现", "公司基本情况", "投资评级", "上次评级", "研究所", "电子组",
)
LEGAL_TITLES = ("投资评级说明", "分析师声明", "免责声明", "适当性管理办法", "公司概况")
LEGAL_TEXTS = ("适当性管理办法", "投资评级说明", "免责声明", "分析师声明")
# Claims whose unit cannot be right.
FORBIDDEN_UNITS = (
    r"百万元\)为[\d,.+-]+元(?!/股)",
    r"亿元\)为[\d,.+-]+元(?!/股)",
    r"(?:PE|P/E|市盈率)为[\d,.+-]+亿元",
    r"(?:EPS|BVPS|每股收益|每股盈利)为[\d,.+-]+(?:亿元|倍)(?!/)",
    r"BVPS为[\d,.+-]+倍",
    r"(?:ROE|ROIC|ROA|毛利率|净利率)为[\d,.+-]+倍",
    r"YoY为%|(?:营收|占比)为%|为百万元[；;]?$",
)
YEAR_COLUMN = r"^\d{4}[AEFH]?$|^\d{4}\s*[AEFH]$"
VALUE_UNIT = r"[%％]|百万元|亿元|万元|元/股|元$|倍$|倍\s|万股|亿股|百万股"
# The named entities of running text.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def clean_markers(text: Column) -> Column:
    """Without the marks that a layout parser leaves in text."""
    steps = [
        (r"\[Table_StockAndRan([^\]\(]+)\(\s*(\d{6})", "$1($2"),
        (r"\[Table_Title\]", ""),
        (r"\[Table_Author\]\s*", ""),
        (r"\[T[^\]]*?ummary\]\s*", ""),
        (r"\[Table_[^\]]+\]", ""),
        (r"\A\[Table_\S+", ""),
        (r"\[财[^\]]*比率[^\]]*\]", "财务报表和主要财务比率"),
        (r"\A[lL]\s+", ""),
    ]
    return stripped(_replaced(text_or_empty(text), steps))


def unescaped(text: Column) -> Column:
    """With the common named entities as characters."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def normalize_text(text: Column) -> Column:
    """Entities resolved, one kind of blank and line end, no runs of blanks or of empty lines, no parser marks."""
    steps = [(r"[　 ]", " "), (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]
    return clean_markers(stripped(_replaced(unescaped(text_or_empty(text)), steps)))


def html_table_to_text(html: Column) -> Column:
    """Rows as lines and cells between bars; other tags are dropped."""
    steps = [(r"(?i)</tr>", "\n"), (r"(?i)</t[dh]>", " | "), (r"<[^>]+>", "")]
    return normalize_text(_replaced(unescaped(text_or_empty(html)), steps))


def lines_of(text: Column) -> Column:
    """The lines of a text that are not blank, without blanks at their ends, as an array."""
    return F.filter(F.transform(F.split(text_or_empty(text), "\n"), stripped), lambda x: x != "")


def table_header(body: Column) -> Column:
    """The first line of a table."""
    return F.coalesce(F.get(lines_of(body), F.lit(0)), F.lit(""))


def table_rows(body: Column) -> Column:
    """The lines behind the first."""
    rows = lines_of(body)
    return F.when(F.size(rows) > 1, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def cells_of(row: Column) -> Column:
    """The cells of a line between bars that are not blank, as an array."""
    return F.filter(F.transform(F.split(text_or_empty(row), r"\|"), stripped), lambda x: x != "")


def clean_number(value: Column) -> Column:
    """A figure without blanks inside it."""
    steps = [(r"(?<=\d)\s+(?=\d)", ""), (r"(?<=[.,])\s+(?=\d)", ""), (r"(?<=\d)\s+(?=[.%％])", "")]
    return _replaced(stripped(text_or_empty(value)), steps)


def clean_numbers_in(text: Column) -> Column:
    """A text whose figures have no blanks inside them."""
    return _replaced(text_or_empty(text), [(r"(?<=[\d.,])\s+(?=\d)|(?<=\d)\s+(?=[.%％])", "")])


def drop_analyst_lines(text: Column) -> Column:
    """Without the lines that name analysts, their numbers or addresses."""
    kept = F.filter(F.split(text_or_empty(text), "\n"), lambda x: ~x.rlike(ANALYST_LINE))
    return normalize_text(F.array_join(kept, "\n"))


def repair_units(text: Column) -> Column:
    """Ratios that carry a currency get their multiple back."""
    steps = [
        (r"(?i)((?:PE|P/E|市盈率|PB|P/B|市净率)[^。\n]{0,40}?[\d、，,\s]+)亿元", "$1倍"),
        (r"([\d.]+)\s*倍\s*亿元", "$1倍"),
        (r"([\d.]+)\s*元\s*/\s*股\s*倍", "$1元/股"),
    ]
    return stripped(_replaced(clean_numbers_in(text), steps))


def has_rating_conclusion(text: Column) -> Column:
    return text_or_empty(text).rlike(RATING_CONCLUSION)


def any_contained(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text contains any of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def is_noise_section(title: Column) -> Column:
    return any_contained(text_or_empty(title), NOISE_SECTIONS)


def is_noise_text(text: Column, section: Column) -> Column:
    """Whether a unit holds no content, by ordered rules; risk sections are content."""
    text, section = text_or_empty(text), text_or_empty(section)
    name = stripped(section)
    risk_section = F.contains(section, F.lit("风险提示")) | name.isin("核心风险提示", "l 风险提示")
    matched = reduce(lambda a, b: a | b, [text.rlike(p) for p in NOISE_TEXTS])
    return (
        F.when(risk_section & F.contains(text, F.lit("风险")), False)
        .when(is_noise_section(section), True)
        .when(name.isin("研究所", "电子组", "分析师介绍"), True)
        .when(name.isin("投资评级", "上次评级"), ~has_rating_conclusion(text) & ~F.contains(text, F.lit("评级")))
        .when(F.contains(text, F.lit("风险提示")) & ~F.contains(text, F.lit("投资评级")), False)
        .otherwise(matched & ~has_rating_conclusion(text))
    )


def is_rating_standard_table(text: Column, section: Column, caption: Column, header: Column) -> Column:
    head = F.concat_ws("\n", *map(text_or_empty, (section, caption, header)), F.substring(text_or_empty(text), 1, 400))
    return head.rlike(r"投资评级标准|投资评级说明|报告中投资建议的评级标准|适当性管理办法")


def prepared(text: Column, noise: Column) -> Column:
    """Struct (embedding_text, is_retrievable, content_type) of a text unit."""
    cleaned = repair_units(drop_analyst_lines(text))
    keep = ~noise | (has_rating_conclusion(text) & (cleaned != ""))
    return F.struct(
        F.when(keep, cleaned).otherwise(text).alias("embedding_text"), keep.alias("is_retrievable"), F.when(keep, "text").otherwise("noise").alias("content_type")
    )


def units_are_valid(text: Column) -> Column:
    return ~reduce(lambda a, b: a | b, [text_or_empty(text).rlike(p) for p in FORBIDDEN_UNITS])


def unit_named_in(text: Column) -> Column:
    """The unit that a caption names, or empty."""
    found = [r"[（(]([^）)]*(?:百万元|万元|亿元|%/pct|倍|元/股)[^）)]*)[）)]", r"单位\s*[:：]\s*(\S+)"]
    return normalize_text(F.coalesce(*[F.nullif(F.regexp_extract(text_or_empty(text), p, 1), F.lit("")) for p in found], F.lit("")))


def broker_named_in(text: Column) -> Column:
    return F.coalesce(*[F.when(text_or_empty(text).rlike(p), name) for p, name in BROKERS], F.lit(""))


def company_named_in(text: Column) -> Column:
    """Struct (company_name, stock_code)."""
    text = text_or_empty(text)
    plain = text.rlike(COMPANY)
    both = [F.when(plain, F.regexp_extract(text, COMPANY, i)).otherwise(F.regexp_extract(text, COMPANY_LOOSE, i)) for i in (1, 2)]
    return F.struct(stripped(both[0]).alias("company_name"), both[1].alias("stock_code"))


def rating_named_in(text: Column) -> Column:
    """The rating, with ``/suffix`` where one is given; a holder's reduction is no rating."""
    text = text_or_empty(text)
    sale = text.rlike(r"股东减持|减持计划|减持比例|减持完毕|减持股份")
    found = []
    for p in RATINGS:
        word, suffix = F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2)
        found.append(F.when((word != "") & ~(sale & (word == "减持")), F.concat(word, F.when(suffix != "", F.concat(F.lit("/"), suffix)).otherwise(""))))
    return F.coalesce(*found, F.lit(""))


def report_date_named_in(text: Column) -> Column:
    """The date as YYYY-MM-DD, or empty; legal texts name none."""
    text = text_or_empty(text)
    stamped = F.regexp_extract(text, r"发布时间[：:]\s*(\d{4}-\d{2}-\d{2})", 1)
    year, month, day = (F.regexp_extract(text, r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", i) for i in (1, 2, 3))
    spelled = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(any_contained(text, LEGAL_TEXTS), "").when(stamped != "", stamped).when(year != "", spelled).otherwise("")


def is_generic_title(title: Column) -> Column:
    cleaned = clean_markers(title)
    return (cleaned == "") | cleaned.isin(*GENERIC_TITLES) | any_contained(cleaned, LEGAL_TITLES)


# Titles of sections that are no title of a report.
SECTION_TITLES = ("投资要点", "投资建议", "风险提示", "核心风险提示", "投资逻辑", "盈利预测", "盈利预测、估值和评级", "市场表现", "投资评级与估值", "关键假设", "投资逻辑要点")


def merged_titles(titles: Column) -> Column:
    """The titles of a page with those put together that were set on two lines, as an array.

    A short title, or one that ends in a comma or particle, waits for the next; a generic or section title
    ends the wait. Lines that only name a company are left out.
    """
    none = F.array().cast("array<string>")

    def step(acc: Column, title: Column) -> Column:
        state = lambda done, wait: F.struct(done.alias("done"), wait.alias("wait"))
        add = lambda t: F.concat(acc["done"], F.array(t))

        def placed(t: Column) -> Column:
            generic = is_generic_title(t)
            company = (company_named_in(t)["company_name"] != "") & (F.length(t) <= 30)
            open_end = t.rlike("[，、先的与及]$") | ((F.length(t) <= 18) & ~t.rlike("[）)]$"))
            return (
                F.when((t == "") | ((acc["wait"] == "") & generic), acc)
                .when((acc["wait"] != "") & (generic | t.isin(*SECTION_TITLES)), state(add(acc["wait"]), F.lit("")))
                .when(acc["wait"] != "", state(add(F.concat(acc["wait"], t)), F.lit("")))
                .when(company, acc)
                .when(open_end, state(acc["done"], t))
                .otherwise(state(add(t), F.lit("")))
            )

        return let(clean_markers(title), placed)

    start = F.struct(none.alias("done"), F.lit("").alias("wait"))
    return F.aggregate(F.coalesce(titles, none), start, step, lambda a: F.when(a["wait"] != "", F.concat(a["done"], F.array(a["wait"]))).otherwise(a["done"]))


def display_name(company: Column, code: Column, title: Column, broker: Column, date: Column, rating: Column, industry: Column, filename: Column) -> Column:
    """``company（code） — title [industry, broker, date, rating]``, as far as the parts are there."""
    company, code, title, broker, date, rating, industry, filename = map(text_or_empty, (company, code, title, broker, date, rating, industry, filename))
    headline = F.when(company != "", F.concat(company, F.when(code != "", F.concat(F.lit("（"), code, F.lit("）"))).otherwise("")))
    shown = F.when((title != "") & ((company == "") | ((title != company) & (title != headline))), title)
    head = F.concat_ws(" — ", headline, shown)
    meta = F.array_join(F.filter(F.array(industry, broker, date, rating), lambda x: x != ""), ", ")
    name = F.when(head != "", head).when(filename != "", filename).otherwise("未知文档")
    return F.when(meta != "", F.concat(name, F.lit(" ["), meta, F.lit("]"))).otherwise(name)


def sentences_of(paragraph: Column) -> Column:
    """The sentences of a paragraph, without blanks at their ends, as an array."""
    parts = F.filter(F.transform(F.split(text_or_empty(paragraph), r"(?<=[。！？；!?])\s*"), stripped), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text_or_empty(paragraph)))


def value_columns(header: Column) -> Column:
    """The columns of a table that hold values: all but the first, or all if the first is a year."""
    cells = cells_of(header)
    first = F.regexp_replace(F.coalesce(F.get(cells, F.lit(0)), F.lit("")), " ", "")
    rest = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1)))
    return F.when(F.size(cells) <= 1, F.array().cast("array<string>")).when(first.rlike(YEAR_COLUMN), cells).otherwise(rest)


def year_columns(header: Column) -> Column:
    return F.filter(cells_of(header), lambda c: F.regexp_replace(c, " ", "").rlike(YEAR_COLUMN))


def value_has_unit(value: Column) -> Column:
    return stripped(text_or_empty(value)).rlike(VALUE_UNIT)


def is_metric_value(value: Column) -> Column:
    return stripped(text_or_empty(value)).rlike(r"\d")


def indicator_unit(indicator: Column, table_unit: Column, value: Column) -> Column:
    """The unit of a figure by its row's name; empty if the figure carries one or has none."""
    name_, unit, value_ = stripped(text_or_empty(indicator)), text_or_empty(table_unit), text_or_empty(value)
    return let(name_, lambda name: let(value_, lambda v: _unit_of(name, unit, v)))


def _unit_of(name: Column, unit: Column, value: Column) -> Column:
    inside = F.regexp_extract(name, r"[（(]([^）)]*(?:百万元|万元|亿元|元/股|元|倍|%|％)[^）)]*)[）)]", 1)
    given = (
        F.when(F.contains(inside, F.lit("百万元")), "百万元")
        .when(F.contains(inside, F.lit("亿元")), "亿元")
        .when(F.contains(inside, F.lit("万元")), "万元")
        .when(inside.rlike("[%％]"), "%")
        .when(F.contains(inside, F.lit("倍")), "倍")
        .when(F.contains(inside, F.lit("元/股")), "元/股")
        .when(F.endswith(inside, F.lit("元")), "元")
        .otherwise(inside)
    )
    percent = r"(?i)(%|％|增长率|增速|yoy|同比|毛利率|净利率|ROE|ROIC|ROA|资产负债率|负债率|占比|周转率|费用率|税.*?率|股息率|利用率|occupancy|增.*?%|pct)"
    return (
        F.when(~is_metric_value(value) | value_has_unit(value), "")
        .when(inside != "", given)
        .when(name.rlike(percent), "%")
        .when(name.rlike(r"(?i)^(BVPS|EPS|每股|摊薄)"), F.when(F.contains(name, F.lit("股")) | F.upper(name).isin("EPS", "BVPS"), "元/股").otherwise("元"))
        .when(name.rlike(r"(?i)(PE|P/E|PB|P/B|PEG|市净率|市盈率|^EV/|EV/EBITDA)"), "倍")
        .when(name.rlike(r"(收盘价|目标价|市价|股价|最高.?最低|52周)"), "元")
        .when(F.contains(name, F.lit("亿股")), "亿股")
        .when(F.contains(name, F.lit("百万股")), F.when(F.contains(name, F.lit("万股")), "万股").otherwise("百万股"))
        .when(F.contains(name, F.lit("万股")), "万股")
        .when(name.rlike(r"(股本|第一大股东|股东名称|公司名称|说明|类型|备注|资料来源)"), "")
        .otherwise(unit)
    )


def indicator_label(indicator: Column) -> Column:
    """One label for an indicator that goes by several names."""
    label = stripped(text_or_empty(indicator))
    return (
        F.when(label.rlike("每股盈利|每股收益") & ~F.contains(F.upper(label), F.lit("EPS")), F.concat(label, F.lit("(EPS)")))
        .when(label.rlike("归母净利润|归属于.*净利润"), F.when(F.contains(label, F.lit("归母")), label).otherwise("归母净利润"))
        .when(label.isin("营业总收入", "营业收入"), "营业收入")
        .otherwise(label)
    )


def narrative(column: Column, indicator: Column, value: Column, unit: Column) -> Column:
    """``column indicator为value`` with its unit."""
    column = text_or_empty(column)
    named = F.concat(F.when(column != "", F.concat(column, F.lit(" "))).otherwise(""), let(indicator, indicator_label), F.lit("为"))
    return F.concat(named, let(clean_number(value), lambda figure: F.concat(figure, F.when(value_has_unit(figure), "").otherwise(text_or_empty(unit)))))


def narrative_is_valid(sentence: Column, value: Column) -> Column:
    empty = r"为[%百万元亿元倍]+[；;]?$|(?:YoY|营收|占比|毛利率)为%[；;]?$"
    return is_metric_value(value) & let(sentence, lambda s: ~s.rlike(empty) & units_are_valid(s))


def is_comparable_table(caption: Column, header: Column) -> Column:
    return F.concat_ws(" ", text_or_empty(caption), text_or_empty(header)).rlike("可比公司|PE估值")


def digits_only(value: Column) -> Column:
    return F.regexp_replace(text_or_empty(value), r"[^0-9.]", "")


def preview(text: Column, limit: int = 800) -> Column:
    """At most ``limit`` characters, the last three as dots where something is left out."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def safe_filename(name: Column) -> Column:
    """A file name without path parts and signs that file systems forbid."""
    base = F.regexp_replace(text_or_empty(name), r"^.*[/\\]", "")
    return F.regexp_replace(base, r'[<>:"|?*\x00-\x1f]', "_")
