from pyspark.sql import functions as F

from millrace.functions import query as qf
from millrace.functions import text as tx


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, tx.normalize_text(F.col("t")), t="a&nbsp;b　c\r\n\n\n\nd \t e &lt;x&gt; ") == "a b c\n\nd e <x>"
    assert one(spark, tx.normalize_text(F.col("t")), t=None) == ""
    assert one(spark, tx.clean_markers(F.col("t")), t="[Table_Title]正文[Table_Summary] x [财务a比率b]") == "正文x 财务报表和主要财务比率"
    assert one(spark, tx.html_table_to_text(F.col("t")), t="<table><tr><td>a</td><td>1</td></tr><tr><td>b</td></tr></table>") == "a | 1 | \nb |"


def test_numbers_and_lines(spark):
    assert one(spark, tx.clean_number(F.col("t")), t=" 1 234. 5 %") == "1234.5%"
    assert one(spark, tx.clean_numbers_in(F.col("t")), t="收入1 234. 5 %，a 1") == "收入1234.5%，a 1"
    assert one(spark, tx.drop_analyst_lines(F.col("t")), t="正文\n分析师：某\nx@y.com\n尾") == "正文\n尾"
    assert one(spark, tx.repair_units(F.col("t")), t="PE为12亿元") == "PE为12倍"


def test_noise(spark):
    noise = lambda t, s: one(spark, tx.is_noise_text(F.col("t"), F.col("s")), t=t, s=s)
    assert noise("风险提示：需求不足", "风险提示") is False
    assert noise("任何内容", "免责声明") is True
    assert noise("邮箱：x", "正文") is True
    assert noise("给予“买入”评级。分析师声明", "正文") is False
    assert noise(None, None) is False


def test_extraction(spark):
    assert one(spark, tx.company_named_in(F.col("t")), t="某某股份（600001.SH）").asDict() == {"company_name": "某某股份", "stock_code": "600001"}
    assert one(spark, tx.rating_named_in(F.col("t")), t="投资评级：买入/维持") == "买入/维持"
    assert one(spark, tx.rating_named_in(F.col("t")), t="股东减持计划") == ""
    assert one(spark, tx.report_date_named_in(F.col("t")), t="2026年3月5日") == "2026-03-05"
    assert one(spark, tx.report_date_named_in(F.col("t")), t="免责声明 2026年3月5日") == ""
    assert one(spark, tx.broker_named_in(F.col("t")), t="sinolink securities") == "国金证券"
    assert one(spark, tx.unit_named_in(F.col("t")), t="利润表（百万元）") == "百万元"
    assert one(spark, tx.is_generic_title(F.col("t")), t=" 公司点评报告") is True


def test_display_name(spark):
    cols = [F.col(c) for c in "abcdefgh"]
    name = lambda *v: one(spark, tx.display_name(*cols), **dict(zip("abcdefgh", v, strict=True)))
    assert name("甲", "600001", "深度", "乙证券", "2026-01-01", None, "电力", "f.pdf") == "甲（600001） — 深度 [电力, 乙证券, 2026-01-01]"
    assert name(None, None, None, None, None, None, None, "f.pdf") == "f.pdf"
    assert name(None, None, None, None, None, None, "电力", None) == "未知文档 [电力]"


def test_tables(spark):
    assert one(spark, tx.value_columns(F.col("t")), t="项目 | 2024A | 2025E") == ["2024A", "2025E"]
    assert one(spark, tx.value_columns(F.col("t")), t="2024A | 2025E") == ["2024A", "2025E"]
    unit = lambda i, u, v: one(spark, tx.indicator_unit(F.col("i"), F.col("u"), F.col("v")), i=i, u=u, v=v)
    assert [unit("毛利率", "百万元", "12"), unit("EPS", "", "1"), unit("PE", "", "9"), unit("营业收入", "百万元", "9"), unit("营业收入", "百万元", "9亿元"), unit("收入（亿元）", "", "3"), unit("x", "", "-")] == ["%", "元/股", "倍", "百万元", "", "亿元", ""]
    said = tx.narrative(F.col("c"), F.col("i"), F.col("v"), F.col("u"))
    assert one(spark, said, c="2025E", i="每股收益", v="1. 5", u="元/股") == "2025E 每股收益(EPS)为1.5元/股"
    assert one(spark, tx.units_are_valid(F.col("t")), t="PE为12亿元") is False


def test_queries(spark):
    assert one(spark, qf.compared(F.col("q")), q="甲公司和乙公司2025年谁更高") == ["甲公司", "乙公司"]
    assert one(spark, qf.compared(F.col("q")), q="甲公司收入") == []
    assert one(spark, qf.widened(F.col("q"), F.col("c")), q="毛利率风险", c="600001") == "毛利率风险 600001 盈利预测 财务 投资要点 风险提示 风险因素"
    subs = one(spark, qf.sub_queries(F.col("q")), q="甲公司和乙公司2025年净利润谁更高")
    assert [s["entity"] for s in subs] == ["甲公司", "乙公司"] and subs[0]["query"].startswith("甲公司 2025年 净利润")


def test_cache_text(spark):
    form = lambda q: one(spark, qf.cache_text(F.col("q")), q=q)
    base = form("中科飞测2025年EPS是多少？")
    assert form("请问中科飞测2025年每股收益是多少") == base == form("中科飞测2025年ＥＰＳ是多少?") == form("2025年中科飞测的EPS是多少")
    assert form("中科飞测2024年EPS是多少？") != base
    assert form(None) == "" and form("  ") == ""
    assert one(spark, qf.report_year(F.col("q")), q="从2024到2025年，20251") == "2025"
    for v in qf.PARAPHRASES:
        assert one(spark, qf.paraphrase(F.col("q"), F.lit(v)), q="甲公司2025年营业收入是多少？")


def test_merged_titles(spark):
    rows = [(["证券研究报告", "产能释放带动业绩，", "海外需求持续向好并超出此前预期", "投资要点"],), (["甲股份（600001）", "新品周期开启带动公司盈利能力持续改善提升", "短标题", "风险提示"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "t array<string>")
    got = [r[0] for r in df.select(tx.merged_titles(F.col("t"))).collect()]
    assert got == [["产能释放带动业绩，海外需求持续向好并超出此前预期", "投资要点"], ["新品周期开启带动公司盈利能力持续改善提升", "短标题"], [], []]


def test_paraphrases(spark):
    said = lambda q: {v: one(spark, qf.paraphrase(F.col("q"), F.lit(v)), q=q) for v in qf.PARAPHRASES}
    assert said("甲乙科技2025年每股收益是多少？") == {
        "polite_prefix": "请问甲乙科技2025年每股收益是多少？", "polite_tell": "请告诉我2025年甲乙科技的每股收益？", "synonym_metric": "甲乙科技2025年EPS是多少？", "word_order": "2025年甲乙科技EPS？"[:-1],
        "punctuation": "甲乙科技2025年每股收益是？", "filler_suffix": "甲乙科技2025年每股收益是多少（帮忙查一下）？",
    }
    assert said("请问风险吗？")["polite_prefix"] == "请问风险吗？" and said("请问风险吗？")["punctuation"] == "请问风险？" and said(None)["filler_suffix"] == "（帮忙查一下）？"


def test_compatibility_forms(spark):
    assert one(spark, qf.cache_text(F.col("q")), q="Ｐ／Ｅ①　甲") == "P/E1甲"
