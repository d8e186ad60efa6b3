import random
import re
import time
from collections import Counter

import pyarrow as pa

from millrace.llm import truncation

SENTENCES = ["公司产品收入同比增长{}%，主要因海外渠道放量。", "需求端，毛利率提升至{}%，后续关注新品进展。", "存量项目的投资回收期缩短至{}年，全年指引不变。", "管理层认为下游补库将延续到{}Q1，弹性取决于成本。"]


def corpus():
    rows = [(i, "\n".join(s.format(10 + i + k) for k, s in enumerate(SENTENCES)) + f"\n图表{i}：产品毛利率走势", f"标题{i}：毛利率提升至{i}%", "a") for i in range(30)]
    rows += [(i + 100, f"标题{i}：毛利率提升至{i}%\n" + SENTENCES[i % 4].format(i), f"标题{i}：毛利率提升至{i}%", "b") for i in range(20)]
    return rows


CUT = {
    900: "公司产品收入同比增长7%，主要因海外渠道放", 901: "需求端，毛利率提升至5%，后续关注新…", 902: "存量项目的投资回收期缩短至12", 903: "需求端，毛利率提升至5%，后续关注新品进�",
    904: "管理层认为下游补库将延续到26Q1，弹性取（北方", 905: "存量项目的投资回收期缩\n<tr><td>营业收入</td><t",
}
WHOLE = {
    950: "公司产品收入同比增长7%，主要因海外渠道放量。", 951: "", 952: None, 953: " \n　", 954: "图表31：产品毛利率走势", 955: "标题77：毛利率提升至7%", 956: "拐点到了吗？", 957: "全新的句子没有任何出处",
    958: "公司产品收入同比增长7%，主要因海外渠道放量。\n故事还在继续……", 959: "很长的文字" * 20_000,
}


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, fragment string")
    return {r[0] for r in truncation.truncated(df, "doc_id", "text", "title").select("doc_id").collect()}


def test_cut_and_whole_texts(spark):
    rows = corpus() + [(i, t, None, None) for i, t in (CUT | WHOLE).items()]
    rows[-5] = (955, WHOLE[955], WHOLE[955], None)
    assert found(spark, rows) == set(CUT)


def test_repeated_texts_count_each(spark):
    rows = corpus() + [(900, CUT[900], None, None), (901, CUT[900], None, None)]
    assert found(spark, rows) == {900, 901}


def test_whole_text_with_longer_copy(spark):
    long = "前言" + "文字内容各不相同甲乙丙丁戊己庚辛" * 12 + "结束。"
    df = spark.createDataFrame([(1, long), (2, long[:100]), (3, long[:40]), (4, long), (5, "前"), (6, "结"), (7, long[:50] + "\n别的")], "key long, text string")
    assert {tuple(r) for r in truncation.longer_copies(df, df).collect()} == {(2, True), (3, True), (5, True)}
    lines = spark.createDataFrame([(1, "标题一\n正文"), (2, "标题一"), (3, "标题一 \n正文"), (4, "标"), (5, "标题一\n正")], "key long, text string")
    assert {tuple(r) for r in truncation.longer_copies(lines, lines).collect()} == {(2, False), (4, True), (5, True)}


def test_longer_copies_against_brute_force(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("ab\n") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    want = {(i, any(y[len(x)] != "\n" for y in texts if len(y) > len(x) and y.startswith(x))) for i, x in enumerate(texts) if any(len(y) > len(x) and y.startswith(x) for y in texts)}
    assert {tuple(r) for r in truncation.longer_copies(df, df).collect()} == want


def test_scan_against_plain_splitting():
    texts = [truncation.masked(t) for t in ("公司A，营收3.5亿元。\n表1：a. b，12", "x", "\n\n尾行。 ", "增长12\n下行 9", "a.\n b.. \n12")]
    runs, heads = Counter(), Counter()
    for t in texts:
        parts, at = [], 0
        for m in truncation._STRETCH_END.finditer(t):
            parts.append(t[at : m.end()])
            at = m.end()
        runs.update(parts)
        for line in filter(None, t.split("\n")):
            bare = line.rstrip(truncation._BLANKS)
            running = "\x02" if re.search(r"(?:[。！？!?；]|\. )(?=.*\S)", bare) else ""
            for head in {line[:4], running + line[:4]}:
                heads[head, re.search(r"(?:[。！？!?”」』]|[^\s.…]\.)\Z", bare) is None] += 1
    out = pa.Table.from_batches(truncation._scan([pa.record_batch({"text": texts})])).to_pylist()
    assert {r["run"]: r["n"] for r in out if r["run"] is not None} == dict(runs)
    want = {h: (heads[h, True] + heads[h, False], heads[h, True]) for h, _ in heads}
    assert {r["head"]: (r["n"], r["n_open"]) for r in out if r["head"] is not None} == want


def test_long_texts_cost_their_length():
    run = "".join(chr(0x4E00 + i % 5000) for i in range(160_000))
    seconds = []
    for n in (80_000, 160_000):
        began = time.perf_counter()
        rows = pa.Table.from_batches(truncation._continuations([pa.record_batch({"run": [run[:n]], "n": [1]})]))
        seconds.append(time.perf_counter() - began)
        assert rows.num_rows == n - 1 + 5000
    assert seconds[1] < 5 * seconds[0] + 0.5


def test_hot_header_of_many_lengths(spark):
    # a third of the texts share one header, which others end in at many lengths
    header = "".join(chr(0x4E00 + 37 * i % 9000) for i in range(600))
    rows = [(i, header + f"后文各异{i}号") for i in range(300)] + [(1000 + i, header[: 50 + i]) for i in range(500)]
    df = spark.createDataFrame(rows, "key long, text string")
    assert {r["key"] for r in truncation.longer_copies(df, df).where("in_line").collect()} == set(range(1000, 1500))


def test_empty(spark):
    assert found(spark, []) == set()


def test_copies_of_a_cut_text_are_no_votes(spark):
    cut_often = [(2000 + i, "公司产品收入同比增长7%，主要因海外渠道放", None, None) for i in range(80)]
    assert found(spark, corpus() + cut_often) == {r[0] for r in cut_often}


def test_copies_keep_their_own_titles(spark):
    text = "公司产品收入同比增长7%，主要因海外渠道放"
    assert found(spark, corpus() + [(900, text, text, None), (901, text, None, None), (902, text, text, None)]) == {901}


def test_fragment_seen_at_text_ends_only(spark):
    # two cut texts end in one fragment that no other text has; what follows its last letters decides
    rows = corpus() + [(900, "其一，全新看法是海外渠道放", None, None), (901, "其二，全新看法是海外渠道放", None, None)]
    assert found(spark, rows) == {900, 901}


def test_longer_whole_copy_proves_a_cut(spark):
    # the longer texts go on within their own unended last stretch, which no run holds
    opening = "一份没有任何别处出现的开场白" * 5
    short, table, source = "独一无二甲乙丙", "2023E | 12", "数据来源：公司"
    rows = [(3001, opening + "丁戊己庚辛壬癸", None, None), (3002, opening + "丁戊", None, None), (3003, short + "丁戊己庚", None, None), (3004, short, None, None), (3005, short, None, None)]
    whole = [(3006, table + ".5 | 3", None, None), (3007, table, None, None), (3008, source + "公告", None, None), (3009, source, None, None), (3010, "独立标题\n下文别处", None, None), (3011, "独立标题", None, None), (3012, "题名甲乙", "题名甲乙", None), (3013, "题名甲乙丙丁", None, None)]
    whole += [(3020 + i, f"202{i}E | {i}.5 | 8", None, None) for i in range(4)]
    assert found(spark, corpus() + rows + whole) == {3002, 3004, 3005}


def test_longer_copies_of_hot_heads(spark):
    # the heads of these lines mostly end open, which is no proof against a longer copy
    rows = [(2000 + i, f"同样开头的句子乙{chr(0x4E00 + 7 * i)}某", None, None) for i in range(12)] + [(3500, "同样开头的句子乙", None, None)]
    assert 3500 in found(spark, corpus() + rows)
