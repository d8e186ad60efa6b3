import json
import random
import re

from pyspark.sql import functions as F

from millrace.operators import chunking, records
from millrace.plans.common import manifest, units

TOKEN = re.compile(r"[㐀-䶿一-鿿]|[A-Za-z0-9]+")
SCHEMA = "doc_id string, pos long, text string, section_title string, unit_type string, is_noise boolean, page_number int"
TABLE = "doc_id string, pos long, text string, section_title string, unit_type string, page_number int, table_caption string, table_header string, table_rows array<string>, table_footnote string, table_id string"


def size(text):
    return len(TOKEN.findall(text or ""))


def plain_groups(rows):
    """The packing rules, read one after the other: rows of (text, section, kind) -> lists of row indexes."""
    groups, current = [], []
    total = lambda g: sum(size(rows[i][0]) for i in g)
    for i, (text, section, kind) in enumerate(rows):
        if kind != "text":
            groups += [current] * bool(current) + [[i]]
            current = []
            continue
        if current and section != rows[current[-1]][1]:
            groups.append(current)
            current = []
        grown = total(current) + size(text)
        if current and (grown > 512 or (grown > 480 and total(current) >= 120)):
            groups.append(current)
            current = []
        current = [*current, i]
    groups += [current] * bool(current)
    merged = groups[:1]
    for g in groups[1:]:
        both_text = rows[g[0]][2] == "text" and rows[merged[-1][0]][2] == "text"
        if both_text and total(g) < 120 and total(merged[-1]) + total(g) <= 512 and rows[merged[-1][-1]][1] == rows[g[0]][1]:
            merged[-1] = merged[-1] + g
        else:
            merged.append(g)
    return merged


def test_packing_against_plain_rules(spark):
    rng = random.Random(2)
    docs = {f"d{d}": [("字" * rng.choice([5, 30, 60, 110, 200, 300, 470, 500]), rng.choice("ab"), rng.choice(["text"] * 6 + ["table", "noise"])) for _ in range(rng.randint(1, 40))] for d in range(30)}
    docs["short"] = [("字" * 470, "a", "text"), ("字" * 30, "a", "text")]
    rows = [(d, i, t, s, "table" if k == "table" else "paragraph", k == "noise", 1) for d, us in docs.items() for i, (t, s, k) in enumerate(us)]
    got = {}
    for r in chunking.pack_units(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        got.setdefault((r["doc_id"], r["group_no"]), []).append(r["pos"])
    for d, us in docs.items():
        assert [sorted(got[d, k]) for k in range(1, 1 + sum(1 for x, _ in got if x == d))] == plain_groups(us), d
    assert ("short", 2) not in got


def test_packing_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(d, i, "字" * 100, "a", "paragraph", None, None) for d in ("x", "y", None) for i in range(11)]
        packed = chunking.pack_units(spark.createDataFrame(rows, SCHEMA).where("doc_id IS NOT NULL").coalesce(1))
        assert {(r["doc_id"], r["pos"], r["group_no"]) for r in packed.collect()} == {(d, i, 1 + i // 4) for d in "xy" for i in range(11)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_oversized_units_come_in_pieces(spark):
    text = "。".join("字" * 90 for _ in range(15)) + "。"
    packed = chunking.pack_units(spark.createDataFrame([("d", 1, text, "a", "paragraph", False, 1), ("d", 2, "尾" * 20, "a", "paragraph", False, 1)], SCHEMA))
    rows = sorted((r["pos"], r["part"], size(r["text"]), r["group_no"]) for r in packed.collect())
    assert all(n <= 512 for _, _, n, _ in rows) and [p for _, p, _, _ in rows] == [1, 2, 3, 1] and rows[-1][3] == rows[-2][3]
    assert chunking.pack_units(spark.createDataFrame([], SCHEMA)).count() == 0


def told(spark, caption, header, rows, section="财务"):
    df = spark.createDataFrame([("d", 1, "表", section, "table", 1, caption, header, rows, None, "t")], TABLE)
    return [r["narrative"] for r in records.narratives(df, "pos").collect()]


def test_what_tables_say(spark):
    assert told(spark, "利润表", "指标|A|B", ["净利润|12|34|56"]) == []
    assert told(spark, "利润表（亿元）", "指标|2024A|2025E", ["2024A|1|2", "净利润|12|34|56", "营业收入|-|5"]) == ["2024A 净利润为12亿元；2025E 净利润为34亿元；2025E 营业收入为5亿元"]
    assert told(spark, "表", "公司|EPS|PE", ["x|2023A|2024E|2025E|2026E", "甲|1|2|3|4"]) == []
    assert told(spark, "可比公司", "代码|名称|价|2024A|2025E|2026E|2024A|2025E|2026E", ["600000.SH|甲|9|1|2|3|10|20|30"]) == ["甲 2024A EPS为1元/股；甲 2025E EPS为2元/股；甲 2026E EPS为3元/股；甲 2024A PE为10倍；甲 2025E PE为20倍；甲 2026E PE为30倍"]
    assert told(spark, "产品", "单位|2024A", ["芯片", "营收|亿元|3.5"]) == ["2024A 芯片营收为3.5亿元"]


def test_table_parts_stay_within_their_budget(spark, folder):
    tables = records.table_chunks(units(spark, folder).withColumn("is_noise", F.lit(False)), manifest(spark, folder), 120)
    rows = tables.collect()
    assert rows and all(size(r["embedding_text"]) <= max(120, size(r["embedding_text"].split("\n\n")[0]) + 64) for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["pos"]), []).append((r["table_part_index"], r["table_part_count"]))
    assert all(sorted(v) == [(i, len(v)) for i in range(1, len(v) + 1)] for v in by.values())


def test_records_of_whole_documents(spark, folder):
    rows = records.document_chunks(units(spark, folder), manifest(spark, folder)).collect()
    kinds = {r["content_type"] for r in rows}
    assert {"text", "table", "noise", "rating_headline"} <= kinds and len(rows[0]) == 33
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    assert all(r["contains_table"] == (r["content_type"] == "table") and r["char_count"] == len(r["text"]) for r in rows)
    assert all(r["is_retrievable"] or r["content_type"] == "noise" for r in rows)
    numbers = {}
    for r in rows:
        if not r["chunk_id"].endswith("_rating_headline"):
            numbers.setdefault(r["doc_id"], []).append(int(r["chunk_id"].rsplit("_", 1)[1]))
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())


def test_appendices_are_merged(spark):
    rows = [("d", i, 1, s, f"文{i}", f"嵌{i}", "text", keep, [i], 1, ["p"]) for i, (s, keep) in enumerate([("正文", True), ("附录一", True), ("附录二", True), ("附录三", False), ("三大报表", True), ("正文", True)], 1)]
    df = spark.createDataFrame(rows, "doc_id string, pos long, part int, section_title string, text string, embedding_text string, content_type string, is_retrievable boolean, pdf_page_numbers array<int>, unit_count long, unit_types array<string>")
    got = sorted((r["pos"], r["text"], r["pdf_page_numbers"], r["unit_count"]) for r in records.merged_appendices(df).collect())
    assert got == [(1, "文1", [1], 1), (2, "文2\n文3", [2, 3], 2), (4, "文4", [4], 1), (5, "文5", [5], 1), (6, "文6", [6], 1)]


def test_parsed_items(spark):
    span = lambda *texts: [{"type": "text", "content": t} for t in texts]
    link = {"type": "hyperlink", "content": "", "children": span("链", "接")}
    items = [
        ("paragraph", {"paragraph_content": [*span("净利润", "增长"), {"type": "equation_inline", "content": "x^2"}, link]}, "净利润增长x^2链接"),
        ("table", {"table_caption": span("利润表"), "html": "<table><tr><td>单位：亿元</td></tr><tr><td>指标</td><td>2024A</td></tr><tr><td>营收</td><td>5</td></tr></table>", "table_footnote": span("注")}, None),
        ("chart", {"chart_caption": span("图1"), "content": "上升", "chart_footnote": None}, "图1\n上升"), ("list", {"list_items": ["一", "二"]}, "一\n二"), ("index", {"index_items": span("甲", "乙")}, "甲\n乙"),
        ("equation_interline", {"math_content": "a+b"}, "a+b"), ("equation_interline", {"math_content": span("c")}, "c"), ("code", {"code_caption": span("标"), "code_content": span("x=1")}, "标\nx=1"), ("title", {"title_content": span("[Table_Title]标题")}, "标题"), ("paragraph", {}, ""),
    ]
    rows = [(i, kind, json.dumps(content, ensure_ascii=False)) for i, (kind, content, _) in enumerate(items)] + [(90, "paragraph", "平文"), (91, "paragraph", None)]
    got = {r["k"]: r for r in chunking.parsed_items(spark.createDataFrame(rows, "k int, type string, content string")).collect()}
    assert {k: r["text"] for k, r in got.items() if k != 1} == {i: t for i, (_, _, t) in enumerate(items) if i != 1} | {90: "平文", 91: ""}
    table = got[1]
    assert table["table_caption"] == "利润表" and table["table_footnote"] == "注" and table["table_header"].startswith("指标 | 2024A") and [x.split(" | ")[0] for x in table["table_rows"]] == ["营收"]
    assert table["text"].startswith("利润表\n单位：亿元") and table["text"].endswith("注")
