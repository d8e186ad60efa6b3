import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, cache, chunking, evidence, metrics, models, records, retrieval


def test_lexical_search_against_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(98, None), (99, "")]
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "aa bb aa"), (2, "zz"), (3, None), (4, "hh")], "query_id long, query string")
    index = retrieval.LexicalIndex(corpus, "doc_id", "text")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in index.search(queries, "query_id", "query", 100).collect()}
    bags = {i: (t or "").split() for i, t in docs}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df = {t: sum(t in b for b in bags.values()) for b in bags.values() for t in b}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    avg = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * avg for t, v in raw.items()}
    for q, text in ((1, "aa bb aa"), (4, "hh")):
        for i, b in bags.items():
            want = round(sum(idf[t] * b.count(t) * 2.5 / (b.count(t) + 1.5 * (0.25 + 0.75 * len(b) / mean)) for t in text.split() if t in b), 6)
            assert got.get((q, i), 0) == pytest.approx(max(want, 0), abs=2e-6)
    assert not [k for k in got if k[0] in (2, 3)]


def test_tokens(spark):
    df = spark.createDataFrame([("净利润EPS 12.5%",), ("我",), (None,)], "t string")
    assert [r[0] for r in df.select(retrieval.tokens(F.col("t"))).collect()] == [["净利", "利润", "eps", "12", "5"], ["我"], []]


def test_dense_and_fusion(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "vec_id long, v array<double>")
    got = retrieval.dense_topk(vectors.where("vec_id = 0"), vectors, "vec_id", "vec_id", "v", 5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [1, 2]
    dense = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0), (2, "x", 3.0)], "query_id int, chunk_id string, score double")
    lexical = spark.createDataFrame([(1, "b", 9.0), (1, "c", 1.0)], "query_id int, chunk_id string, score double")
    fused = {(r["query_id"], r["chunk_id"]): (r["score"], r["rank"]) for r in retrieval.weighted_fusion(dense, lexical, 5).collect()}
    assert fused == {(1, "b"): (0.65, 1), (1, "a"): (0.35, 2), (1, "c"): (0.0, 3), (2, "x"): (0.35, 1)}
    lists = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "b", 1)], "query_id int, list_id int, chunk_id string, rank int")
    assert [r["chunk_id"] for r in retrieval.reciprocal_rank_fusion(lists, 2).orderBy("rank").collect()] == ["b", "a"]


def hit(i, score=0.5, **kw):
    base = {"query_id": 1, "chunk_id": f"c{i}", "hit_id": i, "rank": i, "score": score, "score_rerank": score, "company_name": "甲", "section_title": "正文", "text": "文" * 60, "page_start": 3, "page_end": 3, "display_name": "甲报告", "doc_id": "d", "stock_code_hit": "600001", "passage": "文" * 60, "score_selected": score}
    return base | kw


@pytest.mark.parametrize(
    ("change", "query", "reason"),
    [
        ({}, {}, ""), ({"score_rerank": 0.2}, {}, "low_rerank_score"), ({"score_rerank": 0.35}, {}, ""), ({"passage": "短"}, {}, "insufficient_passage"),
        ({"page_start": None, "display_name": "", "doc_id": ""}, {}, "missing_source_page"), ({}, {"stock_code": "999999"}, "stock_mismatch"), ({}, {"stock_code": "600001"}, ""),
        ({}, {"query_type": "comparative"}, "comparative_insufficient"), ({"section_title": "评级说明", "score_selected": 0.1}, {}, "weak_evidence_intent"), (None, {}, "no_hits"),
    ],
)
def test_gate(spark, change, query, reason):
    schema = "query_id int, chunk_id string, hit_id int, rank int, score double, score_rerank double, company_name string, section_title string, text string, page_start int, page_end int, display_name string, doc_id string, stock_code_hit string, passage string, score_selected double"
    rows = [] if change is None else [hit(1) | change]
    hits = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    q = {"query_id": 1, "query": "甲公司情况", "query_type": "factual", "stock_code": "", "names": 0} | query
    queries = spark.createDataFrame([tuple(q.values())], "query_id int, query string, query_type string, stock_code string, names int")
    out = evidence.gate(queries, hits).first()
    assert out["reason"] == reason and out["passed"] == (reason == "") and len(out["checks"]) == 7


def test_comparative_quota_covers_both(spark):
    rows = [(1, f"a{i}", "甲公司", 1 - i / 100) for i in range(10)] + [(1, f"b{i}", "乙公司", 0.5 - i / 100) for i in range(10)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id string, company_name string, score_rerank double")
    names = spark.createDataFrame([(1, 0, "甲"), (1, 1, "乙")], "query_id int, pos int, entity string")
    out = [r["chunk_id"] for r in evidence.comparative_quota(hits, names, 5).orderBy("rank").collect()]
    assert out == ["a0", "a1", "b0", "b1", "a2"]


def test_selection_keeps_sections_apart(spark):
    rows = [(1, i, f"c{i}", i + 1, s, 1.0 - i / 10) for i, s in enumerate(["A", "A", "A", "B", None])]
    hits = spark.createDataFrame(rows, "query_id int, hit_id int, chunk_id string, rank int, section_title string, score_selected double")
    assert [r["hit_id"] for r in evidence.select_evidence(hits, 4).orderBy("place").collect()] == [0, 1, 3, 4]
    assert [r["hit_id"] for r in evidence.select_evidence(hits.where("section_title = 'A'"), 3).orderBy("place").collect()] == [0, 1, 2]


FACTS = {"stock_code": "600000", "query_type": "factual", "company_name": "甲公司", "report_year": "2025", "doc_id": "", "doc_version": "v", "index_fingerprint": "i", "config_fingerprint": "c", "generation_fingerprint": "g", "metadata": "m", "scope": "chat", "refused": False, "chunk_ids": ["x"]}


def known(df):
    """``df`` with everything that a lookup compares."""
    as_column = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return df.withColumns({c: as_column(v) for c, v in FACTS.items() if c not in df.columns})


def test_rejections(spark):
    cases = {
        "stock_code_mismatch": {"stock_code": "600001"}, "query_type_mismatch": {"query_type": "summary"}, "metadata_missing": {"metadata": None}, "company_mismatch": {"company_name": "乙公司"}, "report_year_mismatch": {"report_year": ""},
        "doc_version_mismatch": {"doc_version": "w"}, "index_fingerprint_mismatch": {"index_fingerprint": "j"}, "config_fingerprint_mismatch": {"config_fingerprint": "d"}, "generation_fingerprint_mismatch": {"generation_fingerprint": "h"},
        "chunk_missing": {"chunk_ids": ["gone"]}, "": {"company_name": "甲公司集团"},
    }
    entry = lambda i, change: {"entry_id": i, "storage_key": f"k{i}", "bucket": f"b{i}", "vector": [1.0, 0.0], "ttl_s": 3600, **FACTS, **change}
    schema = "entry_id int, storage_key string, bucket string, vector array<double>, ttl_s int, " + ", ".join(f"{c} {'boolean' if c == 'refused' else 'array<string>' if c == 'chunk_ids' else 'string'}" for c in FACTS)
    entries = spark.createDataFrame([tuple(entry(i, c).values()) for i, c in enumerate(cases.values())], schema).withColumn("created_at", F.to_timestamp(F.lit("2026-01-01 00:30:00")))
    requests = known(spark.range(len(cases)).select(F.col("id").cast("int").alias("request_id"), F.format_string("k%d", "id").alias("storage_key"), F.lit("none").alias("bucket"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector")))
    registry = spark.createDataFrame([("x",)], "chunk_id string")
    now = F.to_timestamp(F.lit("2026-01-01 01:00:00"))
    got = {r["request_id"]: (r["layer"], r["reason"]) for r in cache.two_level_lookup(requests, entries, now, registry).collect()}
    assert got == {i: ("miss", reason) if reason else ("L1", "") for i, reason in enumerate(cases)}
    near = requests.withColumn("storage_key", F.lit("other")).withColumn("bucket", F.format_string("b%d", "request_id")).withColumn("vector", F.array(F.lit(1.0), F.lit(0.9)))
    got = {r["request_id"]: (r["layer"], r["reason"]) for r in cache.two_level_lookup(near, entries, now, registry).collect()}
    late = ("", "chunk_missing")
    assert got == {i: ("miss", "similarity_below_threshold" if reason in late else reason) for i, reason in enumerate(cases)}
    assert cache.two_level_lookup(requests.limit(0), entries, now, registry).count() == 0


def test_keys_hold_what_an_answer_depends_on(spark):
    one = lambda **kw: spark.range(1).select(cache.storage_key(*[F.lit({"scope": "chat", "q": "甲公司净利润", "c": "c", "i": "i", "g": "g", "m": "m", **kw}[k]) for k in ("scope", "q", "c", "i", "g", "m")])).first()[0]
    assert len({one(), one(c="d"), one(i="j"), one(g="h"), one(m="n"), one(scope="search"), one(q="乙公司净利润")}) == 7
    assert one() == one(q="请问甲公司的净利润是多少？") and one(scope="search", g="g") == one(scope="search", g="h")
    meta = spark.range(1).select(cache.metadata_fingerprint(F.lit(None).cast("string"), F.lit(""), F.lit("甲"), F.lit("2025"))).first()[0]
    assert meta == "stock=-|qtype=factual|co=甲|yr=2025|doc=-|ver=-"


def test_relevance_branches(spark):
    hit = {"chunk_id": "c", "stock_code": "1", "doc_id": "d", "industry_label": "电力", "section_title": "盈利预测", "embedding_text": "", "text": "净利润为12.5亿元", "display_name": "", "company_name": "", "report_title": "", "broker": "", "rating": "买入"}
    ask = {"query_type": "factual", "category": "", "stock_code": "1", "doc_id": "", "industry_label": "", "negative_stock_codes": None, "gold_chunk_ids": None, "section_keywords": None, "must_contain_any": None}
    cases = [
        ({}, {}, True), ({}, {"negative_stock_codes": ["1"], "gold_chunk_ids": ["c"]}, False), ({}, {"stock_code": "2", "gold_chunk_ids": ["c"]}, True), ({}, {"stock_code": "2"}, True), ({}, {"stock_code": "2", "doc_id": "e"}, False),
        ({}, {"must_contain_any": ["12.5"]}, True), ({}, {"must_contain_any": ["99"]}, False), ({}, {"must_contain_any": ["归母净利润"]}, True), ({}, {"must_contain_any": ["99"], "category": "rating"}, True), ({"rating": ""}, {"must_contain_any": ["99"], "category": "rating"}, False),
        ({}, {"query_type": "summary", "stock_code": "", "industry_label": "半导体"}, False), ({}, {"query_type": "summary", "stock_code": "", "industry_label": "电力", "section_keywords": ["评级"]}, True), ({"rating": ""}, {"query_type": "summary", "stock_code": "", "section_keywords": ["风险"]}, False),
        ({"stock_code": ""}, {"stock_code": "", "section_keywords": ["风险"], "must_contain_any": ["净利润"]}, True), ({"stock_code": None, "text": None}, {"stock_code": "1", "doc_id": "d", "must_contain_any": ["x"]}, False),
    ]
    kind = lambda c: "array<string>" if c in ("negative_stock_codes", "gold_chunk_ids", "section_keywords", "must_contain_any") else "string"
    hits = spark.createDataFrame([(i, *(hit | h).values()) for i, (h, _, _) in enumerate(cases)], "k int, " + ", ".join(f"{c} string" for c in hit))
    asks = spark.createDataFrame([(i, *(ask | q).values()) for i, (_, q, _) in enumerate(cases)], "k int, " + ", ".join(f"{c} {kind(c)}" for c in ask))
    got = {r[0]: r[1] for r in hits.alias("h").join(asks.alias("q"), F.col("h.k") == F.col("q.k")).select("h.k", metrics.relevant("h", "q")).collect()}
    # without a stock code to differ from, the empty document of the question fits
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_compared_names_come_first(spark):
    rows = [(1, f"c{i}", i, s, "段", n, "", n, ["甲方", "乙方"]) for i, (s, n) in enumerate([(0.9, "丙方"), (0.8, "丙方"), (0.7, "甲方"), (0.6, "甲方"), (0.5, "乙方")], 1)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, score_selected double, section_title string, company_name string, display_name string, passage string, names array<string>")
    got = [r["chunk_id"] for r in evidence.select_evidence(df, 4).orderBy("place").collect()]
    assert got == ["c3", "c5", "c1", "c2"]


def test_cache(spark):
    rows = [(1, "k", "b", [1.0, 0.0], "2026-01-01 00:00:00", 3600), (2, "k", "b", [0.9, 0.1], "2026-01-01 00:30:00", 3600), (3, "x", "c", [1.0, 0.0], None, 3600), (4, "z", "b", [0.0, 1.0], "2026-01-01 00:59:00", 0)]
    entries = known(spark.createDataFrame(rows, "entry_id int, storage_key string, bucket string, vector array<double>, at string, ttl_s int").withColumn("created_at", F.to_timestamp("at")))
    now = F.to_timestamp(F.lit("2026-01-01 01:00:00"))
    requests = known(spark.createDataFrame([(1, "k", "b", [1.0, 0.0]), (2, "n", "b", [1.0, 0.05]), (3, "n", "c", [1.0, 0.0])], "request_id int, storage_key string, bucket string, vector array<double>"))
    out = {r["request_id"]: (r["layer"], r["entry_id"]) for r in cache.two_level_lookup(requests, entries, now).collect()}
    assert out == {1: ("L1", 2), 2: ("L2", 2), 3: ("miss", None)}  # entry 1 is exactly as old as its time to live
    kept = cache.keep_recent(entries.withColumn("scope", F.lit("s")), now, 1, "created_at")
    assert [r["entry_id"] for r in kept.collect()] == [2]
    e = spark.createDataFrame([(1, "s", "f", ["d1", "d2"]), (2, "t", "f", ["d3"]), (3, "s", "f", None)], "entry_id int, scope string, index_fingerprint string, entry_docs array<string>")
    d = spark.createDataFrame([("d2",), ("d3",)], "doc_id string")
    assert {r["entry_id"] for r in cache.invalidate(e, doc_ids=d).collect()} == {3}
    assert {r["entry_id"] for r in cache.invalidate(e, scope="s", doc_ids=d).collect()} == {2, 3}
    assert {r["entry_id"] for r in cache.invalidate(e, scope="s").collect()} == {2}


def test_metrics(spark):
    q = spark.createDataFrame([(1, "f"), (2, "f")], "query_id int, query_type string")
    h = spark.createDataFrame([(1, 2, True), (1, 7, True), (1, 1, False)], "query_id int, rank int, relevant boolean")
    out = {r["query_id"]: r for r in metrics.per_question(q, h).collect()}
    assert out[1]["mrr"] == 0.5 and out[1]["precision_at_5"] == 0.2 and out[1]["precision_at_10"] == 0.2 and out[1]["recall_at_3"] == 1
    assert out[2]["mrr"] == 0 and out[2]["first"] is None
    values = [5.0, 1.0, 3.0, 3.0, 9.0, 7.0, 2.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("h", 4.0)], "g string, v double")
    for p in (1, 50, 95, 100):
        want = {"g": sorted(values)[max(0, min(len(values) - 1, int(len(values) * p / 100) - 1))], "h": 4.0}
        assert {r["g"]: r["v"] for r in metrics.ranked_percentile(df, "g", "v", p).collect()} == want
        assert {r["g"]: r["x"] for r in df.groupBy("g").agg(metrics.index_percentile("v", p).alias("x")).collect()} == want
    nan = spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "v double").agg(metrics.mean("v").alias("m")).first()["m"]
    assert nan == 2.0
    t = spark.createDataFrame([("2件60台", ["260"]), ("abc", ["x"]), ("abc", []), (None, ["x"])], "t string, w array<string>")
    assert [r[0] for r in t.select(metrics.any_token(F.col("t"), F.col("w"))).collect()] == [True, False, True, False]


def test_packing(spark):
    rows = [("d", i, "字" * n, s, k, z, 1) for i, (n, s, k, z) in enumerate([(100, "A", "paragraph", False), (300, "A", "paragraph", False), (100, "A", "paragraph", False), (10, "A", "table", False), (10, "B", "paragraph", True), (10, "B", "paragraph", None), (10, "B", "paragraph", False)])]
    units = spark.createDataFrame(rows, "doc_id string, pos int, text string, section_title string, unit_type string, is_noise boolean, page_number int")
    got = [r["group_no"] for r in chunking.pack_units(units).orderBy("pos").collect()]
    assert got == [1, 1, 1, 2, 3, 4, 4]  # 100 tokens are under the least size of a group and join the one before
    chunks = chunking.chunk_groups(chunking.pack_units(units))
    assert chunks.agg(F.sum("unit_count")).first()[0] == 7 and chunks.agg(F.max("token_count")).first()[0] <= chunking.HARD_MAX
    assert chunking.pack_units(units.limit(0)).count() == 0


def test_split_budget():
    text = "一句话。" * 50 + "\n" + "长" * 300 + "\n短。"
    parts = chunking.split_budget(text, 60, 10)
    assert all(len([c for c in p if "一" <= c <= "鿿"]) <= 60 for p in parts)
    assert chunking.split_budget("短。", 60, 10) == ["短。"]


def test_islands_and_carry(spark):
    rows = [("d", i, k, t) for i, (k, t) in enumerate([("title", "甲"), ("table", "1"), ("table", "2"), ("paragraph", "x"), ("title", "乙"), ("table", "3"), ("page_number", "9")])]
    items = spark.createDataFrame(rows, "doc_id string, pos int, type string, content string").withColumn("page", F.lit(1))
    units = {r["pos"]: (r["section_title"], r["table_id"]) for r in chunking.units_of(items).collect()}
    assert units == {0: ("甲", ""), 1: ("甲", "d_t01"), 2: ("甲", "d_t02"), 3: ("甲", ""), 4: ("乙", ""), 5: ("乙", "d_t03")}
    merged = chunking.merge_islands(chunking.islands(items, "doc_id", "pos", F.col("type") == "table"), "doc_id", "pos", "content")
    assert sorted(r["content"] for r in merged.collect()) == ["1\n2", "3", "9", "x", "乙", "甲"]


def test_audit(spark):
    df = spark.createDataFrame([("a" * 900,), ("b",), (None,)], "t string")
    assert [len(r[0] or "") for r in audit.hit_rows(df.selectExpr("1 request_id", "'s' stage", "1 rank", "'c' chunk_id", "'d' doc_id", "1.0 score", "t text")).select("text_preview").collect()] == [800, 1, 0]


def test_index_is_saved_and_loaded(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "净利润增长"), (2, "毛利率下降"), (3, "净利润下降")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "净利润")], "query_id long, query string")
    index = retrieval.LexicalIndex(corpus, "doc_id", "text")
    index.save(str(tmp_path))
    again = retrieval.LexicalIndex.load(spark, str(tmp_path))
    assert sorted(map(tuple, again.search(queries, "query_id", "query", 5).collect())) == sorted(map(tuple, index.search(queries, "query_id", "query", 5).collect()))


def test_tables_as_text(spark):
    rows = [
        (1, "可比公司估值", "名称 | 代码 | 价 | 2024A | 2025E | 2026E | 2024A | 2025E | 2026E", ["600001.SH | 甲 | 9 | 1 | 2 | 3 | 10 | 20 | 30", "可比公司均值 | 1 | 2 | 3 | 4 | 5 | 6"]),
        (2, "分产品", "单位 | 2024A | 2025E", ["芯片", "营收 | 百万元 | 5 | 6", "毛利率 | % | 7 | -"]),
        (3, "盈利预测（百万元）", "项目 | 2024A | 2025E", ["营业收入 | 1 0 | 20", "PE | 3 | 4"]),
        (4, "基本情况", "项目 | 值", ["总市值（亿元） | 12"]),
    ]
    tables = spark.createDataFrame(rows, "k int, table_caption string, table_header string, table_rows array<string>").withColumn("section_title", F.lit(""))
    said = {r["k"]: r["narrative"] for r in records.narratives(tables, "k").collect()}
    assert said[1] == "甲 2024A EPS为1元/股；甲 2025E EPS为2元/股；甲 2026E EPS为3元/股；甲 2024A PE为10倍；甲 2025E PE为20倍；甲 2026E PE为30倍；可比公司均值 2024A EPS为1元/股；可比公司均值 2025E EPS为2元/股；可比公司均值 2026E EPS为3元/股；可比公司均值 2024A PE为4倍；可比公司均值 2025E PE为5倍；可比公司均值 2026E PE为6倍"
    assert said[2] == "2024A 芯片营收为5百万元；2025E 芯片营收为6百万元；2024A 芯片毛利率为7%"
    assert said[3] == "2024A 营业收入为10百万元；2025E 营业收入为20百万元；2024A PE为3倍；2025E PE为4倍"
    assert 4 not in said  # a table without years has no reading


def test_table_parts(spark):
    rows = [(1, ["一二三"] * 5, 4), (2, ["一" * 50], 4), (3, [], 4), (4, None, 4)]
    tables = spark.createDataFrame(rows, "k int, table_rows array<string>, context_tokens int")
    got = {}
    silent = spark.createDataFrame([], "k int, row_no int, column_no int, sentence string")
    for r in records.table_parts(tables, "k", silent, 10).orderBy("k", "part_index").collect():
        got.setdefault(r["k"], []).append((r["part_index"], r["part_count"], len(r["rows"] or [])))
    assert got == {1: [(1, 3, 2), (2, 3, 2), (3, 3, 1)], 2: [(1, 1, 1)], 3: [(1, 1, 0)], 4: [(1, 1, 0)]}
    said = spark.createDataFrame([(1, i, 0, "句" * 6) for i in range(5)], "k int, row_no int, column_no int, sentence string")
    told = {r["part_index"]: (len(r["rows"]), r["narrative"]) for r in records.table_parts(tables.where("k = 1"), "k", said, 10).collect()}
    assert told == {i: (1, "句" * 6) for i in range(1, 6)}


def test_encoder_and_codec(spark):
    df = spark.createDataFrame([(1, "净利润增长"), (2, None), (3, "")], "k int, t string")
    v = {r["k"]: r["v"] for r in df.select("k", models.embed(F.col("t"), prefix="query: ").alias("v")).collect()}
    assert v[2] is None and sum(x * x for x in v[1]) == pytest.approx(1, abs=1e-5)
    payload = '{"citations":[{"chunk_id":"b"}],"recall_hits":[{"chunk_id":"a"},{"chunk_id":"b"},{"chunk_id":""}]}'
    ids = spark.createDataFrame([(payload,), ("{",), (None,)], "p string").select(cache.payload_chunk_ids(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in ids] == [["b", "a"], [], []]
    assert spark.range(1).select(cache.entry_from_json(F.lit('{"version":2,"query":"x"}')).alias("e")).first()["e"] is None
