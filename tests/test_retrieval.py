import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import query as qf
from millrace.operators import retrieval
from millrace.sources.tables import table


def vectors(n, seed=1, size=8):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-1, 1) for _ in range(size)]) for i in range(n)]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_dense_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 7)
    monkeypatch.setattr(retrieval, "VECTOR_ROWS", 11)
    rows = vectors(90) + [(90, vectors(1)[0][1]), (91, [0.0] * 8), (92, None), (93, []), (94, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for blocks in (64, 1):
        got = {}
        for r in retrieval.dense_topk(df.where("id % 3 = 0"), df, "id", "id", "v", 5, max_blocks=blocks).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"]))
        for i, v in rows[:91:3]:
            best = sorted(((round(cosine(v, w), 6), j) for j, w in rows[:91] if j != i), key=lambda x: (-x[0], x[1]))[:5]
            assert [(j, s) for _, j, s in sorted(got[i])] == [(j, s) for s, j in best]
        assert not {91, 92, 93, 94} & set(got)


def test_tokens(spark):
    rows = [("净利润EPS12.5", ["净利", "利润", "eps12", "5"]), ("a中b", ["a", "中", "b"]), ("", []), (None, []), ("中文。文", ["中文", "文"]), ("㐀一", ["㐀一"])]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(retrieval.tokens(F.col("t"))).collect()] == [w for _, w in rows]


def test_postings_are_the_tokens_counted(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    index = retrieval.LexicalIndex(docs, "doc_id", "text")
    bags = docs.select(F.col("doc_id").alias("chunk_id"), retrieval.tokens(F.col("text")).alias("t"))
    want = {tuple(r) for r in bags.select("chunk_id", F.explode("t").alias("token")).groupBy("token", "chunk_id").count().collect()}
    assert {tuple(r) for r in index.postings.collect()} == want and len(want) > 100
    assert {tuple(r) for r in index.lengths.collect()} == {tuple(r) for r in bags.select("chunk_id", F.size("t")).collect()}


def test_index_is_loaded_as_saved(spark, tmp_path):
    docs = spark.createDataFrame([(1, "公司净利润增长"), (2, "公司毛利率下降"), (3, None)], "id long, text string")
    queries = spark.createDataFrame([(1, "净利润"), (2, None)], "q long, text string")
    index = retrieval.LexicalIndex(docs, "id", "text")
    index.save(str(tmp_path / "i"))
    want = [tuple(r) for r in index.search(queries, "q", "text", 5).collect()]
    assert want and [tuple(r) for r in retrieval.LexicalIndex.load(spark, str(tmp_path / "i")).search(queries, "q", "text", 5).collect()] == want


def test_routes(spark):
    texts = {1: "甲公司净利润大幅增长", 2: "乙公司净利润小幅下降", 3: "丙公司毛利率", 4: "可比公司净利润", 5: None}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    rng = np.random.default_rng(0)
    stored = [(i, rng.normal(size=4).tolist()) for i in texts]
    store = spark.createDataFrame(stored, "chunk_id long, vector array<double>")
    facts = spark.createDataFrame([(i, f"60000{i}", "comparable_table" if i == 4 else "text") for i in texts], "chunk_id long, stock_code string, content_type string")
    asked = [(10, "vector", "净利润", "factual", "600003"), (11, "bm25", "净利润", "factual", ""), (12, "hybrid", "净利润", "factual", "600002"), (13, "hybrid", "甲公司和乙公司净利润对比", "comparative", None), (14, "vector", None, None, None)]
    rows = spark.createDataFrame([(*a, stored[0][1] if a[0] != 14 else None) for a in asked], "query_id long, route string, query string, query_type string, stock_code string, vector array<double>")
    found = {}
    for r in retrieval.route_search(rows.withColumn("subs", qf.sub_queries(F.col("query"))), retrieval.LexicalIndex(docs, "id", "text"), store, facts, 3, 4).collect():
        found.setdefault(r["query_id"], {})[r["chunk_id"]] = (r["rank"], r["score"])
    dense = {i: round(cosine(stored[0][1], v), 6) for i, v in stored}
    top = sorted(dense, key=lambda i: -dense[i])[:3]
    want = {i: dense[i] - 0.1 if i == 4 else dense[i] + 0.12 * (i == 3) for i in top}
    assert {i: s for i, (_, s) in found[10].items()} == {i: round(max(s, 0) if i == 4 else s, 6) for i, s in want.items()}
    assert set(found[11]) == {1, 2, 4} and found[11][4][0] == 3
    assert len(found[12]) == 3 and 14 not in found
    # each compared name's own list puts its document first, so both are among the fused
    assert {1, 2} <= set(found[13]) and all(s < 0.05 for _, s in found[13].values())
