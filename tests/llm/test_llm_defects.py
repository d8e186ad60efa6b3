import time
from collections import Counter

import numpy as np
import pyarrow as pa

from millrace.llm import defects, hashing

BODY = "公司产品收入同比增长{}%，主要因海外渠道放量 [1]。需求端，毛利率提升至{}%，后续关注新品进展 [2]。\n参考来源：\n[1] 某公司（970001），某某证券，第{}页（rerank=0.5）"
ENGLISH = "Inventory now covers {} days of heat pump demand. Management guided net profit toward {}% on a stronger product mix, in line with peers."


def good():
    rows = [(i, f"某某公司202{i % 7}年净利润预测是多少？", BODY.format(i, i + 1, i), None, None) for i in range(60)]
    rows += [(100 + i, f"What is the 202{i % 7} net profit forecast for XiuLut?", ENGLISH.format(i, i), None, None) for i in range(40)]
    return rows + [(200 + i, "某某公司的毛利率是多少？", f"约{i}.2亿元", None, None) for i in range(30)]


CASES = {
    "empty": [None, "", " \t\n", "​", "N/A", "nan", "无", "……", "结论：", "【要点】", "参考来源：", "[1]"],
    "refusal": ["抱歉，现有材料不足以回答这个问题。", "您好，根据规则，此类荐股请求不予处理。", "Unable to answer: evidence is below the required level.", "抱歉，无法回答某某公司2025年的净利润。", "我不确定：检索证据置信度过低（Top-1 rerank=0.213，阈值=0.35），无法基于当前检索结果可靠回答。", "抱歉，" + "关于这一问题，现有的研报片段没有覆盖所需的内容，无法给出可靠的结论，还请查阅原始资料。" * 6],
    "copies_question": ["某某公司2025年净利润预测是多少", "问题：某某公司2025年净利润预测是多少？", "某某公司2025年净利润预测是多少？\n某某公司2025年净利润预测是多少？"],
    "other_language": [ENGLISH.format(5, 6), "La marge de la société s'établit à 18% selon le rapport, grâce à une meilleure maîtrise des coûts.", "レポートによると、売上高は2百万円で、前年比での見通しです。"],
    "truncated": ["公司产品收入同比增长7%，主要因海外渠", BODY.format(1, 2, 3)[:-12], "需求端，毛利率提升至5%，后续关注新..."],
}
FINE = ["无法逐项拆分，合计口径为45.3% [1]。", "2024年的数据未找到，2025年净利润为12.3亿元。", "公司订单难以在短期内恢复，" + "但海外渠道放量、费用管控见效，毛利率有所提升，管理层维持全年指引。" * 8, "约12.3亿元", BODY.format(3, 4, 5)]


def run(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, query string, answer string, defect string, key string")
    out = [(r["row_id"], r["defect"]) for r in defects.defective_pairs(df, "row_id", "query", "answer").collect()]
    assert len(out) == len(dict(out))
    return dict(out)


def test_kinds(spark):
    question = "某某公司2025年净利润预测是多少？"
    rows, want = good(), {}
    for kind, answers in CASES.items():
        for a in answers:
            rows.append((1000 + len(want), question, a, None, None))
            want[1000 + len(want)] = kind
    rows += [(2000 + i, question, a, None, None) for i, a in enumerate(FINE)]
    rows += [(2100, question + "请用英文回答", ENGLISH.format(3, 4), None, None), (2101, None, BODY.format(1, 2, 3), None, None), (2102, None, None, None, None), (2103, question, BODY.format(5, 5, 5) * 300, None, None)]
    assert run(spark, rows) == want | {2102: "empty"}


def test_empty(spark):
    assert run(spark, []) == {}


def test_language_model_on_held_out_sentences():
    model = defects.LanguageModel({lang: [s] * 5 for lang, s in defects.SENTENCES.items()})
    held = {
        "zh": "管理层预计明年海外业务恢复增长", "en": "The board expects overseas sales to recover next year", "fr": "La direction prévoit une reprise des ventes l'année prochaine",
        "de": "Der Vorstand erwartet im nächsten Jahr eine Erholung des Geschäfts", "ja": "経営陣は来年の海外事業の回復を見込んでいる", "ko": "경영진은 내년에 해외 사업이 회복될 것으로 예상합니다", "ru": "Руководство ожидает восстановления продаж в следующем году",
    }
    assert {lang: model.posterior(t)[0] for lang, t in held.items()} == {lang: lang for lang in held}
    assert model.posterior(None) == (None, 0.0, 0) and model.posterior("12 %") == (None, 0.0, 0)


def test_copies_of_a_cut_answer_are_no_votes(spark):
    often = [(3000 + i, "某某公司2025年净利润预测是多少？", CASES["truncated"][0], None, None) for i in range(40)]
    assert run(spark, good() + often) == {r[0]: "truncated" for r in often}


def test_long_answers_cost_their_length():
    seconds = []
    for n in (100_000, 200_000):
        text = "".join(chr(0x4E00 + i % 4999) for i in range(n))
        began = time.perf_counter()
        batch = pa.record_batch({"answer": [text]})
        rows = pa.Table.from_batches(defects._tail_counts(b"\xff" * (hashing.FILTER_BITS // 8))([batch]))
        assert rows.num_rows >= 6 * 4999
        defects.LanguageModel({"zh": ["公司收入"], "en": ["sales"]}).posterior(text)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 5 * seconds[0] + 0.5


def test_tails_against_brute_force():
    texts = ["ab1.5c，HongQi x", "abab", "a"]
    shapes = [defects.shape(t) for t in texts]
    assert shapes[0] == "\x02ab9c，某 x"
    want = Counter()
    for s in shapes:
        for size in defects.TAILS:
            for to in range(2, len(s) + 1):
                want[size, s[max(to - size, 0) : to], to == len(s)] += 1
    got = pa.Table.from_batches(defects._tail_counts(b"\xff" * (hashing.FILTER_BITS // 8))([pa.record_batch({"answer": texts})])).to_pylist()
    names = {(size, int(hashing.text_hashes([t])[0])): t for size, t, _ in want}
    assert {(r["size"], names[r["size"], r["tail"]]): (r["n"], r["n_end"]) for r in got} == {(size, t): (want[size, t, True] + want[size, t, False], want[size, t, True]) for size, t, _ in want}


def test_wanted_filter(spark):
    df = spark.createDataFrame([(h,) for h in (-5, 0, 7, 2**40)], "h long")
    bitmap = hashing.wanted_filter(df, "h")
    assert list(hashing.passes(bitmap, np.array([-5, 0, 7, 2**40, 1, -6]))) == [True] * 4 + [False] * 2
