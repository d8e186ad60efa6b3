from pyspark.sql import functions as F

from millrace.llm import canonical

CASES = {
    "Ｒ＆Ｄ 投入": "R&D 投入",
    "ΕРЅ 调整": "EPS 调整",
    "“Завод”项目": "“Завод”项目",
    "10kΩ档位，0.13μm，80℃，①号，第Ⅱ期，1200㎡": "10kΩ档位，0.13μm，80℃，①号，第Ⅱ期，1200㎡",
    "Mérano": "Mérano",
    "产﻿‍\xad能规划": "产能规划",
    "Q&A： a　b\tc": "Q&A： a b c",
    "⻛险 ⾼于 見": "风险 高于 見",
    "a b\nc": "a\nb\nc",
    "Ηalvörd": "Halvörd",
    "": "",
    "x" * 200_000 + "​": "x" * 200_000,
}


def test_forms(spark):
    rows = [(i, v) for i, v in enumerate(CASES)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, v string")
    got = {r["id"]: r["form"] for r in canonical.canonicalize(df, "v").collect()}
    assert got == {i: f for i, (_, f) in enumerate(CASES.items())} | {99: None}
    cases = {r["id"] for r in canonical.canonical_cases(df, "v").collect()}
    assert cases == {i for i, (v, f) in enumerate(CASES.items()) if v != f}


def test_forms_are_stable(spark):
    df = spark.createDataFrame([(v,) for v in CASES.values()], "v string")
    assert canonical.canonical_cases(df, "v").count() == 0


def test_clashing_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "Ａ", "old", "c"), (1, "Ａ", "old", "c"), (None, None, None, None)], "batch int, value string, form string, c0 string")
    out = canonical.canonicalize(df, "value")
    assert sorted(out.columns) == ["batch", "c0", "form", "value"]
    assert sorted(str(r["form"]) for r in out.collect()) == ["A", "A", "None"]
    own = canonical.canonicalize(df.select("form", F.col("value")), "value", "value")
    assert {r["value"] for r in own.collect()} == {"A", None}


def test_empty(spark):
    assert canonical.canonicalize(spark.createDataFrame([], "v string"), "v").count() == 0
