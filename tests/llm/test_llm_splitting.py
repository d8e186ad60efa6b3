import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.llm import splitting

TEXT = st.text(alphabet="ab。！\n;汉🙂", max_size=60)


def pieces(spark, rows):
    df = spark.createDataFrame(rows, "id int, text string, max_chars int, overlap_chars int")
    out = {}
    for r in splitting.split_pieces(df, "text", "max_chars", "overlap_chars").collect():
        out.setdefault(r["id"], []).append((r["part_index"], r["part_count"], r["part_text"]))
    return {k: sorted(v) for k, v in out.items()}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.tuples(TEXT, st.integers(1, 12), st.integers(0, 14)), min_size=1, max_size=12))
def test_pieces_cover_the_text(spark, texts):
    got = pieces(spark, [(i, t, m, o) for i, (t, m, o) in enumerate(texts)])
    for i, (t, m, o) in enumerate(texts):
        parts = [p for _, _, p in got.get(i, [])]
        if not t.strip("\n") and len(t) > m:
            continue
        assert [a for a, _, _ in got[i]] == list(range(1, len(parts) + 1)) and {c for _, c, _ in got[i]} == {len(parts)}
        assert all(len(p) <= max(m, 1) for p in parts)
        lap, pos = min(o, m - 1), 0
        for k, p in enumerate(parts):
            if len(t) <= m:
                assert p == t
                break
            while True:
                before = min(lap, pos) if k else 0
                if t[pos - before :].startswith(p) and len(p) > before:
                    break
                assert pos < len(t) and t[pos] == "\n", (t, m, o, parts)
                pos += 1
            pos += len(p) - before
        else:
            assert not t[pos:].strip("\n")


def test_kinds(spark):
    rows = [(1, "一二三。四五六。", 5), (2, "一二三四五六。七。", 5), (3, "短。", 5), (4, None, 5), (5, "", 5), (6, "长" * 100_000, 5), (7, "ab\ncd\nef", 5), (8, "abcde。x", 5), (9, "x。y。z。w", None)]
    df = spark.createDataFrame(rows, "id int, text string, max_chars int")
    got = {r["id"]: r["hard"] for r in splitting.oversized(df, "text", "max_chars").collect()}
    assert got == {1: False, 2: True, 6: True, 7: False, 8: True}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(TEXT, min_size=1, max_size=20), limit=st.integers(1, 9))
def test_hard_means_a_stretch_that_does_not_fit(spark, texts, limit):
    df = spark.createDataFrame([(i, t, limit) for i, t in enumerate(texts)], "id int, text string, m int")
    got = {r["id"]: r["hard"] for r in splitting.oversized(df, "text", "m").collect()}
    for i, t in enumerate(texts):
        stretches = [s for line in t.split("\n") for s in re.split(r"(?<=[。！？；!?])", line)]
        assert (i in got) == (len(t) > limit)
        if i in got:
            assert got[i] == (max(map(len, stretches)) > limit)


def test_nulls_and_clashes(spark):
    got = pieces(spark, [(1, None, 5, 1), (2, "", 5, 1), (3, "abc", None, 1), (4, "abcdef", 3, None), (5, "abcdef", 3, 9)])
    assert got[1] == [(1, 1, None)] and got[2] == [(1, 1, "")] and got[3] == [(1, 1, "abc")]
    assert [p for _, _, p in got[4]] == ["abc", "def"] and all(len(p) <= 3 for _, _, p in got[5])
    df = spark.createDataFrame([("abcdef", 3, 0, 9, 9, "z")], "text string, m int, o int, part_index int, part_count int, part_text string")
    assert [r["part_index"] for r in splitting.split_pieces(df, "text", "m", "o").collect()] == [1, 2]


def test_unsound_parts(spark):
    rows = [
        (1, 1, 2, "a"), (1, 2, 2, "b"), (2, 1, 2, "a"), (3, 1, 2, "a"), (3, 1, 2, "b"), (4, 1, 1, "long" * 5), (5, 1, 2, "a"), (5, 2, 3, "b"), (6, None, 1, "a"), (7, 1, 1, None), (8, 1, None, "a"),
    ]
    df = spark.createDataFrame(rows, "unit_id int, part_index int, part_count int, table_raw string")
    assert {r[0] for r in splitting.unsound_parts(df, "unit_id", 10).collect()} == {2, 3, 4, 5, 6, 8}
    assert splitting.unsound_parts(df.limit(0), "unit_id", 10).count() == 0


def test_long_texts_cost_their_length(spark):
    seconds = []
    pieces(spark, [(0, "短句。\n" * 100, 20, 5)])
    for n in (60_000, 120_000):
        began = time.perf_counter()
        got = pieces(spark, [(0, ("一二三四五六七。八九\n" + "长" * 30) * (n // 41), 20, 5)])[0]
        seconds.append(time.perf_counter() - began)
        assert len(got) > n // 20
    assert seconds[1] < 3 * seconds[0] + 1


def test_overlap_reaches_over_short_pieces(spark):
    # short lines between stretches without a boundary: the overlap spans several pieces
    text = ("长" * 9 + "\n" + "🙂。" + "b" * 8) * 20
    got = [p for _, _, p in pieces(spark, [(0, text, 12, 10)])[0]]
    flat = text.replace("\n", "")
    assert all(p.replace("\n", "") in flat for p in got) and all(len(p) == 12 or k in (0, len(got) - 1) or p[:10] in text for k, p in enumerate(got))
