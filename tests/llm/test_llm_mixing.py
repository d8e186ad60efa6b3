import pytest

from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.sources.tables import table


def run(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m, r = mixing.mix(d, "doc_id", t, **kw)
    return m.collect(), {x["source"]: x for x in r.collect()}


def docs(n_a=4000, n_b=400, n_c=40):
    rows = [(i, "a", 10) for i in range(n_a)] + [(10_000 + i, "b", 10) for i in range(n_b)] + [(20_000 + i, "c", 10) for i in range(n_c)]
    return rows + [(30_000, None, 10), (30_001, "other", 10), (30_002, "a", 0), (30_003, "b", None)]


TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 5), ("absent", 0.1, 3), (None, 0.5, 1)]


def test_shares_are_reached(spark):
    rows, report = run(spark, docs(), TARGETS, block_tokens=50)
    assert report["absent"]["actual_share"] == 0 and set(report) == {"a", "b", "c", "absent"}
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert report[s]["actual_share"] == pytest.approx(want / 0.9, abs=0.02)
    assert all(r["copy"] <= {"a": 1, "b": 2, "c": 5}[r["source"]] for r in rows)
    uses = {}
    for r in rows:
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    assert max(uses[i] for i in uses if i < 10_000) == 1 and max(uses[i] for i in uses if i >= 20_000) <= 5
    assert len({(r["doc_id"], r["copy"], r["first_token"]) for r in rows}) == len(rows)


def test_every_stretch_is_mixed(spark):
    rows, report = run(spark, docs(), TARGETS, block_tokens=50)
    slots = {r["slot"]: r["source"] for r in rows}
    order = [slots[k] for k in sorted(slots)]
    for start in range(0, len(order) - 40, 20):
        assert abs(order[start : start + 40].count("a") / 40 - 0.555) < 0.1


def test_one_pass_fills_up_to_caps(spark):
    _, report = run(spark, docs(), TARGETS, one_pass=True, block_tokens=50)
    assert report["c"]["planned_tokens"] == 40 * 10 * 5 and report["b"]["planned_tokens"] == 400 * 10 * 2
    assert sum(r["planned_tokens"] for r in report.values()) == pytest.approx(44_400, abs=2)


def test_edges(spark):
    assert run(spark, [], TARGETS)[0] == []
    rows, report = run(spark, docs(40, 40, 4), [])
    assert rows == [] and report == {}
    rows, report = run(spark, docs(40, 40, 4), [("a", None, 1), ("b", 0.5, None), ("c", -1.0, 2)])
    assert rows == []
    rows, report = run(spark, docs(40, 40, 4), [("a", 1.0, 3), ("a", 0.5, 2)], block_tokens=50)
    assert len(report) == 1 and report["a"]["actual_share"] == 1.0
    again, _ = run(spark, docs(40, 40, 4), [("a", 1.0, 3), ("a", 0.5, 2)], block_tokens=50)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_running_sum(spark):
    df = spark.createDataFrame([("g", i % 3, i, i) for i in range(30)], "g string, b int, o int, v long")
    got = {r["o"]: r["s"] for r in mixing.running_sum(df, "g", "b", ["o"], "v", "s").collect()}
    order, total = sorted(range(30), key=lambda i: (i % 3, i)), 0
    for i in order:
        assert got[i] == total
        total += i


def test_blocks_are_equal_for_long_documents(spark):
    rows = [(1, "a", 1000), (2, "a", 7), (3, "a", 0), (4, "a", 333), (5, "b", 25)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    parts = mixing.blocks(df, "doc_id", 100, 8).collect()
    sizes, own = {}, {}
    for p in parts:
        sizes[p["source"], p["block"]] = sizes.get((p["source"], p["block"]), 0) + p["n_tokens"]
        own.setdefault(p["doc_id"], []).append((p["first_token"], p["n_tokens"]))
    assert sizes == {("a", k): 100 for k in range(13)} | {("a", 13): 40, ("b", 0): 25}
    for doc, _, n in rows:
        at = 0
        for first, size in sorted(own.get(doc, [])):
            assert first == at
            at += size
        assert at == n


def test_shares_on_documents(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("n_tokens"))
    targets = table(spark, folder, "mix_targets")
    _, full = mixing.mix(documents, "doc_id", targets, one_pass=True, block_tokens=512)
    full = {r["source"]: r for r in full.collect()}
    available = {r["source"]: r["available_tokens"] for r in full.values()}
    assert sum(r["actual_tokens"] for r in full.values()) == pytest.approx(sum(available.values()), rel=0.03)
    capped = {s for s, r in full.items() if r["planned_tokens"] == r["available_tokens"] * r["max_repeats"]}
    for s, r in full.items():
        assert r["actual_tokens"] == pytest.approx(r["planned_tokens"], abs=512 * 3)
        assert r["copies"] <= r["max_repeats"]
    free = [r["actual_share"] / r["target_share"] for s, r in full.items() if s not in capped and r["target_share"] > 0]
    assert max(free, default=1) <= 1.25 * min(free, default=1)
    _, exact = mixing.mix(documents, "doc_id", targets, block_tokens=512)
    exact = [r for r in exact.collect() if r["available_tokens"] > 0 and r["max_repeats"] > 0]
    listed = sum(r["target_share"] for r in exact)
    total = sum(r["actual_tokens"] for r in exact)
    for r in exact:
        assert r["actual_share"] == pytest.approx(r["target_share"] / listed, abs=512 * 3 / total)
