import itertools
import random

from millrace.llm import near_duplicates as nd


def texts(n=120, seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("公司收入利润增长下降产品市场需求成本价格0123456789，。") for _ in range(rng.randint(60, 160))) for _ in range(n // 4)]
    out = []
    for b in base:
        out.append(b)
        for _ in range(3):
            t = list(b)
            for _ in range(rng.choice([1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice("新旧高低")
            out.append("".join(t))
    return out


def exact(rows, least=0.6):
    sets = {i: {b[k : k + 5] for k in range(len(b) - 4)} for i, t in rows if t is not None and (b := "".join(t.split())) is not None}
    sets = {i: s for i, s in sets.items() if s}
    return {(min(a, b), max(a, b)) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    out = [(r[0], r[1]) for r in nd.duplicate_pairs(df, "chunk_id", "text", **kw).collect()]
    assert len(out) == len(set(out)) and all(a < b for a, b in out)
    return set(out)


def test_against_brute_force(spark):
    rows = [(f"c{i:03d}", t) for i, t in enumerate(texts())]
    rows += [("copy1", rows[0][1]), ("copy2", " " + rows[0][1] + "\n"), ("null", None), ("empty", ""), ("short", "abcd"), ("long", "长文本" * 40_000), rows[1], rows[1]]
    want, got = exact(dict(rows).items()), found(spark, rows)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_hot_anchors_lose_nothing(spark, monkeypatch):
    rows = [(f"c{i:03d}", t) for i, t in enumerate(texts(80, 5))]
    plain = found(spark, rows)
    monkeypatch.setattr(nd, "ANCHOR_ROWS", 2)
    assert found(spark, rows) == plain


def test_a_third_of_copies(spark):
    rows = [(f"a{i:03d}", "同一段文字反复出现在许多报告之中，没有任何差别。") for i in range(60)]
    assert len(found(spark, rows)) == 60 * 59 // 2


def test_copies_in_blocks_lose_nothing(spark, monkeypatch):
    base = texts(16, 9)
    rows = [(f"{k:02d}c{i:03d}", t) for i, t in enumerate(base) for k in range(1 + 12 * (i % 3 == 0))]
    plain = found(spark, rows)
    monkeypatch.setattr(nd, "COPIES", 4)
    assert found(spark, rows) == plain == exact(rows)


def test_empty_and_clashes(spark):
    assert found(spark, []) == set()
    df = spark.createDataFrame([("x", "一样的内容一样的内容", "r", 1), ("y", "一样的内容一样的内容", "r", 2)], "chunk_id string, text string, rep string, a int")
    assert [tuple(r) for r in nd.duplicate_pairs(df, "chunk_id", "text").collect()] == [("x", "y")]


def test_anchors_meet_within_one_symbol():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, (50, nd.BLOCK * nd.BLOCKS), dtype=np.uint32)
    b = rng.integers(0, 2**32, a.shape, dtype=np.uint32)
    b[:, :4] = a[:, :4]
    b[:, 2] += 1
    x, y = nd.anchors(a), nd.anchors(b)
    assert all(set(p) & set(q) for p, q in zip(x, y, strict=True))
    c = b.copy()
    c[:, 1] += 7
    assert not any(set(p[:4]) & set(q[:4]) for p, q in zip(x, nd.anchors(c), strict=True))


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(60)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert nd.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups(spark):
    a, b = "公司收入利润增长下降产品市场需求成本价格" * 3, "完全不同的另外一段文字没有任何相似之处可言" * 3
    rows = [("c1", a), ("c2", a), ("c3", a[:-2] + "变化"), ("c4", b), ("c5", None)]
    got = {r["chunk_id"]: (r["group"], r["n_links"]) for r in nd.duplicate_groups(spark.createDataFrame(rows, "chunk_id string, text string"), "chunk_id", "text").collect()}
    assert got == {"c1": ("c1", 1), "c2": ("c1", 1), "c3": ("c1", 1), "c4": ("c4", 0)}
