import random

import numpy as np
import pytest

from millrace.llm import tokens as tk

pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


def sample(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice("ab '’s don't  \n\t12.,!?汉字é🙂") for _ in range(rng.randrange(1, 300)))
    if kind < 0.6:
        return rng.choice(["a", "ab", "汉", " ", "1", "!", "aé", "\n", "🙂", "'s"]) * rng.randrange(1, 400)
    return "".join(chr(rng.randrange(0x4E00, 0x4E60)) for _ in range(rng.randrange(1, 500)))


def test_joins_are_exact():
    enc, rng = tk.byte_bpe("byte_bpe_50k"), random.Random(7)
    for _ in range(250):
        text = sample(rng) + sample(rng)
        size = rng.choice([5, 20, 64, 200])
        blocks = [text[i : i + size] for i in range(0, len(text), size)]
        assert np.array_equal(tk.join_tree(enc, blocks, [tk.encode(enc, b) for b in blocks]), tk.encode(enc, text)), text


def test_ids(spark):
    from tokenizers import Tokenizer

    rows = [(1, None), (2, ""), (3, "净利润增长12.5%。"), (4, "a<|endoftext|>b"), (5, "汉字" * 5000), (6, "  \n\n x"), (7, "x" * 9001), (8, "净利润增长12.5%。")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' AS key", "1 AS ids", "2 AS block")
    got = {r["doc_id"]: r["ids"] for r in tk.token_ids(df, "doc_id", "text", block_chars=1000).collect()}
    hf = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    assert got == {i: hf.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert dict(tk.token_ids(df, "doc_id", "text").dtypes)["ids"] == "array<int>"
    assert tk.token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_counts(spark):
    df = spark.createDataFrame([("净利润",), ("",), (None,)], "text string")
    n = [r[0] for r in df.select(tk.token_count(df["text"])).collect()]
    assert n[0] > 0 and n[1:] == [0, 0]
