"""Encoding a corpus with a public tokenizer (problem 6).

Short texts are encoded as they are, in Arrow batches. A long text is cut into blocks that are encoded
in parallel, as leaves of a tree; then the two sides of each join are put together. A cut may fall
anywhere, even inside a word, so the tokens near it may be wrong. Around each join a window of text is
encoded anew and grown until, on either side of the join, the window and the block agree on a run of
tokens with the same limits. Between two such runs the window's tokens hold, beyond them the blocks'.

Why that is exact: byte-pair encoding of a split unit is determined by its neighbouring tokens, so a
sequence whose adjacent tokens were all adjacent in a true encoding is the encoding; the agreeing runs
make every adjacent pair come from the window or from one block. A window that has grown over both
blocks is an encoding of the whole.

Defined results: empty and null texts have the ids ``[]``; special tokens in a text are ordinary text;
unpaired surrogates cannot occur in Spark strings. Repeated documents give equal ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
BLOCK_CHARS = 8192
WINDOW_CHARS = 64
AGREE_TOKENS = 4


@lru_cache(maxsize=4)
def byte_bpe(name: str, folder: str = TOKENIZERS):
    """The byte-level tokenizer of ``<folder>/<name>.tiktoken``, one per worker process."""
    import public_tokenizers
    import tiktoken

    lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def pieces(name: str, folder: str = TOKENIZERS):
    """The sentence-piece tokenizer of ``<folder>/<name>.model``, one per worker process."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=str(Path(folder) / f"{name}.model"))


def encode(enc, text: str) -> np.ndarray:
    """The ids of ``text``, no string of it taken as a special token."""
    return enc.encode_to_numpy(text, disallowed_special=())


def _limits(enc, ids: np.ndarray) -> np.ndarray:
    """The byte offset behind each token."""
    return np.cumsum([len(enc.decode_single_token_bytes(int(i))) for i in ids]) if len(ids) else np.zeros(0, dtype=np.int64)


def _run(a_ids, a_ends, b_ids, b_ends, first: bool) -> tuple[int, int] | None:
    """Where two encodings share ``AGREE_TOKENS`` adjacent tokens: the indexes of the run's middle in each, at its first or last place.

    ``ends`` are byte offsets in the same text.
    """
    _, ia, ib = np.intersect1d(a_ends, b_ends, return_indices=True)
    same = a_ids[ia] == b_ids[ib]
    good = same[:-1] & (np.diff(ia) == 1) & (np.diff(ib) == 1) & same[1:] if len(ia) > 1 else np.zeros(0, dtype=bool)
    n = AGREE_TOKENS - 1
    if len(good) < n:
        return None
    runs = np.flatnonzero(np.convolve(good, np.ones(n, dtype=int), "valid") == n)
    if not len(runs):
        return None
    at = (runs[0] if first else runs[-1]) + AGREE_TOKENS // 2
    return int(ia[at]), int(ib[at])


def join(enc, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
    """The ids of ``left + right``, given the ids of each."""
    if not left or not right:
        return np.concatenate([left_ids, right_ids])
    width = WINDOW_CHARS
    while width < max(len(left), len(right)):
        a, b = left[-width:], right[:width]
        ids = encode(enc, a + b)
        ends = _limits(enc, ids)
        middle = len(a.encode())
        # how many tokens of a block a window can touch: one per byte at most
        tail, head = left_ids[-(len(a.encode()) + 1) :], right_ids[: len(b.encode()) + 1]
        tail_sizes = _limits(enc, tail)
        tail_ends = tail_sizes - (tail_sizes[-1] if len(tail_sizes) else 0) + middle
        head_ends = _limits(enc, head) + middle
        inside, before = ends < middle, (tail_ends > 0) & (tail_ends < middle)
        behind, after = ends > middle, head_ends > middle
        l = _run(tail[before], tail_ends[before], ids[inside], ends[inside], True) if width < len(left) else (0, 0)
        r = _run(ids[behind], ends[behind], head[after], head_ends[after], False) if width < len(right) else (0, 0)
        if l and r:
            if width < len(left):
                keep = len(left_ids) - len(tail) + int(np.flatnonzero(before)[l[0]]) + 1
                begin, front = int(np.flatnonzero(inside)[l[1]]) + 1, left_ids[:keep]
            else:
                begin, front = 0, left_ids[:0]
            if width < len(right):
                end, back = int(np.flatnonzero(behind)[r[0]]) + 1, right_ids[int(np.flatnonzero(after)[r[1]]) + 1 :]
            else:
                end, back = len(ids), right_ids[:0]
            return np.concatenate([front, ids[begin:end], back])
        width *= 2
    return encode(enc, left + right)


def join_tree(enc, blocks: list[str], ids: list[np.ndarray]) -> np.ndarray:
    """The ids of all blocks' text: neighbours are joined, then the results, until one is left."""
    while len(blocks) > 1:
        pairs = range(0, len(blocks) - 1, 2)
        odd = [len(blocks) - 1] if len(blocks) % 2 else []
        ids = [*(join(enc, blocks[i], ids[i], blocks[i + 1], ids[i + 1]) for i in pairs), *(ids[i] for i in odd)]
        blocks = [*(blocks[i] + blocks[i + 1] for i in pairs), *(blocks[i] for i in odd)]
    return ids[0] if ids else np.zeros(0, dtype=np.uint32)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _encoder(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key..., text) -> (key..., ids); the text is the last column."""
        enc = byte_bpe(name, folder)
        for big in batches:
            for start in range(0, big.num_rows, 256):
                b = big.slice(start, 256)
                ids = [encode(enc, t or "") for t in b.column(b.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(ids)], names=[*b.schema.names[:-1], "ids"])

    return run


def _joiner(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, [(block, text, ids)]) -> (key, ids)."""
        enc = byte_bpe(name, folder)
        for big in batches:
            for start in range(0, big.num_rows, 16):
                b = big.slice(start, 16)
                out = []
                for parts in b.column(1).to_pylist():
                    parts.sort(key=lambda p: p["block"])
                    out.append(join_tree(enc, [p["text"] for p in parts], [np.array(p["ids"], dtype=np.uint32) for p in parts]))
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(out)], names=[b.schema.names[0], "ids"])

    return run


def token_ids(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, ids): the ids of each text; ``key`` must be unique.

    Texts of more than ``block_chars`` code points are encoded in blocks of at most that length, in
    parallel, and joined; only their blocks are shuffled.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    encoder, size = _encoder(tokenizer, folder), F.length("text")
    short = rows.where(size <= block_chars).mapInArrow(encoder, f"key {kind}, ids array<int>")
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / block_chars).cast("int")),
        lambda i: F.substring(F.col("text"), i * block_chars + 1, F.lit(block_chars)),
    )
    leaves = rows.where(size > block_chars).select("key", F.posexplode(blocks).alias("block", "text")).repartition("key", "block")
    encoded = leaves.select("key", "block", "text", F.col("text").alias("leaf")).mapInArrow(encoder, f"key {kind}, block int, text string, ids array<int>")
    long = encoded.groupBy("key").agg(F.collect_list(F.struct("block", "text", "ids")).alias("parts"))
    joined = long.mapInArrow(_joiner(tokenizer, folder), f"key {kind}, ids array<int>")
    return short.unionByName(joined).select(F.col("key").alias(key), "ids")


def token_count(text: Column, tokenizer: str = "piece_bpe_32k", folder: str = TOKENIZERS) -> Column:
    """How many tokens a text has under a sentence-piece tokenizer; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pieces(tokenizer, folder)
        for s in batches:
            yield pd.Series([len(model.encode(t, num_threads=1)) if t else 0 for t in s], dtype="int64")

    return count(text)
