"""Near-duplicate texts by anchor-point covering (problem 2).

A text becomes a vector of minimum hashes over its set of substrings; two texts of similarity s
agree in each symbol with probability s. The vector is cut into blocks of ``BLOCK`` symbols. In each
block, the words whose symbols XOR to zero form a code of covering radius 1: every block lies within
one symbol of exactly ``BLOCK`` code words, one for each symbol that may be replaced. These code words
are the anchors. A block is replicated to all anchors within the covering radius, and as the code's
words are determined by any ``BLOCK - 1`` symbols, two blocks that differ in at most one symbol (the
threshold) always meet at an anchor. Within an anchor, short sketches are compared before a pair
becomes a candidate; candidates are checked exactly on the texts' substrings.

Equal texts are collapsed before and expanded after, so groups of copies never reach an anchor; a text of
more than ``COPIES`` ids is expanded in blocks of ids. The rows of an anchor with more than ``ANCHOR_ROWS`` texts only stream through the first comparison; they
are then divided into blocks, and each pair of blocks is compared on its own, so that a hot anchor is
spread over the cluster and no pair is lost.

The chance that a pair of similarity s is missed is (1 - s^4 - 4 s^3 (1 - s))^BLOCKS: with 8 blocks
0.6 % at 0.6, 0.02 % at 0.7 and less than 1 in 100,000 at 0.8.

Null texts and texts shorter than one substring take no part. A pair of ids with equal texts has
similarity 1. Repeated rows of an id count once; an id must always carry the same text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.hashing import mixed
from millrace.session import broadcast_if_small, cut

SHINGLE = 5
BLOCK, BLOCKS = 4, 8
SKETCH_SYMBOLS = 16
SKETCH_AGREE = 5
ANCHOR_ROWS = 512
COPIES = 1_024
BROADCAST_ROWS = 200_000

def min_hashes(texts: list[str], n: int, size: int = SHINGLE) -> np.ndarray:
    """An array (texts, n) of 32-bit minimum hashes of each text's substrings of ``size``; texts are at least that long."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    counts = lengths - size + 1
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rolled = np.zeros(len(points) - size + 1, dtype=np.uint64)
    for j in range(size):
        rolled = rolled * np.uint64(0x100000001B3) + points[j : len(points) - size + 1 + j]
    at = np.arange(counts.sum()) - np.repeat(firsts - begins, counts)
    base = mixed(rolled[at])
    odd = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(texts), n), dtype=np.uint32)
    for i in range(n):
        out[:, i] = np.minimum.reduceat(((base * odd[2 * i] + odd[2 * i + 1]) >> np.uint64(32)).astype(np.uint32), firsts)
    return out


def anchors(words: np.ndarray) -> np.ndarray:
    """An array (texts, BLOCKS * BLOCK) of the anchors within the covering radius of each text's blocks, as 64-bit numbers."""
    out = np.empty((len(words), BLOCKS * BLOCK), dtype=np.uint64)
    for b in range(BLOCKS):
        block = words[:, b * BLOCK : (b + 1) * BLOCK]
        parity = np.bitwise_xor.reduce(block, axis=1)
        for i in range(BLOCK):
            code = block.copy()
            code[:, i] ^= parity  # the code word that replaces symbol i
            key = np.full(len(words), b + 1, dtype=np.uint64)
            for s in range(BLOCK):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + code[:, s].astype(np.uint64))
            out[:, b * BLOCK + i] = key
    return out


def sketches(words: np.ndarray) -> np.ndarray:
    """A 64-bit number per text: four bits of each of ``SKETCH_SYMBOLS`` symbols."""
    out = np.zeros(len(words), dtype=np.uint64)
    for i in range(SKETCH_SYMBOLS):
        out |= (words[:, i * words.shape[1] // SKETCH_SYMBOLS].astype(np.uint64) & np.uint64(15)) << np.uint64(4 * i)
    return out


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text) -> one row (anchor, rep, sketch) for each anchor of a text."""
    for big in batches:
        for start in range(0, big.num_rows, 2000):
            b = big.slice(start, 2000)
            texts = b.column("text").to_pylist()
            words = min_hashes(texts, BLOCK * BLOCKS)
            keys = anchors(words)
            n = keys.shape[1]
            rep = np.repeat(b.column("rep").to_numpy(), n)
            sketch = np.repeat(sketches(words), n)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(rep), pa.array(sketch.view(np.int64))], names=["anchor", "rep", "sketch"])


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many four-bit symbols two sketches share."""
    x = a ^ b
    x = x | (x >> np.uint64(2))
    x = (x | (x >> np.uint64(1))) & np.uint64(0x1111111111111111)
    return SKETCH_SYMBOLS - np.bitwise_count(x).astype(np.int64)


def _compared(rep: np.ndarray, sketch: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within one anchor whose sketches agree enough; between two different sides if there are two."""
    left, right = [], []
    for i in range(len(rep) - 1):
        ok = _agree(sketch[i], sketch[i + 1 :]) >= SKETCH_AGREE
        if side[0] != side[-1]:
            ok &= side[i + 1 :] != side[i]
        hit = np.flatnonzero(ok) + i + 1
        if len(hit):
            left.append(np.full(len(hit), rep[i]))
            right.append(rep[hit])
    if not left:
        return rep[:0], rep[:0]
    return np.concatenate(left), np.concatenate(right)


def _anchor_pairs(key: np.ndarray, side: np.ndarray, rep: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b), a < b, of all runs of equal ``key`` in sorted rows; runs of two, by far the most, at once."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(edges)
    two = edges[:-1][sizes == 2]
    two = two[_agree(sketch[two], sketch[two + 1]) >= SKETCH_AGREE]
    a, b = [rep[two]], [rep[two + 1]]
    for e, n in zip(edges[:-1][sizes > 2], sizes[sizes > 2], strict=True):
        x, y = _compared(rep[e : e + n], sketch[e : e + n], side[e : e + n])
        a.append(x)
        b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
    return both[:, 0], both[:, 1]


def _runs(limit: int | None):
    """A map over rows (key, side, rep, sketch) sorted by key: pairs (a, b, null, null, null), and for
    keys of more than ``limit`` rows the rows themselves as (null, null, key, rep, sketch)."""

    def out(pairs, rows) -> pa.RecordBatch:
        a, b = pairs
        key, rep, sketch = rows
        n, m = len(a), len(key)
        none_m, none_n = pa.nulls(m, pa.int64()), pa.nulls(n, pa.int64())
        cols = [pa.concat_arrays([pa.array(x), none_m]) for x in (a, b)]
        cols += [pa.concat_arrays([none_n, pa.array(x)]) for x in (key, rep, sketch.view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "rep", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        rest, hot = None, None
        for big in batches:
            cols = [c.to_numpy() for c in big.columns]
            cols[3] = cols[3].view(np.uint64)
            if hot is not None:  # more rows of the hot key that ended the batch before
                other = np.flatnonzero(cols[0] != hot)
                n = int(other[0]) if len(other) else len(cols[0])
                if n:
                    yield out((none, none), (cols[0][:n], cols[2][:n], cols[3][:n]))
                    cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                hot = None
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            key = cols[0]
            edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            sizes = np.diff(edges)
            stop = edges[-2]  # the last run may go on in the next batch
            large = np.repeat(sizes > limit, sizes) if limit else np.zeros(len(key), dtype=bool)
            if large[-1]:
                hot, stop = key[-1], len(key)
            rest = [c[stop:] for c in cols]
            now, big_run = [c[:stop][~large[:stop]] for c in cols], [c[:stop][large[:stop]] for c in cols]
            if len(now[0]) or len(big_run[0]):
                yield out(_anchor_pairs(*now) if len(now[0]) else (none, none), (big_run[0], big_run[2], big_run[3]))
        if rest is not None and len(rest[0]):
            yield out(_anchor_pairs(*rest), (none, none, none))

    return run


_RUN_SCHEMA = "a long, b long, key long, rep long, sketch long"


def _compare(rows: DataFrame, limit: int | None) -> DataFrame:
    """``_runs`` over (key, side, rep, sketch), the rows of a key together."""
    placed = rows.select("key", "side", "rep", "sketch").repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(_runs(limit), _RUN_SCHEMA)


def _cells(hot_rows: DataFrame) -> DataFrame:
    """Rows (key, rep, sketch) of hot keys, once for each pair of blocks that they take part in, as (key, side, rep, sketch)."""
    blocks = hot_rows.groupBy("key").agg(F.ceil(F.count("*") / ANCHOR_ROWS).cast("int").alias("blocks"))
    rows = hot_rows.join(blocks, "key").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least("side", j), F.greatest("side", j))))
    return rows.select(cell.alias("key"), "side", "rep", "sketch")


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> (a, b, similarity) of the sets of substrings."""
    for batch in batches:
        size = SHINGLE
        left, right = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
        out, last, seen = np.empty(len(left)), None, set()
        for k, (x, y) in enumerate(zip(left, right, strict=True)):
            if x != last:
                last, seen = x, {x[i : i + size] for i in range(len(x) - size + 1)}
            other = {y[i : i + size] for i in range(len(y) - size + 1)}
            both = len(seen & other)
            out[k] = both / (len(seen) + len(other) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], names=["a", "b", "similarity"])


def without_blanks(text: Column) -> Column:
    """Text without white space of any kind."""
    return F.regexp_replace(text, r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+", "")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, min_similarity: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts of ``df``.

    ``members``: (id, rep), one row per id; ids of equal text without blanks share ``rep``, a 64-bit
    number of that text. ``links``: (a, b, similarity) with a < b, each pair of different texts of at
    least ``min_similarity`` once.
    """
    bare = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), without_blanks(F.col(text_col)).alias("text"))
    bare = bare.where(F.length("text") >= SHINGLE)
    rep = F.xxhash64("text").alias("rep")
    members = cut(bare.select("id", rep).distinct())
    texts = cut(bare.select(rep, "text").distinct())
    replicas = texts.mapInArrow(_replicas, "anchor long, rep long, sketch long")
    first = cut(_compare(replicas.select(F.col("anchor").alias("key"), F.lit(0).alias("side"), "rep", "sketch"), ANCHOR_ROWS))
    second = _compare(_cells(first.where("key IS NOT NULL").select("key", "rep", "sketch")), None)
    candidates = cut(first.where("a IS NOT NULL").select("a", "b").unionByName(second.select("a", "b")).distinct())
    concerned = candidates.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    some = cut(texts.join(broadcast_if_small(cut(concerned), BROADCAST_ROWS), "rep", "left_semi"))
    sided = candidates.join(some.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    sided = sided.join(some.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    links = sided.select("a", "b", "text_a", "text_b").mapInArrow(_similarity, "a long, b long, similarity double")
    return members, links.where(F.col("similarity") >= min_similarity)


def duplicate_pairs(df: DataFrame, id_col: str, text_col: str, min_similarity: float = 0.6) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of ids whose texts have at least ``min_similarity``, equal texts included."""
    members, links = near_duplicates(df, id_col, text_col, min_similarity)
    sized = members.groupBy("rep").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("blocks"))
    placed = cut(members.join(sized, "rep").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    side = lambda x, r: placed.select(F.col("id").alias(x), F.col("rep").alias(r), F.col("block").alias(f"block_{r}"))
    left, right = side("x", "a"), side("y", "b")
    every = lambda r: F.explode(F.sequence(F.lit(0), F.col(f"blocks_{r}") - 1)).alias(f"block_{r}")
    many = sized.where("blocks > 1")
    of = lambda r: many.select(F.col("rep").alias(r), F.col("blocks").alias(f"blocks_{r}"))
    # a text of many ids meets its partners, and itself, block by block
    wide = links.join(of("a"), "a", "left").join(of("b"), "b", "left").na.fill(1, ["blocks_a", "blocks_b"])
    met = wide.select("a", "b", "blocks_b", every("a")).select("a", "b", "block_a", every("b"))
    near = met.join(left, ["a", "block_a"]).join(right, ["b", "block_b"])
    own = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.struct(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    celled = own.select("id", "rep", "block", cell.alias("cell"))
    one, two = celled.alias("one"), celled.alias("two")
    apart = (F.col("one.block") != F.col("two.block")) | (F.col("one.cell.lo") == F.col("one.cell.hi"))
    same = one.join(two, (F.col("one.rep") == F.col("two.rep")) & (F.col("one.cell") == F.col("two.cell"))).where((F.col("one.id") < F.col("two.id")) & apart).select(F.col("one.id").alias("x"), F.col("two.id").alias("y"))
    pairs = near.select("x", "y").unionByName(same)
    return pairs.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``links`` (a, b): the least node of each connected component.

    Alternating star steps: each node's greater neighbours are linked to the least node next to it, then its
    lesser ones; after a number of rounds that grows with the logarithm of the nodes all links point at roots.
    Every round's links are a written table; only their number and a checksum come to the driver.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = cut(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = state


def duplicate_groups(df: DataFrame, id_col: str, text_col: str, min_similarity: float = 0.6) -> DataFrame:
    """(id, group, n_links): each id with its group, the least id that chains of similar texts lead to, and its text's links.

    An id without a similar text is a group of its own; ids of null or short texts are left out.
    """
    members, links = near_duplicates(df, id_col, text_col, min_similarity)
    links = cut(links)
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    placed = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").join(degree, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    names = placed.groupBy("root").agg(F.min("id").alias("group"))
    return placed.join(names, "root").select(F.col("id").alias(id_col), "group", F.coalesce("n_links", F.lit(0)).alias("n_links"))
