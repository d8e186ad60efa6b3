"""Hashes of any stretch of text in constant time, for whole Arrow batches at once.

A batch's texts are one array of code points. Sums of code points times powers of an odd base, taken
modulo 2^64, give the hash of any stretch from two of them, so all prefixes or windows of a text cost as
much as reading it. Equal strings have equal hashes wherever they stand; two different ones of a corpus
meet with a chance of about one in 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
SLICE_CHARS = 1_000_000
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        size = max(n, 2 * SLICE_CHARS)
        known = _powers[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, base, dtype=np.uint64))])
    return known[:n]


class Texts:
    """The code points of some texts, end to end: ``points``, and where each text ``begins`` and ``ends``."""

    def __init__(self, texts: list[str]):
        self.joined = "".join(texts)
        self.points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        terms = mixed(self.points + np.uint64(1)) * _power("up", _BASE, len(self.points))
        self._sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each stretch from ``begins`` up to ``ends``, as signed numbers."""
        inner = (self._sums[ends] - self._sums[begins]) * _power("down", pow(_BASE, -1, 1 << 64), len(self.points) + 1)[begins]
        return mixed(inner ^ ((ends - begins).astype(np.uint64) * _M3)).view(np.int64)


def text_hashes(texts: list[str]) -> np.ndarray:
    """The hash of each whole text."""
    t = Texts(texts)
    return t.hashes(t.begins, t.ends)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose ``column`` has about ``SLICE_CHARS`` bytes; a longer text is a slice of its own."""
    for big in batches:
        if not big.num_rows:
            continue
        sizes = np.array(pc.binary_length(big.column(column)).fill_null(0), dtype=np.int64)
        places = np.cumsum(sizes) // (2 * SLICE_CHARS)
        edges = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield big.slice(a, b - a)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct ``keys``, and the sum of each of ``values`` over them."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, *[np.bincount(inverse, weights=v, minlength=len(distinct)).astype(np.int64) for v in values]


FILTER_BITS, ROW_BITS = 1 << 23, 1 << 15


def wanted_filter(df: DataFrame, column: str) -> bytes:
    """A bitmap of ``FILTER_BITS`` for the hashes in ``column``: 1 MB whatever their number.

    Spark builds it in rows of ``ROW_BITS``; where it is full, it only lets more through, as a join behind it decides.
    """
    slot = F.pmod(column, F.lit(FILTER_BITS))
    rows = df.select(F.floor(slot / ROW_BITS).cast("int").alias("row"), F.pmod(slot, F.lit(ROW_BITS)).alias("slot")).groupBy("row").agg(F.bitmap_construct_agg("slot").alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for r in rows.collect():  # at most FILTER_BITS / ROW_BITS rows
        out[r["row"] * ROW_BITS // 8 : (r["row"] + 1) * ROW_BITS // 8] = r["bits"]
    return bytes(out)


def passes(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each of ``hashes`` may be among the wanted ones."""
    slot = hashes & (FILTER_BITS - 1)
    return (np.frombuffer(bitmap, dtype=np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
