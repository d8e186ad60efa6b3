"""Lexical and dense top-k, fusion and score adjustment, for many queries in one plan.

Hits are rows (query_id, chunk_id, score, rank): rank from 1 by descending score, ties by chunk id.
Queries without matches have no rows. Null texts match nothing; null vectors have no similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.query import dense_weight, widened
from millrace.session import broadcast_if_small, cut, spread

# Parameters of the lexical score, of fusion and of score adjustment.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
POOL = 200
VECTOR_WEIGHT = 0.35
STOCK_BOOST = 0.12
COMPARABLE_PENALTY = 0.10
ASKED_TOKENS = 200_000


def tokens(text: Column) -> Column:
    """The tokens of a text in order: words of Latin letters and digits in lower case, pairs of adjacent Han characters.

    A Han character that stands alone is a token of its own.
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[㐀-䶿一-鿿]+|[a-z0-9]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when((r < "{") | (F.length(r) < 2), F.array(r)).otherwise(pairs(r))))


def ranked(df: DataFrame, query: str, item: str, score: Column, k: int | None = None) -> DataFrame:
    """``df`` with ``rank`` by descending ``score``, ties by ``item``; at most ``k`` rows a query."""
    w = Window.partitionBy(query).orderBy(score.desc_nulls_last(), F.col(item))
    out = df.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


_RUN = re.compile("[㐀-䶿一-鿿]+|[a-z0-9]+")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, text) -> (chunk_id, tokens, tfs, length): the distinct ``tokens`` of each text, how often each occurs, and how many there are."""
    for b in batches:
        words, counts, sizes = [], [], []
        for text in b.column(1).to_pylist():
            bag = Counter()
            for run in _RUN.findall((text or "").lower()):
                bag.update([run] if run < "{" or len(run) < 2 else map("".join, zip(run, run[1:], strict=False)))
            words += bag
            counts += bag.values()
            sizes.append(len(bag))
        ends = np.cumsum([0, *sizes])
        totals = np.add.reduceat([*counts, 0], np.minimum(ends[:-1], len(counts))) if sizes else np.zeros(0)
        totals = np.where(np.array(sizes, dtype=int) > 0, totals, 0).astype(np.int32)
        offsets = pa.array(ends.astype(np.int32))
        cols = [b.column(0), pa.ListArray.from_arrays(offsets, pa.array(words, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())), pa.array(totals)]
        yield pa.RecordBatch.from_arrays(cols, names=["chunk_id", "tokens", "tfs", "length"])


class LexicalIndex:
    """Postings, document lengths and token weights of a corpus, each a DataFrame.

    Items must be unique. The tokens of each item are counted in its own task, without a shuffle, and written once
    to the shared checkpoint folder; postings are written when they are first asked for.
    """

    def __init__(self, corpus: DataFrame, item: str, text: str):
        kind = dict(corpus.dtypes)[item]
        self._bags = cut(spread(corpus.select(F.col(item).alias("chunk_id"), F.col(text).alias("text"))).mapInArrow(_bags, f"chunk_id {kind}, tokens array<string>, tfs array<int>, length int"))
        self.lengths = self._bags.select("chunk_id", "length")
        self._postings = None

    def _exploded(self) -> DataFrame:
        pair = F.explode(F.arrays_zip("tokens", "tfs")).alias("p")
        return self._bags.select("chunk_id", pair).select(F.col("p.tokens").alias("token"), "chunk_id", F.col("p.tfs").cast("long").alias("tf"))

    @property
    def postings(self) -> DataFrame:
        """(token, chunk_id, tf)."""
        if self._postings is None:
            self._postings = cut(self._exploded())
        return self._postings

    def save(self, path: str) -> None:
        """Postings, by token, and lengths as tables under ``path``."""
        (self._postings if self._postings is not None else self._exploded()).write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        """The index that ``save`` wrote; weights are computed anew."""
        index = cls.__new__(cls)
        index._postings, index.lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
        return index

    @classmethod
    def saved(cls, spark: SparkSession, path: str, make: Callable[[], LexicalIndex]) -> LexicalIndex:
        """The index under ``path``; if there is none, it is made and saved there first."""
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/lengths/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            make().save(path)
        return cls.load(spark, path)

    def idf(self) -> DataFrame:
        """(token, df, idf): a negative weight is replaced by a part of the mean weight."""
        n = self.lengths.agg(F.count("*")).scalar()
        counts = self.postings.groupBy("token").agg(F.count("*").alias("df"))
        raw = counts.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw")).scalar()
        weight = F.when(F.col("raw") < 0, F.lit(EPSILON) * mean).otherwise(F.col("raw"))
        return raw.select("token", "df", weight.alias("idf"))

    def search(self, queries: DataFrame, query: str, text: str, k: int) -> DataFrame:
        """The top ``k`` of each query; a token that a query repeats counts as often.

        Postings are restricted to the queries' tokens before lengths and weights are joined.
        """
        asked = cut(queries.select(F.col(query).alias("query_id"), F.explode(tokens(F.col(text))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf")))
        wanted = asked.select("token").distinct()
        met = self.postings.join(broadcast_if_small(wanted, ASKED_TOKENS), "token", "left_semi")
        weighted = broadcast_if_small(cut(asked.join(self.idf(), "token")), ASKED_TOKENS)
        mean = self.lengths.agg(F.avg("length")).scalar()
        hits = met.join(self.lengths, "chunk_id").join(weighted, "token")
        norm = K1 * (1 - B + B * F.col("length") / mean)
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
        return ranked(scored, "query_id", "chunk_id", F.col("score"), k)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of numbers of equal length; null where one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _packed(rows: int):
    """A map (id, v) -> (n, ids, m): up to ``rows`` vectors of one length at a time as a matrix of unit rows; null, empty and zero vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, rows):
                b = big.slice(start, rows)
                vectors = b.column(1).cast(pa.list_(pa.float64()))
                sizes = np.array(pc.fill_null(pc.list_value_length(vectors), 0))
                for n in np.unique(sizes[sizes > 0]):
                    spot = np.flatnonzero(sizes == n)
                    m = np.array(vectors.take(pa.array(spot)).flatten().to_numpy(zero_copy_only=False)).reshape(-1, n)
                    length = np.sqrt((m * m).sum(axis=1))
                    good = length > 0  # false for NaN too
                    ids = b.column(0).take(pa.array(spot[good]))
                    unit = m[good] / length[good, None]
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([unit.tobytes()], pa.binary())], names=["n", "ids", "m"])

    return run


def _best(k: int):
    """A map over pairs of matrices (n, qs, q, ids, m) -> (query_id, chunk_id, score): the ``k`` best of each query among the rows of one, and all that tie with the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = b.column(0)[i].as_py()
                q, m = (np.frombuffer(b.column(c)[i].as_py(), dtype=np.float64).reshape(-1, n) for c in (2, 4))
                score = q @ m.T
                if score.shape[1] > k:
                    least = np.partition(score, -k, axis=1)[:, -k, None]
                    row, col = np.nonzero(score >= least - 2e-6)  # scores are rounded to 6 digits before they are ranked
                else:
                    row, col = (x.ravel() for x in np.indices(score.shape))
                cols = [b.column(1)[i].values.take(pa.array(row)), b.column(3)[i].values.take(pa.array(col)), pa.array(score[row, col])]
                yield pa.RecordBatch.from_arrays(cols, names=["query_id", "chunk_id", "score"])

    return run


QUERY_ROWS, VECTOR_ROWS = 512, 4_096


def dense_topk(queries: DataFrame, vectors: DataFrame, query: str, item: str, vector: str, k: int, max_blocks: int = 64) -> DataFrame:
    """The top ``k`` vectors of each stated query by exact cosine; a query does not find itself.

    The stated queries meet all vectors in blocks: up to ``QUERY_ROWS`` queries and up to ``VECTOR_ROWS`` vectors
    are a matrix each, and a pair of matrices is one product. The best ``k`` of each block of vectors go on.
    Beyond ``max_blocks`` blocks of queries they are shuffled in place of being broadcast. Vectors of another
    length than a query's are not comparable to it.
    """
    q_type, v_type = dict(queries.dtypes)[query], dict(vectors.dtypes)[item]
    left = queries.select(F.col(query), F.col(vector)).coalesce(1 if queries.limit(QUERY_ROWS * max_blocks + 1).count() <= QUERY_ROWS * max_blocks else 200)
    asked = cut(left.mapInArrow(_packed(QUERY_ROWS), f"n int, ids array<{q_type}>, m binary").select("n", F.col("ids").alias("qs"), F.col("m").alias("q")))
    have = vectors.select(F.col(item), F.col(vector)).mapInArrow(_packed(VECTOR_ROWS), f"n int, ids array<{v_type}>, m binary")
    met = have.join(broadcast_if_small(asked, max_blocks), "n").select("n", "qs", "q", "ids", "m")
    found = met.mapInArrow(_best(k + 1), f"query_id {q_type}, chunk_id {v_type}, score double")
    pairs = found.where("query_id <> chunk_id").withColumn("score", F.round("score", 6))
    return ranked(pairs, "query_id", "chunk_id", F.col("score"), k)


def min_max(df: DataFrame, query: str, score: str, out: str) -> DataFrame:
    """``df`` with the scores of each query on 0 to 1; a constant list is all 1."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    value = F.when(F.col(score).isNull(), F.lit(None)).when(high <= low, 1.0).otherwise((F.col(score) - low) / (high - low))
    return df.withColumn(out, value.cast("double"))


def weighted_fusion(dense: DataFrame, lexical: DataFrame, k: int, weight: float | DataFrame = VECTOR_WEIGHT) -> DataFrame:
    """The top ``k`` by ``weight`` times dense plus the rest times lexical score, each on 0 to 1; a missing side counts 0.

    ``weight`` may be a table (query_id, weight) of its own for each query.
    """
    left = min_max(dense, "query_id", "score", "dense").select("query_id", "chunk_id", "dense", F.col("score").alias("score_vector"))
    right = min_max(lexical, "query_id", "score", "lexical").select("query_id", "chunk_id", "lexical", F.col("score").alias("score_bm25"))
    both = left.join(right, ["query_id", "chunk_id"], "full")
    both = both.join(weight, "query_id") if isinstance(weight, DataFrame) else both.withColumn("weight", F.lit(weight))
    total = F.col("weight") * F.coalesce("dense", F.lit(0.0)) + (1 - F.col("weight")) * F.coalesce("lexical", F.lit(0.0))
    fused = both.select(
        "query_id", "chunk_id", F.round(total, 6).alias("score"),
        F.coalesce("score_vector", F.lit(0.0)).alias("score_vector"), F.coalesce("score_bm25", F.lit(0.0)).alias("score_bm25"),
    )
    return ranked(fused, "query_id", "chunk_id", F.col("score"), k)


def fill_with_lexical(merged: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """``merged`` (query_id, chunk_id, rank), filled with the best lexical hits where a query has fewer than ``k``."""
    extra = lexical.select("query_id", "chunk_id", "rank").join(merged.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = merged.select("query_id", "chunk_id", "rank", F.lit(0).alias("tier")).unionByName(extra.withColumn("tier", F.lit(1)))
    w = Window.partitionBy("query_id").orderBy("tier", "rank", "chunk_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("tier")


def reciprocal_rank_fusion(hits: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """The top ``k`` of each query by the sum of 1 / (constant + rank) over its lists; ``hits``: (query_id, list_id, chunk_id, rank)."""
    fused = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), F.max("list_id").alias("last_list"))
    return ranked(fused, "query_id", "chunk_id", F.col("score"), k)


def boost_stock(hits: DataFrame, score: str, hit_code: str, codes: Column, boost: float = STOCK_BOOST) -> DataFrame:
    """Hits of a wanted stock code rise by ``boost``; ranks anew. ``codes`` is an array."""
    wanted = F.filter(F.transform(codes, lambda c: F.trim(c)), lambda c: c != "")
    raised = F.col(score) + F.when(F.array_contains(wanted, F.trim(hit_code)), boost).otherwise(0.0)
    out = hits.drop("rank").withColumn(score, F.round(raised, 6))
    return ranked(out, "query_id", "chunk_id", F.col(score))


def penalize_comparable(hits: DataFrame, score: str, content_type: str, penalty: float = COMPARABLE_PENALTY) -> DataFrame:
    """Hits in comparable tables fall by ``penalty``, not below 0; ranks anew."""
    lowered = F.when(F.col(content_type) == "comparable_table", F.greatest(F.lit(0.0), F.col(score) - penalty)).otherwise(F.col(score))
    out = hits.drop("rank").withColumn(score, F.round(lowered, 6))
    return ranked(out, "query_id", "chunk_id", F.col(score))


def adjusted(hits: DataFrame, facts: DataFrame, codes: DataFrame) -> DataFrame:
    """``hits`` with ``facts`` (chunk_id, stock_code, content_type): comparable tables fall, hits of a query's stock code rise; ranks anew.

    ``codes``: (query_id, code), the stock code that a query asks for, empty or null for none.
    """
    known = hits.join(facts.select("chunk_id", "stock_code", "content_type"), "chunk_id", "left").join(codes, "query_id", "left")
    lowered = penalize_comparable(known, "score", "content_type")
    return boost_stock(lowered, "score", "stock_code", F.array(F.coalesce("code", F.lit("")))).drop("code")


def route_search(questions: DataFrame, index: LexicalIndex, vectors: DataFrame, facts: DataFrame, k: int, pool: int = POOL, default_weight: float = VECTOR_WEIGHT) -> DataFrame:
    """(query_id, chunk_id, score, rank, stock_code, content_type): the top ``k`` of each question by its route.

    ``questions``: (query_id, route, query, query_type, stock_code, vector) and, for comparisons, ``subs``: an array
    of structs (entity, query), a search of its own for each compared name. ``vectors``: (chunk_id, vector). Route
    ``vector`` takes the dense top, ``bm25`` the lexical top of the widened question, ``hybrid`` both pools, fused by
    the weight of the question's kind, and filled from the lexical side where it is short. A hybrid comparison of two
    names or more searches once for each, in factual weight and without its stock code, and fuses the lists by
    reciprocal rank. Then facts are joined, comparable tables fall and the asked stock code rises.
    """
    rows = cut(questions.withColumn("many", (F.col("route") == "hybrid") & F.col("query_type").eqNullSafe("comparative") & (F.coalesce(F.size("subs"), F.lit(0)) >= 2)))
    one = rows.where("NOT many").select("query_id", F.lit(0).alias("pos"), "route", "query", "query_type", "stock_code", "vector", "many")
    subs = rows.where("many").select("query_id", F.posexplode(F.slice("subs", 1, 3)).alias("pos", "sub"), "route", "vector", "many")
    subs = subs.select("query_id", "pos", "route", F.col("sub.query").alias("query"), F.lit("factual").alias("query_type"), F.lit("").alias("stock_code"), "vector", "many")
    every = one.unionByName(subs)
    every = cut(every.withColumn("widened", widened(F.col("query"), F.col("stock_code"))).withColumn("weight", dense_weight(F.col("query_type"), F.col("query"), default_weight)).withColumn("search", F.concat_ws("#", "query_id", "pos")))
    dense = cut(dense_topk(every.where("route <> 'bm25'").select("search", "vector"), vectors.select(F.col("chunk_id").cast("string").alias("item"), "vector"), "search", "item", "vector", max(k, pool)))
    dense = dense.select(F.col("query_id").alias("search"), F.col("chunk_id").cast(dict(vectors.dtypes)["chunk_id"]).alias("chunk_id"), "score")
    lexical = cut(index.search(every.where("route <> 'vector'"), "search", "widened", max(k, pool)).withColumnRenamed("query_id", "search"))
    of = lambda df, route: df.join(every.where(F.col("route") == route).select("search", "query_id"), "search")
    keep = ["query_id", "chunk_id", "score"]
    vector_hits = ranked(of(dense, "vector").select(*keep), "query_id", "chunk_id", F.col("score"), k)
    lexical_hits = ranked(of(lexical, "bm25").select(*keep), "query_id", "chunk_id", F.col("score"), k)
    mixed = every.where("route = 'hybrid'")
    pools = [df.join(mixed.select("search"), "search", "left_semi").select(F.col("search").alias("query_id"), "chunk_id", "score") for df in (dense, lexical)]
    fused = weighted_fusion(*pools, max(k, pool), mixed.select(F.col("search").alias("query_id"), "weight"))
    fused = cut(fused.select(F.col("query_id").alias("search"), "chunk_id", "score", "rank").join(mixed.select("search", "query_id", "pos", "many"), "search"))
    lists = fused.where("many").select("query_id", F.col("pos").alias("list_id"), "chunk_id", "rank")
    single = fused.where(f"NOT many AND rank <= {k}").select(*keep)
    merged = reciprocal_rank_fusion(lists, k).select(*keep).unionByName(single)
    codes = rows.select("query_id", F.col("stock_code").alias("code"))
    return adjusted(vector_hits.select(*keep).unionByName(lexical_hits.select(*keep)).unionByName(merged), facts, codes)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
