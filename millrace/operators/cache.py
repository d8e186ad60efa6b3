"""A two-level result cache as tables: keys, lookups, time to live, safety, invalidation and statistics.

Entries are rows (storage_key, bucket, scope, stock_code, query_type, config_fingerprint, index_fingerprint,
generation_fingerprint, vector, created_at, ttl_s, refused, ...). An expired entry is never served.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.query import cache_text
from millrace.functions.text import stripped, text_or_empty
from millrace.operators.retrieval import cosine
from millrace.session import cut

# Threshold of similarity, times to live in seconds, greatest number of entries, hits looked at.
SIMILARITY = 0.88
TTL_SEARCH, TTL_CHAT, TTL_REFUSED, TTL_SUMMARY_CHAT = 86_400, 43_200, 900, 14_400
MAX_ENTRIES = 10_000
TOP = 5
# Reasons for which an entry is stale and is to be purged.
STALE_REASONS = (
    "index_fingerprint_mismatch", "config_fingerprint_mismatch", "generation_fingerprint_mismatch", "chunk_missing", "metadata_missing", "stock_code_mismatch", "company_mismatch",
    "report_year_mismatch", "doc_id_mismatch", "doc_version_mismatch", "metadata_filter_mismatch", "query_type_mismatch", "expired",
)


def config_fingerprint(route: Column, recall_k: Column, rerank_k: Column, threshold: Column, weight: Column, pool: Column) -> Column:
    return F.format_string("route=%s|rtk=%d|rrk=%d|ref=%.4f|hw=%.4f|pool=%d", route, recall_k, rerank_k, threshold, weight, pool)


def generation_fingerprint(model: Column, prompt: Column, context: Column, predict: Column) -> Column:
    return F.format_string("model=%s|prompt=%s|ctx=%d|pred=%d", model, prompt, context, predict)


def index_fingerprint(table: DataFrame, key: str) -> DataFrame:
    """One row (fingerprint): a digest of the number of rows and of the sum of their keys' hashes, alike for equal content."""
    facts = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("h"))
    return facts.select(F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("h").cast("string")), 256), 1, 16).alias("fingerprint"))


def metadata_fingerprint(stock_code: Column, query_type: Column, company: Column | None = None, year: Column | None = None, doc_id: Column | None = None, version: Column | None = None) -> Column:
    """What a question is restricted to, in one line; what is not given is a dash."""
    given = lambda c, other="-": F.coalesce(F.nullif(stripped(text_or_empty(c)), F.lit("")), F.lit(other)) if c is not None else F.lit(other)
    parts = [("stock=", given(stock_code)), ("|qtype=", given(query_type, "factual")), ("|co=", given(company)), ("|yr=", given(year)), ("|doc=", given(doc_id)), ("|ver=", given(version))]
    return F.concat(*[x for label, value in parts for x in (F.lit(label), value)])


def _dash(generation: Column) -> Column:
    return F.coalesce(F.nullif(generation, F.lit("")), F.lit("-"))


def key_text(scope: Column, query: Column, config: Column, index: Column, generation: Column, metadata: Column) -> Column:
    """What an exact entry is found by, before its digest; a search has no generation."""
    made = F.when(scope == "chat", _dash(generation)).otherwise("-")
    parts = [("scope=", scope), ("|cfg=", config), ("|idx=", index), ("|gen=", made), ("|meta=", metadata), ("|q=", cache_text(query))]
    return F.concat(*[x for label, value in parts for x in (F.lit(label), value)])


def storage_key(*parts: Column) -> Column:
    return F.sha2(key_text(*parts), 256)


def bucket(scope: Column, config: Column, index: Column, generation: Column, metadata: Column) -> Column:
    """32 hex digits for the entries among which a similar question may be looked for."""
    return F.substring(F.sha2(F.concat_ws("|", scope, config, index, _dash(generation), metadata), 256), 1, 32)


def payload_chunk_ids(payload: Column) -> Column:
    """The distinct chunk ids of a JSON payload, in the order of its lists of citations, evidence, rerank and recall hits."""
    hits = "array<struct<chunk_id:string>>"
    parsed = F.from_json(payload, f"citations {hits}, evidence_hits {hits}, rerank_hits {hits}, recall_hits {hits}")
    lists = [F.coalesce(parsed[c]["chunk_id"], F.array().cast("array<string>")) for c in ("citations", "evidence_hits", "rerank_hits", "recall_hits")]
    return F.filter(F.array_distinct(F.concat(*lists)), lambda c: F.coalesce(c != "", F.lit(False)))


def missing_chunks(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """(entry_id, missing) of entries whose ``chunk_ids`` are not all known; an empty registry knows all."""
    if registry.isEmpty():
        return entries.select("entry_id", F.array().cast("array<string>").alias("missing")).limit(0)
    listed = entries.select("entry_id", F.explode("chunk_ids").alias("chunk_id"))
    unknown = listed.join(registry.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return unknown.groupBy("entry_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("missing"))


ENTRY_JSON = "version int, storage_key string, query string, scope string, stock_code string, query_type string, ttl_s int, refused boolean, chunk_ids array<string>"


def entry_to_json(*fields: Column) -> Column:
    """An entry as versioned JSON; vectors are left out."""
    return F.to_json(F.struct(F.lit(1).alias("version"), *fields))


def entry_from_json(text: Column) -> Column:
    """The entry of versioned JSON; null for another version or malformed text."""
    entry = F.from_json(text, ENTRY_JSON)
    return F.when(entry["version"] == 1, entry)


def purge(entries: DataFrame, rejected: DataFrame) -> DataFrame:
    """``entries`` without those of ``rejected`` (entry_id, reason) whose reason tells that they are stale."""
    stale = rejected.where(F.col("reason").isin(*STALE_REASONS)).select("entry_id").distinct()
    return entries.join(stale, "entry_id", "left_anti")


def may_store(query_type: Column, refused: Column, ttl_refused: int = TTL_REFUSED) -> Column:
    """Comparisons are never stored; refusals only while they have a time to live."""
    return ~query_type.eqNullSafe("comparative") & (~F.coalesce(refused, F.lit(False)) | F.lit(ttl_refused > 0))


def ttl(scope: Column, refused: Column, query_type: Column) -> Column:
    return (
        F.when(F.coalesce(refused, F.lit(False)), TTL_REFUSED).when(scope == "search", TTL_SEARCH)
        .when(query_type.eqNullSafe("summary"), F.least(F.lit(TTL_CHAT), F.lit(TTL_SUMMARY_CHAT))).otherwise(TTL_CHAT)
    )


def expired(created_at: Column, ttl_s: Column, now: Column) -> Column:
    """An entry whose age has reached its time to live, that has none, or whose date is null."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(created_at.cast("timestamp"))
    return F.coalesce((ttl_s <= 0) | (age >= ttl_s.cast("long") * 1_000_000), F.lit(True))


def exact_lookup(requests: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """``requests`` (request_id, storage_key) with the newest living entry of their key: ``entry_id``, null on a miss."""
    live = entries.where(~expired(F.col("created_at"), F.col("ttl_s"), now))
    newest = live.groupBy("storage_key").agg(F.max_by("entry_id", F.struct("created_at", "entry_id")).alias("entry_id"))
    return requests.join(newest, "storage_key", "left")


def similar_lookup(requests: DataFrame, entries: DataFrame, now: Column, threshold: float = SIMILARITY) -> DataFrame:
    """(request_id, entry_id, similarity) of the best living entry of a request's bucket, among its ``TOP`` most similar.

    Only buckets are joined, so requests meet the entries of their own kind alone.
    """
    live = entries.where(~expired(F.col("created_at"), F.col("ttl_s"), now)).select("bucket", "entry_id", F.col("vector").alias("entry_vector"))
    pairs = requests.join(live, "bucket").withColumn("similarity", F.round(cosine(F.col("vector"), F.col("entry_vector")), 6))
    w = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("similarity"), "entry_id")
    near = pairs.withColumn("place", F.row_number().over(w)).where((F.col("place") <= TOP) & (F.col("similarity") >= threshold))
    return near.where("place = 1").select("request_id", "entry_id", "similarity")


def company_match(a: Column, b: Column) -> Column:
    x, y = cache_text(a), cache_text(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def rejection(request: str, entry: str, exact: Column, similarity: Column, ttl_refused: int = TTL_REFUSED) -> Column:
    """Why an entry may not be served for a request, or empty; ``request`` and ``entry`` are aliases of two sides of a join.

    First what the question is restricted to, then the fingerprints, similarity and refusals, then whether the
    entry's chunks are known (``chunks_known``). A null ``metadata`` of the request asks for nothing more, one
    of the entry cannot be checked.
    """
    r, e = lambda c: F.col(f"{request}.{c}"), lambda c: F.col(f"{entry}.{c}")
    given = lambda c: stripped(text_or_empty(r(c)))
    names = (given("company_name") != "") & (stripped(text_or_empty(e("company_name"))) != "")
    limited = r("metadata").isNotNull()
    same = lambda c: limited & (given(c) != "") & (stripped(text_or_empty(e(c))) != given(c))
    rules = [
        ("stock_code_mismatch", (given("stock_code") != "") & ~e("stock_code").eqNullSafe(r("stock_code"))),
        ("query_type_mismatch", ~e("query_type").eqNullSafe(r("query_type"))),
        ("metadata_missing", limited & e("metadata").isNull()),
        ("company_mismatch", limited & names & ~company_match(r("company_name"), e("company_name"))),
        ("report_year_mismatch", same("report_year")),
        ("doc_id_mismatch", same("doc_id")),
        ("doc_version_mismatch", same("doc_version")),
        ("index_fingerprint_mismatch", ~e("index_fingerprint").eqNullSafe(r("index_fingerprint"))),
        ("config_fingerprint_mismatch", ~e("config_fingerprint").eqNullSafe(r("config_fingerprint"))),
        ("generation_fingerprint_mismatch", (e("scope") == "chat") & ~e("generation_fingerprint").eqNullSafe(r("generation_fingerprint"))),
        ("similarity_below_threshold", ~exact & (similarity < SIMILARITY)),
        ("refused_not_served", F.coalesce(e("refused"), F.lit(False)) & F.lit(ttl_refused <= 0)),
        ("chunk_missing", ~F.coalesce(e("chunks_known"), F.lit(True))),
    ]
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules], F.lit(""))


def two_level_lookup(requests: DataFrame, entries: DataFrame, now: Column, registry: DataFrame | None = None) -> DataFrame:
    """(request_id, layer, entry_id, similarity, reason): exact first, then similar for the misses; layer L1, L2 or miss.

    Every candidate passes ``rejection`` before it is served; ``reason`` tells why the first candidate of a miss was
    not. Both sides carry keys, buckets, vectors, fingerprints and what they are restricted to. ``registry``:
    (chunk_id) of the known chunks, held against the entries' ``chunk_ids``.
    """
    live = entries.where(~expired(F.col("created_at"), F.col("ttl_s"), now))
    if registry is not None:
        lost = missing_chunks(live, registry).select("entry_id", F.lit(False).alias("known"))
        live = live.join(lost, "entry_id", "left").withColumn("chunks_known", F.coalesce("known", F.lit(True))).drop("known")
    elif "chunks_known" not in live.columns:
        live = live.withColumn("chunks_known", F.lit(True))
    newest = Window.partitionBy("storage_key").orderBy(F.desc("created_at"), F.desc("entry_id"))
    first = live.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    r, e = requests.alias("r"), first.alias("e")
    exact = r.join(e, F.col("r.storage_key") == F.col("e.storage_key")).select(F.col("r.request_id"), F.col("e.entry_id"), F.lit(1.0).alias("similarity"), F.lit("L1").alias("layer"), rejection("r", "e", F.lit(True), F.lit(1.0)).alias("reason"), F.lit(0).alias("place"))
    exact = cut(exact)
    rest = requests.join(exact.where("reason = ''").select("request_id"), "request_id", "left_anti").alias("r")
    near = rest.join(live.alias("e"), F.col("r.bucket") == F.col("e.bucket")).withColumn("similarity", F.round(cosine(F.col("r.vector"), F.col("e.vector")), 6))
    order = Window.partitionBy("r.request_id").orderBy(F.desc_nulls_last("similarity"), F.col("e.entry_id"))
    near = near.withColumn("place", F.row_number().over(order)).where((F.col("place") <= TOP) & F.col("similarity").isNotNull())
    similar = near.select("r.request_id", "e.entry_id", "similarity", F.lit("L2").alias("layer"), rejection("r", "e", F.lit(False), F.col("similarity")).alias("reason"), "place")
    tried = exact.unionByName(similar)
    best = tried.groupBy("request_id").agg(F.min_by(F.struct("layer", "entry_id", "similarity"), F.when(F.col("reason") == "", F.struct("layer", "place"))).alias("hit"), F.min_by("reason", F.struct("layer", "place")).alias("reason"))
    out = requests.select("request_id").join(best, "request_id", "left")
    served = F.col("hit").isNotNull()
    return out.select("request_id", F.when(served, F.col("hit.layer")).otherwise("miss").alias("layer"), F.col("hit.entry_id").alias("entry_id"), F.coalesce("hit.similarity", F.lit(0.0)).alias("similarity"), F.when(served, "").otherwise(F.coalesce("reason", F.lit(""))).alias("reason"))


def keep_recent(entries: DataFrame, now: Column, limit: int = MAX_ENTRIES, order: str = "last_access") -> DataFrame:
    """The living entries of greatest ``order``, at most ``limit`` of each scope."""
    live = entries.where(~expired(F.col("created_at"), F.col("ttl_s"), now))
    w = Window.partitionBy("scope").orderBy(F.desc_nulls_last(order), "entry_id")
    return live.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("place")


def invalidate(entries: DataFrame, scope: str | None = None, index_fingerprint: str | None = None, doc_ids: DataFrame | None = None) -> DataFrame:
    """``entries`` without those that match all given conditions; ``doc_ids``: (doc_id) of changed documents, with ``entry_docs`` arrays."""
    tests = []
    if scope is not None:
        tests.append(F.col("scope") == scope)
    if index_fingerprint is not None:
        tests.append(F.col("index_fingerprint") == index_fingerprint)
    if doc_ids is None:
        if not tests:
            return entries.limit(0)
        return entries.where(~F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)))
    touched = entries.select("entry_id", *{"scope", "index_fingerprint"} & set(entries.columns), F.explode("entry_docs").alias("doc_id")).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    if tests:
        touched = touched.where(reduce(lambda a, b: a & b, tests))
    return entries.join(touched.select("entry_id").distinct(), "entry_id", "left_anti")


def statistics(events: DataFrame) -> DataFrame:
    """One row of counts and rates over requests (hit, layer, latency_ms, saved_ms, llm_called); rates of nothing are 0."""
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    n, hits = F.count("*"), F.count_if("hit")
    return events.agg(
        n.alias("n_requests"), hits.alias("n_hits"), F.count_if(F.col("layer") == "L1").alias("n_l1"), F.count_if(F.col("layer") == "L2").alias("n_l2"),
        rate(hits, n).alias("hit_rate"), rate(F.sum(F.when(F.col("hit"), F.col("latency_ms"))), hits).alias("avg_hit_ms"),
        rate(F.sum(F.when(~F.col("hit"), F.col("latency_ms"))), n - hits).alias("avg_miss_ms"), rate(F.count_if(~F.col("llm_called")), n).alias("llm_reduction"),
    )
