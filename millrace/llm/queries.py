"""The registered queries of the problems, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import boilerplate, canonical, defects, mixing, near_duplicates, splitting, tokens, truncation
from millrace.llm.reference_sql import SQL
from millrace.sources.tables import latest, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks whose texts repeat one another almost entirely."""
    return near_duplicates.duplicate_pairs(table(spark, folder, "retrieved_chunks"), "chunk_id", "text", 0.6)


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk with its group of near-duplicates and the number of its links."""
    return near_duplicates.duplicate_groups(table(spark, folder, "retrieved_chunks"), "chunk_id", "text", 0.6)


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of both fields in its form."""
    units = table(spark, folder, "content_units").select(F.lit("unit_text").alias("field"), F.col("unit_id").alias("row_id"), F.col("text").alias("value"))
    hits = table(spark, folder, "retrieved_chunks").select(F.lit("section_title").alias("field"), F.col("hit_id").alias("row_id"), F.col("section_title").alias("value"))
    return canonical.canonicalize(units.unionByName(hits), "value")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values that are not in their form."""
    return p3_forms(spark, folder).where(~F.col("form").eqNullSafe(F.col("value"))).select("field", "row_id").distinct()


def _p4(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    names = {"unit": "unit_id", "document": "doc_id", "source": "broker", "text": "text"}
    return table(spark, folder, "content_units"), latest(table(spark, folder, "doc_manifest"), "doc_id", "updated_at"), names


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of a line that a broker repeats in many reports."""
    units, documents, names = _p4(spark, folder)
    return boilerplate.repeated_lines(units, documents, **names).withColumn("line_no", F.col("line_no").cast("int"))


def p4_units(spark: SparkSession, folder: str) -> DataFrame:
    """The units, each once, without those lines."""
    units, documents, names = _p4(spark, folder)
    found = boilerplate.repeated_lines(units, documents, **names)
    return boilerplate.without_lines(latest(units, "unit_id", "loaded_at").select("unit_id", "text"), found, unit="unit_id", text="text")


def _limited_units(spark: SparkSession, folder: str) -> DataFrame:
    limits = table(spark, folder, "size_limits")  # one row for each unit_type
    units = table(spark, folder, "content_units").select("unit_id", "unit_type", "text").dropDuplicates(["unit_id"])
    return units.join(F.broadcast(limits), "unit_type", "left")  # a unit of another type has no limit and stays whole


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized units by the kind of their cuts, and table units with unsound stored parts."""
    limits = table(spark, folder, "size_limits")
    units = table(spark, folder, "content_units")
    over = units.select("unit_id", "unit_type", "text").join(F.broadcast(limits), "unit_type")
    cut = splitting.oversized(over, "text", "max_chars").select("unit_id", F.when(F.col("hard"), "hard").otherwise("natural").alias("kind")).distinct()
    tables = units.where("unit_type = 'table'").select("unit_id").distinct()
    parts = table(spark, folder, "table_chunk_parts").withColumn("unit_type", F.lit("table")).join(F.broadcast(limits), "unit_type")
    bad = splitting.unsound_parts(parts, "unit_id", F.max("max_chars")).join(tables, "unit_id", "left_semi")
    return cut.unionByName(bad.select("unit_id", F.lit("bad_parts").alias("kind")))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every unit in pieces within its limit."""
    pieces = splitting.split_pieces(_limited_units(spark, folder), "text", "max_chars", "overlap_chars")
    return pieces.select("unit_id", "part_index", "part_count", "part_text")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.token_ids(table(spark, folder, "documents"), "doc_id", "text", "byte_bpe_50k")


def _mix(spark: SparkSession, folder: str, one_pass: bool = False) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").select("doc_id", "source", tokens.token_count(F.col("text")).alias("n_tokens"))
    return mixing.mix(documents, "doc_id", table(spark, folder, "mix_targets"), one_pass)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The training mix, as long as one pass over the listed sources: which document stands in which slot, and for which time."""
    return _mix(spark, folder, one_pass=True)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the mix that each listed source really has."""
    return _mix(spark, folder, one_pass=True)[1]


def p7_exact_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The longest mix in which every listed source with tokens has its target; the source first at its cap sets its length."""
    return _mix(spark, folder)[0]


def p7_exact_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of that mix."""
    return _mix(spark, folder)[1]


def p7_long_mix(spark: SparkSession, folder: str) -> DataFrame:
    """``p7_mix`` by its former name."""
    return _mix(spark, folder, one_pass=True)[0]


def p7_long_shares(spark: SparkSession, folder: str) -> DataFrame:
    """``p7_shares`` by its former name."""
    return _mix(spark, folder, one_pass=True)[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text breaks off."""
    return truncation.truncated(table(spark, folder, "documents"), "doc_id", "text", "title").select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates."""
    documents = table(spark, folder, "documents").select("doc_id", "source")
    marked = documents.join(p8_found(spark, folder).withColumn("cut", F.lit(1)), "doc_id", "left")
    rates = marked.groupBy("source").agg(F.count("*").alias("n_documents"), F.count("cut").alias("n_truncated"))
    return rates.withColumn("rate", F.round(F.col("n_truncated") / F.col("n_documents"), 6))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs of question and answer."""
    return defects.defective_pairs(table(spark, folder, "eval_generation_detail"), "row_id", "query", "answer")


def queries() -> dict[str, Query]:
    """The queries by name."""
    own = [p1_found, p2_found, p2_groups, p3_found, p3_forms, p4_found, p4_units, p5_found, p5_pieces, p6_ids, p7_mix, p7_shares, p7_exact_mix, p7_exact_shares, p7_long_mix, p7_long_shares, p8_found, p8_rates]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL that gives the rows of a query, where SQL can express it at the size of whole tables."""
    return SQL
