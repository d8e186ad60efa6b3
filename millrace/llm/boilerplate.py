"""Lines that one source repeats in many documents (problem 4).

Lines are reduced to a 128-bit hash of their text without blanks and invisible characters. Documents
are counted per (source, hash): distinct documents first, so that no task ever holds more than its
share of a hot line. Frequent lines are few: with a document share of at least s, a source has at
most (mean distinct lines per document) / s of them.

Null sources take no part. Null texts have no lines; lines that are empty without blanks are never
frequent. A line repeated within one document counts once. Re-delivered rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

# Code points that show nothing, beside the categories Z, Cc and Cf.
_UNSEEN = r"[\p{Z}\p{Cc}\p{Cf}\s\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{180B}-\x{180F}\x{E0100}-\x{E01EF}]+"


def bare(line: Column) -> Column:
    """A line without blanks of any kind and invisible characters."""
    return F.regexp_replace(line, _UNSEEN, "")


def line_hashes(text: Column) -> Column:
    """One struct (a, b) of two independent 64-bit hashes per line of ``text``, null for lines that are empty when bare."""
    # the mark before the second copy makes the second hash independent of the first
    return F.transform(
        F.transform(F.split(text, "\n"), bare),
        lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.concat(F.lit("\x01"), x)).alias("b"))),
    )


def hashed_lines(units: DataFrame, documents: DataFrame, *, unit: str, document: str, source: str, text: str) -> DataFrame:
    """A row (source, document, unit, line_no, line) for each line that counts, numbered from 1.

    Only hashes are shuffled to the documents' sources, never the text.
    """
    hashed = units.where(F.col(text).isNotNull()).select(
        F.col(document).alias("document"), F.col(unit).alias("unit"), line_hashes(F.col(text)).alias("lines")
    )
    sources = documents.where(F.col(source).isNotNull()).select(F.col(document).alias("document"), F.col(source).alias("source")).distinct()
    return (
        hashed.join(sources, "document")
        .select("source", "document", "unit", F.posexplode("lines").alias("pos", "line"))
        .where("line IS NOT NULL")
        .select("source", "document", "unit", (F.col("pos") + 1).alias("line_no"), "line")
    )


def frequent_lines(lines: DataFrame, documents: DataFrame, *, document: str, source: str, min_documents: int = 4, min_share: float = 0.2) -> DataFrame:
    """(source, line, n_documents) of the lines in at least ``min_documents`` and ``min_share`` of a source's documents."""
    sizes = documents.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.countDistinct(document).alias("n_source"))
    counts = lines.select("source", "line", "document").distinct().groupBy("source", "line").agg(F.count("*").alias("n_documents"))
    counts = counts.where(F.col("n_documents") >= min_documents)
    return counts.join(sizes, "source").where(F.col("n_documents") >= min_share * F.col("n_source")).select("source", "line", "n_documents", "n_source")


def repeated_lines(units: DataFrame, documents: DataFrame, *, unit: str, document: str, source: str, text: str, min_documents: int = 4, min_share: float = 0.2) -> DataFrame:
    """(unit, line_no) of every occurrence of a frequent line, once each; the hashed lines are written once for both uses."""
    lines = cut(hashed_lines(units, documents, unit=unit, document=document, source=source, text=text))
    frequent = frequent_lines(lines, documents, document=document, source=source, min_documents=min_documents, min_share=min_share)
    hits = lines.join(frequent.select("source", "line"), ["source", "line"], "left_semi")
    return hits.select(F.col("unit").alias(unit), "line_no").distinct()


def without_lines(units: DataFrame, found: DataFrame, *, unit: str, text: str) -> DataFrame:
    """``units`` with ``text`` rebuilt without the lines that ``found`` (unit, line_no) names.

    Units without such lines keep their text; a unit of nothing else comes out empty, a null text null.
    """
    per_unit = found.groupBy(F.col(unit).alias("_unit")).agg(F.collect_set("line_no").alias("_drop"))
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("_drop"), (i + 1).cast("int")))
    joined = units.join(per_unit, F.col(unit) == F.col("_unit"), "left")
    return joined.withColumn(text, F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_unit", "_drop")
