"""Reading and writing of manifests, chunks, questions and reports, and upserts by document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Folders of industries and their labels.
INDUSTRIES = {"semi-conductor": "半导体", "power-electronics": "电力", "e-commercial": "互联网电商", "appliance": "白色家电"}

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "filename", "industry", "industry_label", "source_pdf_path")])
CHUNK = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("chunk_id", "doc_id", "content_type", "company_name", "stock_code", "section_title", "text", "embedding_text")]
    + [T.StructField("is_retrievable", T.BooleanType()), T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType())]
)
QUESTION = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "query", "gold_answer", "category", "query_type", "stock_code", "doc_id", "industry_label")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("section_keywords", "must_contain_any", "gold_chunk_ids", "negative_stock_codes")]
)


def discover_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, filename, industry, industry_label, path) of the files under ``root``; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    industry = F.when(folder == root.rstrip("/").rsplit("/", 1)[-1], "").otherwise(folder)
    label = F.coalesce(F.create_map(*[F.lit(x) for pair in INDUSTRIES.items() for x in pair])[industry], industry)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), name.alias("filename"), industry.alias("industry"), label.alias("industry_label"), "path")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows, the last of each document."""
    rows = spark.read.schema(MANIFEST).json(path).where("doc_id IS NOT NULL").withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    w = Window.partitionBy("doc_id").orderBy(F.desc("_at"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_at")


def manifest_or_files(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The manifest, or the files under ``root`` as a manifest where it has no rows."""
    rows = read_manifest(spark, path)
    if not rows.isEmpty():
        return rows
    return discover_files(spark, root).withColumnRenamed("path", "source_pdf_path").select(*MANIFEST.fieldNames())


PAGES = "array<array<struct<type:string,content:string>>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pages) of parsed content lists, a file a document: pages of items (type, content)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
    return files.select(F.regexp_replace("f", r"(_content_list(_v2)?)?\.json$", "").alias("doc_id"), F.from_json("value", PAGES).alias("pages"))


def parse_files(files: DataFrame, parse: Callable[[bytes], str], min_chars: int = 1) -> DataFrame:
    """(doc_id, text, status, error, needs_check) of ``files`` (doc_id, content): a parser at the boundary.

    A file that fails is a row with its error; the others go on. Short texts are marked for a check.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, content in zip(b["doc_id"], b["content"], strict=True):
                try:
                    rows.append((doc, parse(content), "done", ""))
                except Exception as error:
                    rows.append((doc, None, "failed", f"{type(error).__name__}: {error}"[:500]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "status", "error"])

    out = files.select("doc_id", "content").mapInPandas(run, "doc_id string, text string, status string, error string")
    return out.withColumn("needs_check", F.coalesce(F.length(F.trim("text")) < min_chars, F.lit(True)))


def parse_summary(parsed: DataFrame) -> DataFrame:
    """One row per status: documents, characters, documents to be checked."""
    return parsed.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.count_if("needs_check").alias("n_check"))


def read_chunks(spark: SparkSession, path: str, retrievable_only: bool = True) -> DataFrame:
    """Chunks with their defaults; a chunk is retrievable unless it says otherwise."""
    rows = spark.read.schema(CHUNK).json(path)
    text = [c for c, t in rows.dtypes if t == "string"]
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in text], F.coalesce("is_retrievable", F.lit(True)).alias("is_retrievable"),
                       *[F.coalesce(c, F.lit(0)).alias(c) for c in ("page_start", "page_end")])
    return rows.where("is_retrievable") if retrievable_only else rows


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their defaults; a malformed line is an error, and so is a file without questions."""
    rows = spark.read.schema(QUESTION).option("mode", "FAILFAST").json(path)
    lists = [c for c, t in rows.dtypes if t.startswith("array")]
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c, t in rows.dtypes if t == "string"], *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists])
    if rows.isEmpty():
        raise ValueError(f"no questions in {path}")
    return rows


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str, *order: str) -> None:
    """A CSV report with a header; nested columns as JSON."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    (flat.orderBy(*order) if order else flat).write.mode("overwrite").option("header", "true").csv(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV report with nested columns read from JSON, as ``write_report`` wrote it."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, nested) else f.dataType) for f in schema])
    rows = spark.read.schema(flat).option("header", "true").csv(path)
    return rows.select(*[F.from_json(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in schema])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``; with ``replaced``, whether the key was there."""
    known = old.select(key).distinct().withColumn("replaced", F.lit(True))
    kept = old.join(new.select(key).distinct(), key, "left_anti").withColumn("replaced", F.lit(False))
    return kept.unionByName(new.join(known, key, "left").withColumn("replaced", F.coalesce("replaced", F.lit(False))), allowMissingColumns=True)


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be done: the rows whose key is not among the done ones."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def delete_documents(rows: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.join(documents.select(key).distinct(), key, "left_anti")
