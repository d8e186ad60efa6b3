from pyspark.sql import functions as F

from millrace.operators import chunking
from millrace.plans import registry
from millrace.plans.common import hits, questions


def test_numbers_beyond_four_digits(spark):
    chunks = spark.range(10_010).select(F.lit("d").alias("doc_id"), F.format_string("%08d", "id").alias("chunk_id"))
    ids = {r[0] for r in chunking.renumber(chunks, F.col("chunk_id")).select("chunk_id").collect()}
    assert len(ids) == 10_010 and {"d_0001", "d_1000", "d_10000", "d_10010"} <= ids


def test_group_numbers_beyond_four_digits(spark):
    rows = spark.createDataFrame([("d", 1000, 1, "a", "s", 1), ("d", 10_000, 2, "b", "s", 1)], "doc_id string, group_no int, pos long, text string, section_title string, page_number int")
    assert {r["chunk_id"] for r in chunking.chunk_groups(rows).collect()} == {"d_1000", "d_10000"}


def test_every_question_has_its_prompt(spark, folder):
    known = hits(spark, folder).where("stage = 'rerank'").select("doc_id").distinct()
    wanted = {r[0] for r in questions(spark, folder).join(known, "doc_id", "left_semi").select("row_id").collect()}
    got = [r[0] for r in registry.queries()["prompts"](spark, folder).select("query_id").collect()]
    assert len(wanted) > 1 and len(got) == len(set(got)) and set(got) == wanted
