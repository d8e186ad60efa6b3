import pytest
from pyspark.sql import types as T

from millrace.session import broadcast_if_small, checkpoint_dir, cut
from millrace.sources import io
from millrace.sources.tables import latest


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 2), (2, "x", None), (None, "n", 1)], "k int, v string, t int")
    assert {(r["k"], r["v"]) for r in latest(df, "k", "t").collect()} == {(1, "b"), (2, "x"), (None, "n")}
    assert latest(df.limit(0), "k", "t").count() == 0


def test_manifest_chunks_questions(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"doc_id":"a","filename":"1"}\n{"doc_id":"a","filename":"2"}\n{"filename":"x"}\n')
    assert [r["filename"] for r in io.read_manifest(spark, str(tmp_path / "m.json")).collect()] == ["2"]
    (tmp_path / "c.json").write_text('{"chunk_id":"1","is_retrievable":false}\n{"chunk_id":"2"}\n')
    assert [(r["chunk_id"], r["text"], r["page_start"]) for r in io.read_chunks(spark, str(tmp_path / "c.json")).collect()] == [("2", "", 0)]
    (tmp_path / "q.json").write_text('{"id":"1","query":"x","must_contain_any":["a"]}\n')
    assert io.read_questions(spark, str(tmp_path / "q.json")).first()["must_contain_any"] == ["a"]
    (tmp_path / "e.json").write_text("")
    with pytest.raises(ValueError):
        io.read_questions(spark, str(tmp_path / "e.json"))
    (tmp_path / "bad.json").write_text('{"id":\n')
    with pytest.raises(Exception):
        io.read_questions(spark, str(tmp_path / "bad.json")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "power-electronics").mkdir()
    (tmp_path / "power-electronics" / "a.b.pdf").write_bytes(b"x")
    (tmp_path / "top.pdf").write_bytes(b"x")
    got = {(r["doc_id"], r["industry"], r["industry_label"]) for r in io.discover_files(spark, str(tmp_path)).collect()}
    assert got == {("a.b", "power-electronics", "电力"), ("top", "", "")}


def test_report_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("l", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([(2, ["a", "b,c"]), (1, None)], schema)
    io.write_report(df, str(tmp_path / "r"), "k")
    assert sorted(map(tuple, io.read_report(spark, str(tmp_path / "r"), schema).collect()), key=str) == [(1, None), (2, ["a", "b,c"])]


def test_upsert_and_pending(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "doc_id string, v int")
    new = spark.createDataFrame([("a", 9), ("c", 8)], "doc_id string, v int")
    assert {tuple(r) for r in io.upsert(old, new, "doc_id").select("doc_id", "v", "replaced").collect()} == {("b", 3, False), ("a", 9, True), ("c", 8, False)}
    assert {r[0] for r in io.pending(new, old, "doc_id").collect()} == {"c"}
    assert io.delete_documents(old, new).count() == 1


def test_cut_keeps_rows_and_folder(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sorted(map(tuple, cut(df).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    assert broadcast_if_small(df, 1) is df and broadcast_if_small(df, 5) is not df


def test_parsing_isolates_failures(spark, tmp_path):
    def parse(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return content.decode()

    files = spark.createDataFrame([("a", bytearray(b"text")), ("b", bytearray(b"bad")), ("c", bytearray(b""))], "doc_id string, content binary")
    out = {r["doc_id"]: (r["text"], r["status"], r["needs_check"]) for r in io.parse_files(files, parse).collect()}
    assert out == {"a": ("text", "done", False), "b": (None, "failed", True), "c": ("", "done", True)}
    assert {r["status"]: r["n"] for r in io.parse_summary(io.parse_files(files, parse)).collect()} == {"done": 2, "failed": 1}


def test_pages_and_fallback(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "d1_content_list_v2.json").write_text('[[{"type":"title","content":"T"}],[{"type":"table","content":"x"}]]')
    row = io.read_pages(spark, str(tmp_path / "p")).first()
    assert row["doc_id"] == "d1" and [len(p) for p in row["pages"]] == [1, 1]
    (tmp_path / "m.json").write_text("")
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "z.pdf").write_bytes(b"x")
    assert [r["doc_id"] for r in io.manifest_or_files(spark, str(tmp_path / "m.json"), str(tmp_path / "pdf")).collect()] == ["z"]
