from millrace.llm import boilerplate

NAMES = {"unit": "unit_id", "document": "doc_id", "source": "broker", "text": "text"}


def tables(spark, n_docs=10, shared=5):
    documents = [(f"d{i}", "b", i) for i in range(n_docs)] + [("d0", "b", 77), ("x", None, 1), ("y", "c", 1)]
    units = [(i, f"d{i}", f"own {i}\n" + ("Legal  ​notice" if i % 2 else " Legal notice") if i < shared else f"own {i}", "t") for i in range(n_docs)]
    units += [(0, "d0", units[0][2], "later"), (50, "x", "Legal notice", "t"), (51, "y", "Legal notice", "t"), (52, "d1", None, "t"), (53, "d2", "", "t"), (54, None, "Legal notice", None)]
    return spark.createDataFrame(units, "unit_id long, doc_id string, text string, line string"), spark.createDataFrame(documents, "doc_id string, broker string, line_no int")


def found(spark, **kw):
    units, documents = tables(spark, **kw)
    return {(r["unit_id"], r["line_no"]) for r in boilerplate.repeated_lines(units, documents, **NAMES).collect()}


def test_share_and_number_are_needed(spark):
    assert found(spark, n_docs=10, shared=5) == {(i, 2) for i in range(5)}
    assert found(spark, n_docs=20, shared=4) == {(i, 2) for i in range(4)}  # 4 of 20 are 20 %
    assert found(spark, n_docs=21, shared=4) == set()
    assert found(spark, n_docs=10, shared=3) == set()


def test_units_are_rebuilt(spark):
    units, documents = tables(spark)
    lines = boilerplate.repeated_lines(units, documents, **NAMES)
    out = {r["unit_id"]: r["text"] for r in boilerplate.without_lines(units.dropDuplicates(["unit_id"]), lines, unit="unit_id", text="text").collect()}
    assert out[0] == "own 0" and out[7] == "own 7" and out[52] is None and out[53] == "" and out[50] == "Legal notice"


def test_repeats_within_a_document_count_once(spark):
    units = spark.createDataFrame([(1, "d1", "a\na\na\na"), (2, "d1", "a")], "unit_id long, doc_id string, text string")
    documents = spark.createDataFrame([("d1", "b")], "doc_id string, broker string")
    assert boilerplate.repeated_lines(units, documents, **NAMES).count() == 0


def test_empty(spark):
    units = spark.createDataFrame([], "unit_id long, doc_id string, text string")
    documents = spark.createDataFrame([], "doc_id string, broker string")
    assert boilerplate.repeated_lines(units, documents, **NAMES).count() == 0
